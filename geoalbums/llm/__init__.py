"""Operations of a training-data pipeline over text: see the README's section on `llm`."""
