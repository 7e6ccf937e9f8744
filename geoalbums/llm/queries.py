"""The queries of the `llm` operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoalbums.llm import main_text, quality_classifier
from geoalbums.llm.conversation_trie import conversation_trie
from geoalbums.llm.decontaminate import decontaminate
from geoalbums.llm.fingerprints import sketch_with_next
from geoalbums.llm.language import held_out, identify, train
from geoalbums.llm.line_dedup import dedup_lines
from geoalbums.llm.mixing import mix_sources
from geoalbums.llm.near_duplicates import NearDuplicateConfig, near_duplicates
from geoalbums.llm.passages import near_duplicate_passages
from geoalbums.llm.quality_rules import quality_rules
from geoalbums.llm.repeated_bytes import remove_repeats
from geoalbums.llm.sql import ORACLE_SQL  # noqa: F401
from geoalbums.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("removed_lines")


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op3_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), NearDuplicateConfig(shingle=3, percent=85))


def op5_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    unseen = held_out(F.col("doc_id"), 5, 0)
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels").where(~unseen))
    scored = quality_classifier.score_quality(docs.select("doc_id", unseen.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_prefix_free_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op7_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that go, by number."""
    lines = dedup_lines(_table(spark, sf_dir, "documents"))
    numbers = F.array_join(F.array_sort("removed_lines").cast("array<string>"), ",")
    return lines.select("doc_id", "n_lines", "n_removed", numbers.alias("removed_lines"))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_passages(_table(spark, sf_dir, "documents")).drop("spans")


def op9_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return main_text.main_text(pages, main_text.train(pages)).drop("n_blocks")


def op10_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    unseen = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~unseen).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", unseen.alias("held_out"), "text"), model).drop("text")


def op11_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_with_next(_table(spark, sf_dir, "documents"))


def op12_block_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_line_frequency": op1_line_frequency,
    "op2_pivotal_mix": op2_pivotal_mix,
    "op3_prefix_filter": op3_prefix_filter,
    "op4_chosen_path": op4_chosen_path,
    "op5_boosted_trees": op5_boosted_trees,
    "op6_prefix_free_parse": op6_prefix_free_parse,
    "op7_set_join": op7_set_join,
    "op8_compact_windows": op8_compact_windows,
    "op9_block_labeller": op9_block_labeller,
    "op10_word_backoff": op10_word_backoff,
    "op11_scaled_sketch": op11_scaled_sketch,
    "op12_block_hashing": op12_block_hashing,
    "op13_spectrum_slicing": op13_spectrum_slicing,
}
