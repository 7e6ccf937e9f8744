"""The stages of the corpus pipeline against brute force, and all of them in a row."""

import collections
import re

import corpus_pipeline
import pytest
from samples import frame, lower, rows, spaced
from test_pairs import expected_components, expected_lines

from geoalbums.llm import language

NAMES = [name for name, _ in corpus_pipeline.STAGES]
STAGE = dict(corpus_pipeline.STAGES)
ITEMS = [(1, " ".join(spaced(rows()[2][1])[3:25])), (2, "nothing of this is in any of the texts at all, be they long"), (None, None), (3, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame(spark).write.parquet(f"{folder}/documents.parquet")
    return folder


def pairs(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_language(spark, docs, sf_dir):
    kept = STAGE["language"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    unseen = language.held_out(docs.doc_id, 4, 2)
    judged = language.identify(docs, language.train(docs.where(~unseen)), names=("a", "b")).collect()
    expected = [(r["doc_id"], r["text"]) for r in judged if r["a"] != "und" and r["b"] >= corpus_pipeline.LEAST_SCORE]
    assert pairs(kept) == collections.Counter(expected)
    assert all(re.search(r"[^\W\d_]", text or "") for _, text in expected) and len(expected) > 40


def test_line_dedup(spark, docs, sf_dir):
    kept = STAGE["line_dedup"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    removed, count = expected_lines()
    expected = collections.Counter()
    for r in rows():
        doc = (r[0], r[1])
        if not count[doc] or len(removed[doc]) < count[doc]:
            lines = (r[1] or "").split("\n")
            expected[r[0], r[1] and "\n".join(x for i, x in enumerate(lines) if i not in removed[doc])] += 1
    ours = pairs(kept)
    drop = lambda found: {k: v for k, v in found.items() if k[0] != 1004}  # its two texts may go in either order
    assert drop(ours) == drop(expected)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept.collect())


def test_near_duplicates(spark, docs, sf_dir):
    kept = STAGE["near_duplicates"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    stay = {doc for doc, _, lowest, own in expected_components(5, 80) if doc is not None and own}
    found = collections.Counter(r["doc_id"] for r in kept.collect())
    assert found.pop(None) == sum(r[0] is None for r in rows())
    assert found == collections.Counter(stay)  # once each, also where a row is repeated


def test_decontamination(spark, docs, sf_dir):
    kept = STAGE["decontamination"](spark, docs, sf_dir)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for _, text in ITEMS:
        w = re.findall(pattern, lower(text))
        windows |= {tuple(w[s : s + 10]) for s in range(len(w) - 9)}

    def clean(text):
        w = re.findall(pattern, lower(text))
        return not any(tuple(w[s : s + 10]) in windows for s in range(len(w) - 9))

    expected = collections.Counter((r[0], r[1]) for r in rows() if clean(r[1]))
    assert pairs(kept) == expected and sum(expected.values()) < len(rows())
    assert kept.columns == docs.columns


def test_run(spark, sf_dir):
    assert NAMES == ["language", "line_dedup", "near_duplicates", "decontamination", "mix"]
    found = corpus_pipeline.run(spark, sf_dir).collect()
    step = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name in NAMES[:-1]:
        step = STAGE[name](spark, step, sf_dir)
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(r["doc_id"] for r in step.collect())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found) and sum(r["taken"] for r in found) > 0


def test_empty(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame(spark, []).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
