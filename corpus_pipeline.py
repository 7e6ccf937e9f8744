"""A training corpus out of `documents`: five stages, each written as Parquet and read again.

Every stage works on all that its predecessor kept. All but the last return the columns of
`documents`; the last one says how often the mix takes each document. Of a stage only its decisions
stay (which documents or lines go): what it wrote to find them is gone when the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoalbums.llm import language
from geoalbums.llm.decontaminate import decontaminate
from geoalbums.llm.line_dedup import cut_lines
from geoalbums.llm.mixing import mix_sources
from geoalbums.llm.near_duplicates import near_duplicates
from geoalbums.sources.shared import materialize, scratch

LEAST_SCORE = 0.4  # of a language among all learned; even odds among four are 0.25

ORACLE_SQL = None  # drawing, training and minwise tokens have no SQL twin: see tests/llm


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are in no language (null, empty, no letter) or in none clearly. Rows are judged
    one by one: repeated ones alike, those without doc_id too; of languages that score the same the
    first in the alphabet counts. Where nothing can be learned every document goes."""
    unseen = language.held_out(F.col("doc_id"), 4, 2)
    with scratch(spark):
        model = language.train(docs.where(~unseen).select("doc_id", "text", "lang"))
    named = language.identify(docs, model, names=("__lang", "__score"))
    clear = (F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)
    return named.where(clear).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_document_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one go; so do documents of which no line stays. n_chars is counted anew.

    Documents without a line (null, empty, white space) stay as they are. Repeated rows are one
    document and all stay or go; rows without doc_id come last in the order of lines.
    """
    left = cut_lines(docs)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the lowest doc_id, once if its row is repeated (of
    different rows with that id the one whose text comes first). Rows without doc_id, and texts
    without words, are in no group and stay."""
    with scratch(spark):
        gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
        gone = materialize(gone, "near-duplicates", outlives=True)
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = materialize(again, "repeated-ids")
    left = docs.join(gone, "doc_id", "left_anti")
    once = left.join(again, "doc_id", "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, "text").alias("row")).select("row.*")
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none; repeated rows
    and rows without doc_id are judged one by one, items without text have no window."""
    # rows are told apart by id and text, so that those without an id are judged too
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    with scratch(spark):
        found = decontaminate(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        found = found.where("contaminated").select(F.col("doc_id").alias("__key")).distinct()
        gone = materialize(found, "contaminated", outlives=True)
    return docs.withColumn("__key", key).join(gone, "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document that is left; null texts have no words, a null source is a
    source, repeated rows are drawn one by one. Ties between documents are decided by hashes."""
    return mix_sources(docs)


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_document_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
