"""A training-data pipeline over `documents`: quality classifier, near-duplicate join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents; the
last one returns token pieces with their places. `n_chars` follows the text where a stage changes it. A very long text is one
row, which must fit in a task. An empty table stays empty through all stages. Further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightwarden.llm import jaccard, packing, quality, repeats
from nightwarden.llm.queries import vocabulary
from nightwarden.session import configure, cut_lineage

KEEP_SCORE = 0.7
WINDOW = 50
LIMIT = 1024


def stage(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that may also be run by itself, in a session that has not been configured."""
    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return build(configure(spark), docs, sf_dir)

    return run_stage


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, scores at KEEP_SCORE or more."""
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs, forest, out="__score").where(F.col("__score") >= KEEP_SCORE).select(*docs.columns)


@stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity 0.8 or more.

    It is that of the smallest doc_id, rows without one last; of rows that share the id, that of the smallest row hash, and
    of equal rows one. Documents without words are in no class and stay.
    """
    row, more = F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)
    name = F.struct(F.col("doc_id").isNull().alias("without"), F.coalesce("doc_id", F.lit(0)).alias("id"), row.alias("row"), more.alias("more"))
    docs = docs.withColumn("__name", name)
    classes = jaccard.classes_of(docs, n=5, num=80, den=100, key="__name").where("n_shingles > 0")
    dropped = classes.where("component_id <> __name").select("__name").distinct()
    kept = docs.join(dropped, "__name", "left_anti")
    kept = kept.withColumn("__copy", F.row_number().over(Window.partitionBy("__name").orderBy("__name")))
    return kept.where("__copy = 1 OR NOT coalesce(text, '') RLIKE '[^ \\\\x09-\\\\x0D]'").drop("__name", "__copy")


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of WINDOW words or more that occur more than once; others are unchanged."""
    cut = repeats.without_repeats(docs, window=WINDOW).where("n_removed > 0").select("h1", "h2", F.col("kept").alias("__kept"))
    changed, text = F.col("__kept").isNotNull(), F.coalesce("__kept", "text")
    rows = repeats.attach(docs, cut, how="left")
    rows = rows.withColumns({"text": text, "n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))})
    return rows.select(*docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all texts, placed in sequences of at most LIMIT tokens."""
    pieces = packing.token_pieces(docs, vocabulary(), limit=LIMIT, end=2)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.best_fit(pieces, limit=LIMIT, groups=packing.groups_for(docs, limit=LIMIT))


STAGES = [
    ("quality", keep_quality), ("near_copies", keep_one_of_near_copies), ("repeats", cut_repeats), ("packing", pack_sequences)]
ORACLE_SQL = None  # trees and packing are beyond SQL; each stage is tested against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table, each result written and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, build in STAGES:
        docs = cut_lineage(build(spark, docs, sf_dir))
    return docs
