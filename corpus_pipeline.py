"""A corpus pipeline: quality filter, near-duplicate removal, PII surrogates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is
written as Parquet and read again. All but the last return the columns of ``documents``, and columns of
any other name as well. Rows that mixing takes several times are repeated.

Defined results: null and empty texts are scored as empty, are never near duplicates, hold no entities
and get the whole copies that the mix gives all of their source; rows without an id are never near duplicates of
others; of rows that repeat an id within a group of near duplicates one stays, and rows that repeat an
id with unlike texts stay apart; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm import common, mixing, neardup, pii, quality, spm

#: Near duplicates share LEAST of PARTS of their runs of so many words, or more.
WORDS, LEAST, PARTS = 5, 80, 100
#: Rows to drop that are sent to all executors at most (about 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    doc_id, text = common.place_of(docs, "doc_id"), common.place_of(docs, "text")
    rows = common.by_place(docs).withColumn("row", F.xxhash64(doc_id, text))
    told = neardup.near_duplicates(rows.select("row", F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=WORDS, least=LEAST, parts=PARTS, row_col="row")
    found = common.materialize(told.filter("doc_id IS NOT NULL"), "near-duplicates")
    common.drop(told)
    # a group keeps one row: with its smallest id, and of rows that repeat that id the one with the smallest hash
    stays = found.filter("kept AND group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("i"), F.min("row").alias("r"), F.count(F.lit(1)).alias("n"))
    again = common.materialize(stays.filter("n > 1"), "again")
    repeats = again.limit(1).count() > 0
    goes = found.filter("NOT kept").select("doc_id", "row")
    if repeats:
        goes = goes.union(found.filter("kept").join(again, "group").filter("row <> r").select("doc_id", "row"))
    goes = common.materialize(goes.distinct(), "goes")
    few = goes.count() <= BROADCAST_ROWS
    goes = goes.select(F.col("doc_id").alias("i"), F.col("row").alias("r"))
    left = rows.join(F.broadcast(goes) if few else goes, (F.col(doc_id) == F.col("i")) & (F.col("row") == F.col("r")), "left_anti")
    if repeats:  # rows alike in id and text: only those are moved
        alike = again.select("i", "r")
        same = (F.col(doc_id) == F.col("i")) & (F.col("row") == F.col("r"))
        left = left.join(alike, same, "left_anti").unionByName(left.join(alike, same, "left_semi").dropDuplicates([doc_id, "row"]))
    common.drop(found)
    return left.drop("row").toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    at = [common.place_of(docs, c) for c in ("doc_id", "source", "text")]
    plain = common.by_place(docs)
    mixed = mixing.mix(plain.select(*(F.col(c).alias(n) for c, n in zip(at, ("doc_id", "source", "text"), strict=True))))
    taken = mixed.groupBy("doc_id", "key").agg(F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("n")).filter("sum > 0").withColumnRenamed("doc_id", "i")
    taken = common.materialize(taken, "copies")
    common.drop(mixed)
    # texts move once and are not sorted; rows that the mix leaves out find no partner
    rows = plain.withColumn("key", mixing.row_key(*(F.col(c) for c in at))).join(taken.hint("shuffle_hash"), "key").filter(F.col(at[0]).eqNullSafe(F.col("i")))
    if taken.filter("n > 1").limit(1).count():  # rows alike share their copies
        nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
        rows = rows.withColumn("copies", (F.floor(F.col("sum") / F.col("n")) + F.when(nth <= F.col("sum") % F.col("n"), 1).otherwise(0)).cast("int")).filter("copies > 0")
    else:
        rows = rows.withColumn("copies", F.col("sum").cast("int"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*plain.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spm.digests(docs)


STAGES = [
    ("quality", quality.keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pii.without_pii),
    ("mix", mix_sources),
    ("tokens", encode),
]

#: Hashing, learned scores and random rounding are not for SQL; ``tests/llm/test_pipeline.py`` holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), name)
        common.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
