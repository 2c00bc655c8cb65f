"""Labelled documents for fitting classifiers, all or a bounded sample, and the fold they must leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small_enough

FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out from all fitting."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def labelled_ids(labels: DataFrame, target: str) -> DataFrame:
    """doc_id, y (0 or 1) and fold of every labelled id outside fold 0.

    An id labelled twice counts with its larger label; null ids and null labels are left out; labels above 0 are 1.
    """
    held = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("doc_id is not null and y is not null")
    return held.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y")).withColumn("fold", fold().cast("int")).where("fold <> 0")


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, limit: int = 500_000) -> DataFrame:
    """doc_id, text, lang, y, fold of every row of docs whose id has a label outside fold 0; up to `limit` ids are broadcast."""
    ids = labelled_ids(labels, target)
    return _texts(docs).join(F.broadcast(ids) if small_enough(ids, limit) else ids, "doc_id")


def training_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, max_bytes: int | None = None) -> DataFrame:
    """At most max_rows labelled rows outside fold 0: doc_id, text, lang, y (0 or 1), fold; written once.

    Which labelled rows are taken depends on their ids alone (smallest seeded hashes first), so the
    sample does not change with partitioning; with max_bytes, in the same order, only those up to
    which all texts taken have no more bytes.  A document labelled twice counts with its larger label,
    one with several texts with the first by hash; null ids and null labels are left out; labels above
    0 are 1; no labelled rows give no rows.  Only the sampled ids reach the text scan.
    """
    order = [F.xxhash64(F.lit(17), "doc_id"), F.col("doc_id")]
    chosen = labelled_ids(labels, target).orderBy(*order).limit(max_rows)
    # The broadcast side has max_rows rows at most.
    found = _texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text")).alias("d"), F.first("y").alias("y"), F.first("fold").alias("fold"))
    found = Scratch(docs.sparkSession, "sample").save(found.select("doc_id", "d.text", "d.lang", "y", "fold"), target)
    if max_bytes is None:
        return found
    # One window over the ids and lengths of the sample: max_rows rows at most.
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.orderBy(*order))
    return found.join(F.broadcast(found.select("doc_id", upto.alias("upto")).where(F.col("upto") <= max_bytes).select("doc_id")), "doc_id")
