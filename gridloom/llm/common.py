"""Helpers the corpus operators share: table access, shared scratch tables, code shipping, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import session_folder
from ..shipping import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder, to cut lineage and to read a result more than once.

    A lost executor costs only the stage that runs; what is written survives it.  The tables stay
    for results that are still to be computed from them, until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = session_folder(spark, name)
        self.count = 0

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if path.startswith("file:"):
                path = "file:" + "/" + path[5:].lstrip("/")
            delete_path(self.spark, path)

    def close(self) -> None:
        delete_path(self.spark, self.root)


_released = -1.0


def release() -> None:
    """Hand free memory back to the system: a reused Python worker otherwise keeps its peak. At most once a second."""
    global _released
    if time.monotonic() - _released < 1:
        return
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)
    _released = time.monotonic()


def lean(run):
    """A mapInArrow function that gives its memory back at the end of a partition."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def lean_group(run):
    """An applyInArrow function that gives its memory back after a group."""

    @functools.wraps(run)
    def wrapped(table):
        out = run(table)
        release()
        return out

    return wrapped


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession, rows: int = 2000, size: str = "16MB") -> None:
    """What every operator with Python functions needs: the package on the executors, and Arrow
    batches of at most so many rows and, unless the session sets a size itself, about so many bytes,
    since rows hold whole documents."""
    ship_package(spark)
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, size)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def join_on_id(big: DataFrame, ids: DataFrame, key: str, how: str, limit: int = 500_000) -> DataFrame:
    """Semi or anti join of wide rows with a table of ids.

    The ids (one long each) are broadcast only if at most `limit` of them exist, else both sides
    are shuffled.
    """
    return big.join(F.broadcast(ids) if small_enough(ids, limit) else ids, key, how)


def hot_join(rows: DataFrame, facts: DataFrame, on: list[str], most: int = 1000, share: int = 100_000) -> DataFrame:
    """Rows (a written table) with the facts of their key: the key, docs (the number of its rows) and more.

    Keys of more than `most` rows, or more than one in `share` of all rows if that is more, are joined by
    broadcast, so that their rows stay where they are: no more than `share` keys can be.  The others are shuffled.
    """
    floor = max(most, rows.count() // share)
    hot = facts.where(F.col("docs") > floor)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(facts.where(F.col("docs") <= floor), on))


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60, settle: bool = True) -> DataFrame:
    """(id, component) for every node of the edges (a, b); component is the smallest id reachable.

    Alternating large-star and small-star steps: every step is one aggregation and one join of
    edges on a node, so no component is ever gathered in one place and a hub's rows can be split.
    With settle=False it stops after so many rounds: equal labels then still mean one component,
    but one component may keep several labels.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before, done = None, None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.save(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "star")
        state = settle and after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if done is not None:
            scratch.drop(done)
        edges = done = after
        if settle and state == before:
            break
        before = state
    else:
        if settle:
            raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    ).groupBy("id").agg(F.min("component").alias("component"))
