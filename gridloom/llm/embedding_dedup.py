"""Near-duplicate vectors by cross-polytope hashing, with multiprobe buckets and verified pairs.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and names the
axis, with its sign, that the result lies closest to.  A bucket of a table joins two such hashes.
Besides its own bucket a vector enters the next best ones, those that cost the least in the rotated
values.  Vectors that meet in a bucket are compared in double precision, block against block; a pair
counts in the first bucket that its vectors share, so counts need no list of pairs, and a block
hands on no more than a spanning forest of its links.  Equal vectors are one class.

Buckets share tasks in packs, so rows are shuffled once, by pack.  A bucket of more than `block_rows`
classes is dealt into blocks, and every two of its blocks meet in one task: a vector travels once for
each block of its bucket.  Up to 16 blocks are cut for the sake of parallel tasks, beyond that they
grow to 8 * `block_rows` classes; long vectors make them smaller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, hot_join, lean, lean_group, prepare
from .vectors import matrices, usable


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), scaled to keep norms."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


_PACK_BYTES, _BLOCK_BYTES = 16_000_000, 64_000_000  # of vectors in doubles that one task holds of a pack, and of a block
_HOT_BUCKETS = 200_000

# Perturbations of a pair of hashes: ranks of the axis taken in the first and in the second.
_STEPS = ((1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2))


def bucket_codes(matrix: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """Buckets (rows, tables, 1 + probes) of unit vectors; the first of each table is the vector's own."""
    n, d = matrix.shape
    size = 1 << max(2, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = matrix
    rng = np.random.default_rng([seed, size])
    out = np.empty((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)[:, None]
    for t in range(tables):
        axes, values = [], []
        for _ in range(2):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice((-1.0, 1.0), size))
            top = np.argpartition(-np.abs(x), 2, axis=1)[:, :3]
            top = top[rows, np.argsort(-np.abs(x[rows, top]), axis=1, kind="stable")]
            value = x[rows, top]
            axes.append(2 * top + (value < 0))
            values.append(np.abs(value))
        loss = [(v[:, :1] - v) ** 2 for v in values]
        cost = np.stack([loss[0][:, a] + loss[1][:, b] for a, b in _STEPS], axis=1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        steps = np.array(_STEPS)
        first = np.concatenate([axes[0][:, :1], axes[0][rows, steps[best, 0]]], axis=1)
        second = np.concatenate([axes[1][:, :1], axes[1][rows, steps[best, 1]]], axis=1)
        out[:, t] = first * (2 * size) + second
    return out


def _units(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by the largest component first, which keeps the squares of any finite vector finite."""
    unit = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _sent(matrix: np.ndarray) -> list[bytes]:
    """Each row as doubles, or as single floats where those say the same."""
    with np.errstate(over="ignore"):
        short = matrix.astype(np.float32)
    same = (short == matrix).all(axis=1)
    return [(a if ok else b).tobytes() for a, b, ok in zip(short, matrix, same)]


def _received(rows: list[bytes], d: int) -> np.ndarray:
    if all(len(x) == 4 * d for x in rows):
        return np.frombuffer(b"".join(rows), np.float32).reshape(-1, d).astype(np.float64)
    return np.array([np.frombuffer(x, np.float32 if len(x) == 4 * d else np.float64) for x in rows], np.float64)


def _code_type(d: int):
    """Codes of short vectors fit 32 bits."""
    return np.int32 if d <= 16_384 else np.int64


def _enter(tables: int, probes: int, seed: int):
    """Class vectors to one row for every bucket they enter."""

    def run(batches):
        for batch in batches:
            weight_of = batch.column(1).to_numpy()
            for at, matrix in matrices(pa.array(np.arange(batch.num_rows)), batch.column(2)):
                for a in range(0, len(at), 2048):
                    rows = at[a : a + 2048]
                    m = matrix[a : a + 2048]
                    codes = bucket_codes(_units(m), tables, probes, seed)
                    per = tables * (1 + probes)
                    n = len(rows)
                    ids = batch.column(0).take(pa.array(np.repeat(rows, per)))
                    table_of = np.tile(np.repeat(np.arange(tables), 1 + probes), n)
                    again = pa.array(np.repeat(np.arange(n), per))
                    vectors = pa.array(_sent(m), pa.binary()).take(again)
                    lists = pa.array([x.tobytes() for x in codes.astype(_code_type(m.shape[1]))], pa.binary()).take(again)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((np.int64(m.shape[1]) << 6) | table_of.astype(np.int64)), pa.array(codes.reshape(-1)), ids, pa.array(np.repeat(weight_of[rows], per)), vectors, lists],
                        names=["space", "code", "rep", "weight", "vector", "codes"],
                    )

    return run


_LINK_SCHEMA = "rep long, n long, root long"


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest place of each one's part under the links p - q."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[p], label[q])
        old = label.copy()
        np.minimum.at(label, p, m)
        np.minimum.at(label, q, m)
        label = label[label]
        if (label == old).all():
            return label


_SMALL = 24  # buckets of at most so many classes are compared all together


def _blocks(tables: int, probes: int, least: float):
    """Links within a pack of buckets, or one block pair of a bucket: per class the weight of linked classes, and a local root."""
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        space, low, high = (group.column(c)[0].as_py() for c in ("space", "i", "j"))
        d, table_at = space >> 6, space & 63
        code, rep, weight, salt = (group.column(c).to_numpy() for c in ("code", "rep", "weight", "salt"))
        order = np.lexsort((rep, salt, code))
        code, rep, weight, salt = code[order], rep[order], weight[order], salt[order]
        unit = _units(_received(group.column("vector").to_pylist(), d))[order]
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), _code_type(d)).reshape(len(rep), tables, 1 + probes)[order]
        n = np.zeros(len(rep), np.int64)
        lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def take(x: np.ndarray, y: np.ndarray) -> None:
            """Links between places x and y, each counted in the first bucket that both of its vectors enter."""
            for b in range(0, len(x), 20_000):
                p, q = x[b : b + 20_000], y[b : b + 20_000]
                shared = codes[p][:, : table_at + 1, :, None] == codes[q][:, : table_at + 1, None, :]
                before = shared[:, :table_at].any(axis=(1, 2, 3)) if table_at else np.zeros(len(p), bool)
                here = np.where(shared[:, table_at].any(axis=2), codes[p][:, table_at], np.iinfo(codes.dtype).max).min(axis=1)
                new = ~before & (here == code[p])
                p, q = p[new], q[new]
                np.add.at(n, p, weight[q])
                np.add.at(n, q, weight[p])
                lefts.append(p)
                rights.append(q)
            # Of the links so far a forest is enough: each class with the root of its part.
            if sum(map(len, lefts)) > 1_000_000:
                root = _roots(len(rep), np.concatenate(lefts), np.concatenate(rights))
                some = np.flatnonzero(root != np.arange(len(rep)))
                lefts[:], rights[:] = [some], [root[some]]

        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        size = np.diff(np.r_[first, len(code)])
        small = np.repeat((size <= _SMALL) & (low == high), size)
        for gap in range(1, min(_SMALL, len(code))):
            p = np.flatnonzero((code[gap:] == code[:-gap]) & small[:-gap])
            for b in range(0, len(p), 20_000):
                x = p[b : b + 20_000]
                hit = np.einsum("ij,ij->i", unit[x], unit[x + gap]) >= least
                take(x[hit], x[hit] + gap)
        for a, k in zip(first.tolist(), size.tolist()):
            if small[a]:
                continue
            cut = a + int(np.searchsorted(salt[a : a + k], low, side="right"))
            lhs, rhs = (np.arange(a, a + k),) * 2 if low == high else (np.arange(a, cut), np.arange(cut, a + k))
            # Slices of both sides, so that a block of any size needs a bounded matrix.
            for rows, others in ((lhs[x : x + 512], rhs[y : y + 4096]) for x in range(0, len(lhs), 512) for y in range(0, len(rhs), 4096)):
                if low == high and rows[0] >= others[-1]:
                    continue
                hit = unit[rows] @ unit[others].T >= least
                if low == high:
                    hit &= rows[:, None] < others[None, :]
                x, y = np.nonzero(hit)
                take(rows[x], others[y])
        label = _roots(len(rep), np.concatenate(lefts), np.concatenate(rights))
        some = n > 0
        return pa.Table.from_arrays([pa.array(rep[some]), pa.array(n[some]), pa.array(rep[label[some]])], schema=schema)

    return run


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.9, tables: int = 4, probes: int = 3, seed: int = 1, block_rows: int = 2000) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding).

    n_links counts the other rows linked directly (cosine >= least, in doubles, among those that
    share a bucket), component_id is the smallest id reachable over links, kept is whether that is
    the row's own.  Vectors that are null, empty, zero, or hold null or non-finite components, and
    vectors of different length, link with nothing; rows with equal vectors link, and count one by
    one; rows that repeat an id with different vectors are one node of the components; a row with a
    null id has no links and a null component; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "embedding-dedup")
    good = usable(vectors).where(F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    # A row finds its class by 128 bits and the length of its vector, which so travels once, to be grouped.
    digest = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1).cast("long"), "v").alias("k2"), F.size("v").alias("k3")]
    classes = scratch.save(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    entered = scratch.save(
        classes.select("rep", "weight", "v").mapInArrow(lean(_enter(tables, probes, seed)), "space long, code long, rep long, weight long, vector binary, codes binary"), "entered"
    )
    width = F.shiftright("space", 6) * 8  # bytes of a vector
    rows, volume = entered.agg(F.count("*"), F.sum(width)).first()
    fits = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(_BLOCK_BYTES) / width)))
    block = F.greatest(fits, F.least(8 * fits, F.ceil(F.col("size") / 16), F.floor(F.lit(_BLOCK_BYTES) / width)))
    # Large buckets: at most _HOT_BUCKETS, since each holds that share of all rows.  The others stay together in packs.
    large = entered.groupBy("space", "code").agg(F.count("*").alias("size")).where(F.col("size") > F.greatest(fits, F.lit(rows // _HOT_BUCKETS)))
    large = F.broadcast(large.select("space", "code", F.ceil(F.col("size") / block).cast("int").alias("deal")))
    packs = max(1, (volume or 0) // _PACK_BYTES)
    dealt = entered.join(large, ["space", "code"], "left")
    pack = F.when(F.col("deal").isNull(), F.pmod(F.xxhash64("code"), F.lit(packs))).otherwise(-1 - F.col("code"))
    dealt = dealt.withColumn("pack", pack).withColumn("deal", F.coalesce("deal", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("deal")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
    dealt = dealt.select("space", "pack", "code", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "rep", "weight", "vector", "codes")
    links = scratch.save(dealt.groupBy("space", "pack", "i", "j").applyInArrow(lean_group(_blocks(tables, probes, least)), _LINK_SCHEMA), "links")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("id", "rep")
    per_class = classes.select(*digest, "rep", "weight").join(counts, "rep", "left").join(parts, "rep", "left").select(
        "k1", "k2", "k3", F.col("weight").alias("docs"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component")
    )
    per_class = scratch.save(per_class, "per-class")
    joined = hot_join(scratch.save(good.select("vec_id", *digest), "keyed"), per_class, ["k1", "k2", "k3"]).select("vec_id", "n", "component")
    found = scratch.save(joined.groupBy("vec_id", "n", "component").agg(F.count("*").alias("c")), "found")
    # Rows of one id: components of an id's vectors meet.
    low = found.groupBy("vec_id").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    split = found.join(low.where("low <> high").select("vec_id", "low"), "vec_id").where("component <> low").select(F.col("component").alias("a"), F.col("low").alias("b"))
    if not split.isEmpty():
        roots = connected_components(split, scratch).select(F.col("id").alias("component"), F.col("component").alias("root"))
        found = found.join(roots, "component", "left").select("vec_id", "n", F.coalesce("root", "component").alias("component"), "c")
    found = found.withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), "c")))
    rest = _unusable(vectors)
    out = found.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id")).union(
        rest.select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _unusable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    good = (
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    )
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(good, F.lit(False)).alias("good")).where(~F.col("good")).select("vec_id")


def embedding_digest(embeddings: DataFrame) -> DataFrame:
    return near_duplicate_vectors(embeddings.select("vec_id", "embedding"), least=0.9)
