"""Jaccard self-join of documents on word shingles with several global token orders.

Method.  Two sets with Jaccard similarity t share a token among the first n - ceil(t*n) + 1 tokens
of each, in *any* order of all tokens.  A pair is therefore a candidate only if it shares a prefix
token under every one of several orders:

* order 1 puts rare shingles first, by document frequency counted over the whole corpus;
  shingles of one document only fill prefix places without ever giving a candidate, and the place
  of a shared shingle in both prefixes must leave room for the overlap that the two sizes need;
* orders 2 and 3 are two seeded random orders.

Only pairs that pass all of them are verified on the full shingle sets.

Scale.  Documents with equal sets are one class, represented by its smallest id.  Shingles travel
packed, some bytes each, first to shards by shingle (to count documents) and then, only those that
two or more documents share, to blocks by document (to cut prefixes).  Very frequent shingles are
known beforehand from a bounded table and never reach a shard.  In a token's list no pair within
one component is ever compared: a first pass links each class to one hub, a second one compares
what is left across components, each member of a smaller component against the others.  Lists of
frequent tokens are joined without a shuffle, their pairs are dealt to shares, and the sets of a
document in many pairs travel in several copies.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, join_on_id, lean, lean_group, prepare
from .wordhash import mix64, shingle_arrays

_TOKEN_BITS = np.uint64(46)  # of a shingle's hash in the candidate search; verification uses 64
_HEAVY_SHARE = 100_000  # a shingle is heavy from 1/100,000 of all shingles on: at most 100,000 are
_SHARD_TOKENS = 2_000_000
_FANOUT = 2_048  # shards that one task packs for
_HOT_ROWS, _HOT_KEYS = 1_000, 100_000  # a key is hot beyond this many rows, or this share of all if that is more
_TASK_PAIRS = 1_000_000
_ORDER_SEEDS = (0x51ED270B9F3A6D17, 0x2545F4914F6CDD1D)


def _prefix(n, percent: int):
    """Length of the prefix of a set of size n: n - ceil(percent/100 * n) + 1."""
    return n - (percent * n + 99) // 100 + 1


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _single(text: str, words: int) -> int:
    """64-bit digest of the only shingle of a text: its first words."""
    first = " ".join(m[0] for m in itertools.islice(_WORD.finditer(text), words))
    return int.from_bytes(hashlib.blake2b(first.encode().lower(), digest_size=8).digest(), "little", signed=True)


def _scan(words: int):
    """Per text: id, set size and a 128-bit signature; per task: shingles frequent in it."""

    def run(batches):
        held: list[np.ndarray] = []
        tokens = 0

        def frequent():
            if not tokens:
                return None
            every = np.concatenate(held)
            held.clear()
            values, counts = np.unique(every, return_counts=True)
            keep = counts >= max(8, tokens // _HEAVY_SHARE)
            n = int(keep.sum())
            null = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays(
                [null, null, null, null, pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=_SCAN_NAMES
            )

        for batch in batches:
            sizes, low, high = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, grams in shingle_arrays(batch.column(1), words):
                sizes[row] = len(grams)
                low[row] = np.bitwise_xor.reduce(grams, initial=np.uint64(0)).view(np.int64) if len(grams) else 0
                if len(grams) == 1:  # nothing but this one shingle tells such texts apart
                    high[row] = _single(batch.column(1)[row].as_py(), words)
                else:
                    high[row] = np.sum(mix64(grams ^ np.uint64(_ORDER_SEEDS[0])), dtype=np.uint64).view(np.int64) if len(grams) else 0
                held.append(grams >> (np.uint64(64) - _TOKEN_BITS))
                tokens += len(grams)
            null = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(low), pa.array(high), null, null], names=_SCAN_NAMES)
            if tokens > _SHARD_TOKENS:
                yield frequent()
                tokens = 0
        if tokens:
            yield frequent()

    return run


_SCAN_NAMES = ["doc_id", "n", "low", "high", "token", "count"]
_SCAN_SCHEMA = ", ".join(f"{x} long" for x in _SCAN_NAMES)


def _pack(words: int, percent: int, shards: int, groups: int, heavy):
    """Texts of class representatives to packed shingles by shard, or by group of shards where there are many.

    A row holds, for one shard: documents (id, size, light shingles, shingles here) and the shingles.
    Shingles of a prefix that heavy ones are needed for leave as finished postings, at shard -1.
    """

    def run(batches):
        tokens, order = heavy.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows, parts, ready, held = [], [], [], 0
            for row, grams in shingle_arrays(batch.column(1), words):
                n = len(grams)
                if not n:
                    continue
                grams = np.unique(grams >> (np.uint64(64) - _TOKEN_BITS)) if n > 1 else grams >> (np.uint64(64) - _TOKEN_BITS)
                light = grams
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, grams), len(tokens) - 1)
                    is_heavy = tokens[at] == grams
                    if is_heavy.any():
                        light = grams[~is_heavy]
                        need = _prefix(n, percent) - len(light)
                        if need > 0:
                            mine = np.sort(order[at[is_heavy]])[:need]
                            ready.append((ids[row], n, len(light), mine))
                if len(light):
                    rows.append((ids[row], n, len(light)))
                    parts.append(light)
                held += len(light)
                if held >= _SHARD_TOKENS // 4:
                    yield from _shards(rows, parts, shards, groups)
                    rows, parts, held = [], [], 0
            if parts:
                yield from _shards(rows, parts, shards, groups)
            for first in range(0, len(ready), 4096):
                some = ready[first : first + 4096]
                places = np.concatenate([np.arange(x[2] + 1, x[2] + 1 + len(x[3])) for x in some])
                counts = [len(x[3]) for x in some]
                # The order's value of a heavy token names it: order values are distinct.
                posted = np.concatenate([x[3] for x in some]).astype(np.uint64) | np.uint64(1 << 62)
                yield _packed(-1 - int(some[0][0]) % shards, np.repeat([x[0] for x in some], counts), np.repeat([x[1] for x in some], counts), places, np.zeros(0), posted.tobytes())

    return run


_PACK_SCHEMA = "shard int, docs binary, sizes binary, light binary, runs binary, tokens binary"


def _packed(key: int, docs, sizes, light, runs, tokens: bytes) -> pa.RecordBatch:
    cells = [np.asarray(docs, np.int64), np.asarray(sizes, np.int32), np.asarray(light, np.int32), np.asarray(runs, np.int32)]
    return pa.RecordBatch.from_arrays(
        [pa.array([key], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells), pa.array([tokens], pa.binary())],
        names=["shard", "docs", "sizes", "light", "runs", "tokens"],
    )


def _shards(rows, parts, shards: int, groups: int):
    lengths = np.array([len(x) for x in parts])
    docs = np.repeat(np.arange(len(parts)), lengths)
    tokens = np.concatenate(parts)
    ids, sizes, light = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    shard = (mix64(tokens) % np.uint64(shards) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    tokens, docs, shard = tokens[order], docs[order], shard[order]
    cuts = np.searchsorted(shard, np.arange(groups + 1))
    for k in range(groups):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            d = docs[a:b]
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            own = d[first]
            six = tokens[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            yield _packed(k, ids[own], sizes[own], light[own], np.diff(np.r_[first, b - a]), six)


def _six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _cells(table: pa.Table) -> list[list[bytes]]:
    return [table.column(k).to_pylist() for k in range(1, 6)]


def _spread(shards: int, by_doc: bool):
    """Rows of packed shingles by group of shards to rows by shard (or, of shared ones, by block of documents).

    Runs over a partition as it comes, holding some million shingles, so that rows by shard are as long
    as if one task had packed them all.
    """

    def run(batches):
        held: dict[int, list] = {}
        counts: dict[int, int] = {}

        def flush(key: int):
            cells = [list(c) for c in zip(*held.pop(key))]
            counts.pop(key)
            docs, sizes, light, runs = (np.concatenate([np.frombuffer(x, kind) for x in cells[c]]) for c, kind in enumerate((np.int64, np.int32, np.int32, np.int32)))
            tokens = np.concatenate([np.frombuffer(x, np.uint64) if by_doc else _six(x) for x in cells[4]])
            docs, sizes, light = (np.repeat(x, runs) for x in (docs, sizes, light))
            shard = (mix64(docs.view(np.uint64) if by_doc else tokens) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((docs, shard))
            docs, sizes, light, tokens, shard = (x[order] for x in (docs, sizes, light, tokens, shard))
            cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                d = docs[a:b]
                at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                raw = tokens[a:b]
                raw = raw.tobytes() if by_doc else raw.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                yield _packed(int(shard[a]), d[at], sizes[a:b][at], light[a:b][at], np.diff(np.r_[at, b - a]), raw)

        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column(0)[row].as_py()
                if key < 0:  # finished postings
                    yield batch.slice(row, 1)
                    continue
                cells = [batch.column(c)[row].as_py() for c in range(1, 6)]
                held.setdefault(key, []).append(cells)
                counts[key] = counts.get(key, 0) + len(cells[4]) // (8 if by_doc else 6)
                while sum(counts.values()) > _SHARD_TOKENS:
                    yield from flush(max(counts, key=counts.get))
        for key in list(held):
            yield from flush(key)

    return run


def _by_shard(packed: DataFrame, shards: int, by_doc: bool) -> DataFrame:
    """Packed rows by shard.  Beyond _FANOUT shards they come by group of shards and are dealt out in a second step.

    A task that packs for every shard at once would otherwise write rows of single shingles.
    """
    if shards <= _FANOUT:
        return packed
    return packed.repartition(_FANOUT, "shard").mapInArrow(lean(_spread(shards, by_doc)), _PACK_SCHEMA)


def _count(blocks: int, groups: int):
    """A shard's shingles to those that several documents share, packed by block, or group of blocks, of documents."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column(0)[0].as_py()
        if key < 0:
            return table
        docs, sizes, light, runs, raw = _cells(table)
        runs = np.concatenate([np.frombuffer(x, np.int32) for x in runs])
        docs, sizes, light = (np.repeat(np.concatenate([np.frombuffer(x, kind) for x in col]), runs) for col, kind in ((docs, np.int64), (sizes, np.int32), (light, np.int32)))
        tokens = np.concatenate([_six(x) for x in raw])
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        counts = np.diff(np.r_[first, len(tokens)])
        df = np.repeat(counts, counts)
        shared = df > 1
        if not shared.any():
            return table.slice(0, 0)
        order, tokens, df = order[shared], tokens[shared], df[shared]
        docs, sizes, light = docs[order], sizes[order], light[order]
        # An order value: frequency (16 bits, saturated) before the shingle's own bits.
        value = (np.minimum(df, 0xFFFF).astype(np.uint64) << _TOKEN_BITS) | tokens
        block = (mix64(docs.view(np.uint64)) % np.uint64(blocks) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((docs, block))
        docs, sizes, light, value, block = docs[order], sizes[order], light[order], value[order], block[order]
        cuts = np.searchsorted(block, np.arange(groups + 1))
        out = []
        for k in range(groups):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                d = docs[a:b]
                at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                out.append((k, d[at].tobytes(), sizes[a:b][at].tobytes(), light[a:b][at].tobytes(), np.diff(np.r_[at, b - a]).astype(np.int32).tobytes(), value[a:b].tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), table.schema)], schema=table.schema)

    return run


_POST_SCHEMA = "token long, doc long, n int, place int"


def _postings(percent: int):
    """A block's shared shingles to the prefix places under order 1."""
    schema = pa.schema([("token", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        key = table.column(0)[0].as_py()
        docs, sizes, light, runs, raw = _cells(table)
        docs, sizes, light = (np.concatenate([np.frombuffer(x, kind) for x in col]) for col, kind in ((docs, np.int64), (sizes, np.int32), (light, np.int32)))
        value = np.concatenate([np.frombuffer(x, np.uint64) for x in raw])
        if key < 0:
            return pa.Table.from_arrays([pa.array(value.view(np.int64)), pa.array(docs), pa.array(sizes), pa.array(light)], schema=schema)
        runs = np.concatenate([np.frombuffer(x, np.int32) for x in runs])
        docs, sizes, light = (np.repeat(x, runs) for x in (docs, sizes, light))
        order = np.lexsort((value, docs))
        docs, sizes, light, value = docs[order], sizes[order], light[order], value[order]
        first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        counts = np.diff(np.r_[first, len(docs)])
        alone = light - np.repeat(counts, counts)
        place = alone + np.arange(len(docs)) - np.repeat(first, counts) + 1
        keep = place <= _prefix(sizes, percent)
        return pa.Table.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(docs[keep]), pa.array(sizes[keep]), pa.array(place[keep].astype(np.int32))], schema=schema)

    return run


def _sets(words: int, percent: int):
    """Texts to full shingle sets and the prefixes under the two random orders."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[list] = [[] for _ in range(5)]
            held = 0
            for row, grams in shingle_arrays(batch.column(1), words):
                cells = [ids[row], len(grams)]
                for seed in _ORDER_SEEDS:
                    keys = mix64(grams ^ np.uint64(seed))
                    p = min(_prefix(len(grams), percent), len(keys))
                    cells.append(np.sort(np.partition(keys, p - 1)[:p] if p < len(keys) else keys).view(np.int64))
                for column, cell in zip(out, [*cells, grams.tobytes()]):
                    column.append(cell)
                held += len(grams)
                if held > 1_000_000:
                    yield _set_batch(out)
                    out, held = [[] for _ in range(5)], 0
            if out[0]:
                yield _set_batch(out)

    return run


def _set_batch(out) -> pa.RecordBatch:
    many = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], many), pa.array(out[3], many), pa.array(out[4], pa.binary())],
        names=["doc", "n", "order2", "order3", "grams"],
    )


def _verify(percent: int):
    """Pairs with both sets to those pairs that reach the threshold."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int((y[at] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _need(percent: int) -> str:
    """Overlap that a pair of sizes na, nb needs."""
    return f"((na + nb) * {percent} + {99 + percent}) div {100 + percent}"


def ngram_jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by shingle sets of Jaccard similarity >= percent / 100.

    Returns one row per input row: doc_id, n_shingles (size of the set), class_id (smallest id with
    an equal set), component_id (smallest id reachable over links, itself included).  Shingles stand
    for their 64-bit hashes in counts and comparisons, sets for 128 bits when they are taken as equal.

    Edge cases: a null or empty text, or one of white space only, has an empty set, links with
    nothing and is its own component; a text with fewer words than a shingle has its whole sequence
    as its one shingle; a row with a null id keeps its size, takes no part in links and gets null
    class_id and component_id; rows that repeat an id are one document whose links are pooled
    (each returns as a row of its own); an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "ngram-join")
    sc = spark.sparkContext
    texts = docs.select(_column(id_col).cast("long").alias("doc_id"), _column(text_col).cast("string").alias("text"))

    scan = scratch.save(texts.mapInArrow(lean(_scan(words)), _SCAN_SCHEMA), "scan")
    sized = scan.where("n is not null").select("doc_id", "n", "low", "high")
    full = sized.where("n > 0 and doc_id is not null")
    classes = scratch.save(full.groupBy("n", "low", "high").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("docs")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0

    frequent = scan.where("token is not null").groupBy("token").agg(F.sum("count").alias("count"))
    # At most _HEAVY_SHARE rows pass, each stands for that share of all shingles of all rows.
    floor = (full.agg(F.sum("n")).first()[0] or 0) // _HEAVY_SHARE
    heavy = frequent.where(F.col("count") >= max(64, floor)).toArrow()
    tokens = heavy.column("token").to_numpy().astype(np.uint64)
    counts = heavy.column("count").to_numpy().astype(np.int64)
    rank = np.empty(len(tokens), np.uint64)
    rank[np.lexsort((tokens, counts))] = np.arange(len(tokens), dtype=np.uint64)
    by_token = np.argsort(tokens)
    heavy_b = sc.broadcast((tokens[by_token], rank[by_token]))

    heads = classes.select(F.col("class_id").alias("doc_id")).distinct()
    others = sized.where("n > 0 and doc_id is not null").select("doc_id").join(heads, "doc_id", "left_anti").distinct()
    shards = max(64, -(-total // _SHARD_TOKENS))
    kept = join_on_id(texts.where("doc_id is not null"), others, "doc_id", "left_anti")
    groups = min(shards, _FANOUT)
    packed = _by_shard(kept.mapInArrow(lean(_pack(words, percent, shards, groups, heavy_b)), _PACK_SCHEMA), shards, False)
    packed = _by_shard(packed.groupBy("shard").applyInArrow(lean_group(_count(shards, groups)), _PACK_SCHEMA), shards, True)
    posts = scratch.save(packed.groupBy("shard").applyInArrow(lean_group(_postings(percent)), _POST_SCHEMA), "postings")

    # First pass: each class to one hub, the class in whose prefix the shared token stands foremost.
    hubs = posts.groupBy("token").agg(F.count("*").alias("docs"), F.min_by(F.struct(F.col("doc").alias("hub"), "n", "place"), F.struct("place", "doc")).alias("h")).where("docs > 1")
    shared = scratch.save(_by_key(posts, scratch.save(hubs, "hubs")), "shared")
    near = (
        shared.selectExpr("doc", "h.hub hub", "n na", "place pa", "h.n nb", "h.place pb")
        .where("doc <> hub")
        .withColumn("need", F.expr(_need(percent)))
        .where("need <= least(na, nb) and pa <= na - need + 1 and pb <= nb - need + 1")
        .groupBy("doc", "hub").agg(F.count("*").alias("c"))
        .groupBy("doc").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("hub"))
        .select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()
    )
    near = scratch.save(near, "hub-pairs")
    members = scratch.save(shared.select("doc").distinct(), "members")
    sets = scratch.save(
        join_on_id(kept, members.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").mapInArrow(lean(_sets(words, percent)), "doc long, n int, order2 array<long>, order3 array<long>, grams binary"),
        "sets",
    )
    links = scratch.save(_verified(near, sets, percent), "links1")
    part = connected_components(links, scratch, rounds=1, settle=False)

    # Second pass: whatever is left between components, exactly.
    parts = members.join(part.withColumnRenamed("id", "doc"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("part"))
    placed = scratch.save(_with(shared.select("token", "doc", "n", "place"), scratch.save(parts, "parts"), "doc", "token"), "placed")
    spans = placed.groupBy("token", "part").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.max_by(F.struct("part", "c"), F.struct("c", "part")).alias("most"), F.count("*").alias("parts"), F.sum("c").alias("docs")
    )
    # A token's pairs are dealt out by the second document, about _TASK_PAIRS to a share.
    pairs_of = (F.col("docs") - F.col("most.c")).cast("double") * F.col("docs")
    spans = spans.where("parts > 1").select("token", "docs", F.col("most.part").alias("major"), F.least("docs", F.ceil(pairs_of / _TASK_PAIRS)).cast("int").alias("shares"))
    placed = _by_key(placed, scratch.save(spans, "spans"))
    x = placed.where("part <> major").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).selectExpr("token", "share", "doc a", "n na", "place pa", "part qa")
    y = placed.withColumn("share", F.pmod(F.xxhash64("doc"), F.col("shares")).cast("int")).selectExpr("token", "share", "doc b", "n nb", "place pb", "part qb", "major")
    left = (
        x.join(y, ["token", "share"])
        .where("qa <> qb and (qb = major or a < b)")
        .where(f"{_need(percent)} <= least(na, nb) and pa <= na - ({_need(percent)}) + 1 and pb <= nb - ({_need(percent)}) + 1")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    left = scratch.save(left, "rest-pairs")
    links = links.union(scratch.save(_verified(left, sets, percent), "links2"))
    part = connected_components(links, scratch).withColumnRenamed("id", "class_id")

    # Documents with the component of their class; a class may hold a large share of them.
    whole = classes.join(part, "class_id", "left").select("n", "low", "high", "docs", "class_id", F.coalesce("component", "class_id").alias("component"))
    found = _by_key(full, scratch.save(whole, "whole"), ("n", "low", "high")).select("doc_id", "class_id", "component")
    # Rows of one id with different texts pool their links, so their classes meet over the id.
    found = _pool(found, scratch)
    found = scratch.save(found, "found")
    out = sized.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    for used in (near, left, sets, posts, shared):
        scratch.drop(used)
    return out.select(
        "doc_id", "n_shingles",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def _column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, by_row: bool = False) -> DataFrame:
    """The rows of docs, all columns, with one document of each group of near copies: its smallest id.

    Rows that repeat an id are one document, of which the first by text stays; rows with a null id stay.
    With by_row every row is a document of its own, also those that repeat an id or have none: of a
    group the row with the smallest id (null last, then by text) stays.  Null and empty texts have no
    copies; an empty table gives no rows; columns of any other name pass unchanged.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    every = [_column(c) for c in docs.columns]
    if by_row and not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        # Keys that rise with the id; written once, so that they do not change between reads.
        row = "__row"
        while row in docs.columns:
            row += "_"
        keyed = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text", *(F.xxhash64(c) for c in every)).withColumn(row, F.monotonically_increasing_id())
        keyed = scratch.save(keyed, "keyed")
        classes = ngram_jaccard_classes(keyed, id_col=row, words=words, percent=percent)
        gone = scratch.save(classes.where("doc_id <> component_id").select(F.col("doc_id").alias(row)), "gone")
        return join_on_id(keyed, gone, row, "left_anti").select(*every)
    classes = scratch.save(ngram_jaccard_classes(docs, words=words, percent=percent).select("doc_id", "component_id"), "classes")
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    kept = join_on_id(docs, gone, "doc_id", "left_anti")
    if classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    number = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    whole = F.struct(*(_column(c).alias(n) for c, n in number.items()))
    one = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(whole, F.struct("text", *[F.xxhash64(c) for c in every])).alias("d"))
    return one.select(*(F.col(f"d.{n}").alias(c) for c, n in number.items())).unionByName(kept.where("doc_id is null").select(*every))


def _pool(found: DataFrame, scratch: Scratch) -> DataFrame:
    per_id = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component").alias("component"), F.max("component").alias("other"))
    per_id = scratch.save(per_id, "per-id")
    split = found.join(per_id.where("component <> other").select("doc_id", F.col("component").alias("low")), "doc_id").where("component <> low").select(F.col("component").alias("a"), F.col("low").alias("b"))
    if split.isEmpty():
        return per_id.select("doc_id", "class_id", "component")
    joined = connected_components(split, scratch).select(F.col("id").alias("component"), F.col("component").alias("root"))
    return per_id.join(joined, "component", "left").select("doc_id", "class_id", F.coalesce("root", "component").alias("component"))


def _by_key(rows: DataFrame, facts: DataFrame, on: tuple[str, ...] = ("token",)) -> DataFrame:
    """Rows with what is known of their key (facts: the key, docs, the number of its rows, and more).

    Keys of many rows are joined by broadcast, so their rows stay where they are: at most _HOT_KEYS of
    them exist, since each holds that share of all rows.  The others are shuffled.
    """
    most = max(_HOT_ROWS, rows.count() // _HOT_KEYS)
    hot = facts.where(F.col("docs") > most)
    rest = rows.join(F.broadcast(hot.select(*on)), list(on), "left_anti")
    return rows.join(F.broadcast(hot), list(on)).unionByName(rest.join(facts.where(F.col("docs") <= most), list(on)))


def _with(pairs: DataFrame, values: DataFrame, key: str, other: str) -> DataFrame:
    """Pairs (a written table) joined with the values of one side; the values of an id in many pairs are sent in several copies.

    At most _HOT_KEYS ids have copies, and all copies together are no more than that number.
    """
    most = max(_HOT_ROWS, pairs.count() // _HOT_KEYS)
    hot = F.broadcast(pairs.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("copies")).where("copies > 1"))
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(hot, key, "left").withColumn("copy", F.pmod(F.xxhash64(other), copies).cast("int")).drop("copies")
    sent = values.join(hot, key, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return dealt.join(sent, [key, "copy"]).drop("copy")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a written table) that pass orders 2 and 3 and then reach the threshold on their full sets."""
    passed = _with(_with(pairs, sets.selectExpr("doc a", "order2 a2", "order3 a3"), "a", "b"), sets.selectExpr("doc b", "order2 b2", "order3 b3"), "b", "a")
    passed = passed.where("arrays_overlap(a2, b2) and arrays_overlap(a3, b3)").select("a", "b")
    passed = Scratch(pairs.sparkSession, "ngram-passed").save(passed, "passed")
    whole = _with(_with(passed, sets.selectExpr("doc a", "grams x"), "a", "b"), sets.selectExpr("doc b", "grams y"), "b", "a")
    return whole.select("a", "b", "x", "y").mapInArrow(lean(_verify(percent)), "a long, b long").distinct()
