"""I-Match fingerprints: hashes of random subsets of a lexicon of middling document frequency.

Terms are lower-cased words.  Their document frequencies are counted over all texts, and the lexicon
keeps those within a band: neither in more than one text in `common`, nor in fewer than one in
`rare`.  Of a text only its distinct lexicon terms count, sorted; the lexicon is dealt at random into
128 subsets, and each subset's terms in the text are hashed on their own, so that an edit changes
only the subsets whose terms it touches.  Long texts would have terms of an edit in every subset,
so the lexicon is also thinned by halves: a fingerprint holds the 128 hashes at the first two
levels at which no more than 128 of the text's terms are left.

The lexicon has a proven bound: the texts' distinct terms add up to some total, and no more than
`most` terms can each be in total / most texts or more, so the band starts there if that is higher.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import Scratch, lean, prepare
from .wordhash import _all_hashes, mix64, text_chunks

SUBSETS = 128
_FEW = 8  # a text with fewer lexicon terms is told by all its words
_HELD = 1_000_000
_RANGES = 50_000
_THIN, _DEAL, _VALUE = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _term_sets(column: pa.Array):
    """Sorted distinct word hashes of every text; a null counts as empty."""
    for first, end, data, offsets in text_chunks(column):
        hashes, index = _all_hashes(data, offsets)
        for row in range(end - first):
            yield np.unique(hashes[int(index[row]) : int(index[row + 1])])


def _frequencies(batches):
    """Texts to (term, texts) by task, and once a batch the texts, their bytes and their distinct terms in all."""
    terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, size = [], 0

    def merged():
        every = np.concatenate([terms, *held])
        weight = np.concatenate([counts, np.ones(len(every) - len(counts), np.int64)])
        order = np.argsort(every, kind="stable")
        every, weight = every[order], weight[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        return every[first], np.add.reduceat(weight, first) if len(first) else weight

    def told():
        return pa.RecordBatch.from_arrays([pa.nulls(len(terms), pa.int32()), pa.array(terms.view(np.int64)), pa.array(counts)], names=["total", "term", "n"])

    for batch in batches:
        every = 0
        for found in _term_sets(batch.column(0)):
            held.append(found)
            size += len(found)
            every += len(found)
            if size > _HELD:
                terms, counts = merged()
                held, size = [], 0
                if len(terms) > _HELD:
                    yield told()
                    terms, counts = terms[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.nulls(3, pa.int64()), pa.array([batch.num_rows, batch.column(0).nbytes, every], pa.int64())], names=["total", "term", "n"])
    terms, counts = merged()
    if len(terms):
        yield told()


class Lexicon:
    """Sorted hashes of the terms of a band."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)

    def of(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms) or not len(terms):
            return terms[:0]
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return terms[self.terms[at] == terms]


def lexicon(texts: DataFrame, scratch: Scratch, rare: int = 20_000, common: int = 10, most: int = 2_000_000) -> tuple[Lexicon, int, int]:
    """The lexicon of a column of texts, the number of texts, and their bytes."""
    counted = texts.mapInArrow(lean(_frequencies), "total int, term long, n long").groupBy("total", "term").agg(F.sum("n").alias("n"))
    counted = scratch.save(counted.where("n > 1 or total is not null"), "frequencies")
    totals = {r["total"]: r["n"] for r in counted.where("total is not null").collect()}  # three rows
    texts_, size, every = (totals.get(k, 0) for k in range(3))
    low = max(2, -(-texts_ // rare), -(-every // most))
    high = max(low, texts_ // common)
    band = counted.where(F.col("total").isNull() & F.col("n").between(low, high)).select("term").toArrow()
    return Lexicon(band.column("term").to_numpy().astype(np.int64).view(np.uint64)), texts_, size


def _hashes(terms: np.ndarray, level: int) -> np.ndarray:
    """A 16-bit hash of each subset's terms at a level; 0 for a subset without terms."""
    terms = terms[(mix64(terms ^ _THIN) & np.uint64((1 << level) - 1)) == 0]
    out = np.zeros(SUBSETS, np.uint16)
    if len(terms):
        subset = (mix64(terms ^ _DEAL) % np.uint64(SUBSETS)).astype(np.int64)
        order = np.argsort(subset, kind="stable")  # terms stay sorted within a subset
        subset = subset[order]
        first = np.flatnonzero(np.r_[True, subset[1:] != subset[:-1]])
        sums = mix64(np.add.reduceat(mix64(terms[order] ^ _VALUE), first))
        out[subset[first]] = np.maximum(sums >> np.uint64(48), 1).astype(np.uint16)
    return out


class Print:
    """The fingerprint of one text: a level and the hashes at it and the next one; of a text without words, its digest."""

    def __init__(self, level: int, hashes: tuple[np.ndarray, ...], digest: str = ""):
        self.level, self.hashes, self.digest = level, hashes, digest

    @classmethod
    def of(cls, words: np.ndarray, text: str, lex: Lexicon) -> Print:
        if not len(words):
            return cls(-1, (), hashlib.sha256(text.encode()).hexdigest())
        terms = lex.of(words)
        if len(terms) < _FEW:
            terms = words
        thin, level = mix64(terms ^ _THIN), 0
        while np.count_nonzero((thin & np.uint64((1 << level) - 1)) == 0) > SUBSETS:
            level += 1
        return cls(level, (_hashes(terms, level), _hashes(terms, level + 1)))

    def __str__(self) -> str:
        if not self.hashes:
            return f"-:{self.digest}"
        return f"{self.level}:" + ".".join(base64.b64encode(h.astype("<u2").tobytes()).decode() for h in self.hashes)

    @classmethod
    def read(cls, written: str) -> Print:
        level, _, rest = written.partition(":")
        if level == "-":
            return cls(-1, (), rest)
        return cls(int(level), tuple(np.frombuffer(base64.b64decode(h), "<u2") for h in rest.split(".")))


def likeness(a: Print, b: Print) -> float:
    """The share of equal hashes among the subsets that either text has terms in, at the first level that both have."""
    if not a.hashes or not b.hashes:
        return float(a.hashes == b.hashes and a.digest == b.digest)
    level = max(a.level, b.level)
    if level - min(a.level, b.level) > 1:
        return 0.0
    x, y = a.hashes[level - a.level], b.hashes[level - b.level]
    there = int(np.count_nonzero(x | y))
    return float(np.count_nonzero((x == y) & (x > 0)) / there) if there else float(str(a) == str(b))


def _prints(texts: list[str], lex: Lexicon) -> list[Print]:
    return [Print.of(words, text, lex) for words, text in zip(_term_sets(pa.array(texts, pa.large_string())), texts)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **band: int) -> DataFrame:
    """(doc_id, fingerprint) of every row, in one pass once the lexicon is known.

    A null text counts as empty; texts without words are told by their digest; equal texts have equal
    fingerprints; rows with null or repeated ids return as they came; an empty table gives no rows;
    other columns are ignored.  `band` may set rare, common and most.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sent = spark.sparkContext.broadcast(lexicon(texts.select("text"), Scratch(spark, "imatch"), **band)[0])

    def run(batches):
        for batch in batches:
            found = _prints(batch.column(1).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(p) for p in found], pa.string())], names=["doc_id", "fingerprint"])

    return texts.mapInArrow(lean(run), "doc_id long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(sent):
    """Sorted texts of a range, the first one of the next range last, to the rows of the digest."""

    def rows_of(waiting, prints, lex):
        """Rows of all but the last of the texts that follow each other."""
        edited = [text[: len(text) - len(text) // 2] + after[: len(text) // 2] for (_, text), (_, after) in zip(waiting, waiting[1:])]
        changed = _prints(edited, lex)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = [
            [doc_id for doc_id, _ in waiting[:-1]], [len(text) for _, text in waiting[:-1]], [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            [str(p) for p in prints[:-1]], [str(p) for p in changed], [likeness(p, q) for p, q in zip(prints, changed)], [likeness(p, q) for p, q in zip(prints, prints[1:])],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.partition(" ")[0] for f in _OUT.split(", ")])

    def run(batches):
        lex = sent.value
        last, last_print, over = [], [], False
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ahead = batch.column(2).to_pylist()
            if over:
                continue  # rows equal to the first one of the next range
            cut = ahead.index(True) + 1 if True in ahead else len(texts)
            over = True in ahead
            waiting = last + list(zip(batch.column(0).to_pylist()[:cut], texts[:cut]))
            prints = last_print + _prints(texts[:cut], lex)
            if len(waiting) > 1:
                yield rows_of(waiting, prints, lex)
            last, last_print = waiting[-1:], prints[-1:]

    return run


def imatch_digest(docs: DataFrame, range_bytes: int = 32_000_000, **band: int) -> DataFrame:
    """Every text with the text that replaces its last half by the beginning of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, the
    likenesses of the text's fingerprint to that of the edited text and to that of the next document.
    Documents follow each other by doc_id, rows without an id first, rows of one id by a hash of the
    text; the first one follows the last (and itself, if it is alone).  A null text counts as empty; an empty
    table gives no rows; other columns are ignored.

    Texts are shuffled once, to ranges of ids of about range_bytes (more beyond 50,000 ranges); the first text of each range also goes
    to the range before it.  The rows of one id stay in one range, which is read as a stream.
    """
    spark = docs.sparkSession
    prepare(spark)
    sc = spark.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lex, n, size = lexicon(texts.select("text"), Scratch(spark, "imatch"), **band)
    if not n:
        return spark.createDataFrame([], _OUT)
    ranges = max(2 * sc.defaultParallelism, min(_RANGES, -(-size // range_bytes)))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = texts.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))  # one long a range

    @F.pandas_udf(IntegerType())
    def range_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, doc_id.to_numpy(np.int64), side="right").astype(np.int32))

    smallest = F.lit(-(2**63)).cast("long")
    keyed = texts.withColumns({"at": range_of(F.coalesce("doc_id", smallest)), "key": F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", smallest).alias("id"), F.xxhash64("text").alias("hash"))})
    heads = sorted(keyed.groupBy("at").agg(F.min("key").alias("key")).collect())  # one row a range
    before = [(row["key"]["known"], row["key"]["id"], row["key"]["hash"], heads[i - 1]["at"]) for i, row in enumerate(heads)]
    first = spark.createDataFrame(before, "known boolean, id long, hash long, before int").select(F.struct("known", "id", "hash").alias("key"), "before")
    dealt = keyed.join(F.broadcast(first), "key", "left")
    place = F.array(F.struct(F.col("at"), F.lit(False).alias("ahead")))
    place = F.when(F.col("before").isNull(), place).otherwise(F.concat(place, F.array(F.struct(F.col("before").alias("at"), F.lit(True).alias("ahead")))))
    dealt = dealt.select("doc_id", "text", F.inline(place), F.col("key.hash").alias("hash"))
    dealt = dealt.repartitionById(len(bounds) + 1, "at").sortWithinPartitions("ahead", F.col("doc_id").asc_nulls_first(), "hash")
    return dealt.select("doc_id", "text", "ahead").mapInArrow(lean(_neighbours(sc.broadcast(lex))), _OUT)


def likeness_of(a: str, b: str) -> float:
    """likeness() of two written fingerprints."""
    return likeness(Print.read(a), Print.read(b))
