"""I-Match fingerprints against term sets in plain Python."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = "/root/testdata"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, at int, key string, ahead boolean, hash long"


def words(text: str) -> set[str]:
    return {w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")}


def check(got, docs, rare=20_000, common=10) -> None:
    """docs: (doc_id, text) in order.  All columns, the lexicon and every subset hash against sets of words."""
    from gridloom.llm.imatch import SUBSETS, _DEAL, _THIN, Print, likeness_of
    from gridloom.llm.wordhash import mix64, word_hashes

    docs = [(i, t or "") for i, t in docs]
    after = [*docs[1:], docs[0]]
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for (_, t), (_, u) in zip(docs, after)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = collections.Counter((i, len(t), sha(e)) for (i, t), e in zip(docs, edited))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    df = collections.Counter(w for _, t in docs for w in words(t))
    low = max(2, -(-len(docs) // rare), -(-sum(df.values()) // 2_000_000))
    high = max(low, len(docs) // common)
    band = {w for w, n in df.items() if low <= n <= high}
    number = {}

    def hash_of(word):
        if word not in number:
            raw = np.frombuffer(word.encode(), np.uint8)
            number[word] = word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
        return number[word]

    meaning, seen = {}, 0
    rows = collections.defaultdict(list)
    for r in got:
        rows[r.doc_id, r.edited_sha256].append(r)
    for (i, t), e, (_, u) in zip(docs, edited, after):
        r = rows[i, sha(e)].pop()
        for text, written in ((t, r.fingerprint), (e, r.edited_fingerprint)):
            there = words(text)
            if not there:
                assert written == f"-:{sha(text)}"
                continue
            terms = there & band if len(there & band) >= 8 else there
            keys = np.array([hash_of(w) for w in sorted(terms)], np.uint64)
            thin, deal = mix64(keys ^ _THIN), mix64(keys ^ _DEAL) % np.uint64(SUBSETS)
            p = Print.read(written)
            level = next(k for k in range(64) if sum(int(x) % (1 << k) == 0 for x in thin) <= 128)
            assert p.level == level
            for step, hashes in enumerate(p.hashes):
                groups = collections.defaultdict(set)
                for w, x, s in zip(sorted(terms), thin, deal):
                    if int(x) % (1 << (level + step)) == 0:
                        groups[int(s)].add(w)
                for s in range(SUBSETS):
                    assert bool(hashes[s]) == bool(groups[s])
                    if groups[s]:
                        meaning.setdefault(frozenset(groups[s]), set()).add(int(hashes[s]))
                        seen += 1
        assert r.near_edited == likeness_of(r.fingerprint, r.edited_fingerprint) and 0 <= r.near_next <= 1
        assert t != u or r.near_next == 1
    assert all(len(v) == 1 for v in meaning.values())  # equal terms, equal hash; others nearly always another one
    if len(meaning) > 2000:
        assert len({next(iter(v)) for v in meaning.values()}) > 0.9 * 65535 * (1 - np.exp(-len(meaning) / 65535))


def in_order(rows):
    from pyspark.sql import SparkSession, functions as F

    df = SparkSession.getActiveSession().createDataFrame(rows, "doc_id long, text string")
    return [(r.doc_id, r.text) for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]


def odd_rows():
    rng = random.Random(2)
    vocabulary = [f"wörd{i}" if i % 3 else f"Term{i}" for i in range(400)]
    rows = [(i * 7, " ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 3, 30, 400))))) for i in range(150)]
    rows += [(500_000, None), (500_001, ""), (500_002, " \n"), (500_003, "\U0001d11e" * 9), (None, "no id a"), (None, "no id b"), (-5, "x " * 50_000)]
    rows += [(600_000 + i, rows[20][1]) for i in range(9)] + [(700_000, "same words here")] * 40 + [(2**62, "far away")]
    return rows


@pytest.mark.parametrize("range_bytes", [200, 100_000])
def test_fingerprints_equal_term_sets(spark, range_bytes):
    from gridloom.llm.imatch import fingerprints, imatch_digest

    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "k", False, 2) for r in rows], SCHEMA).repartition(5)
    got = imatch_digest(df, range_bytes, common=3).collect()
    check(got, in_order(rows), common=3)
    plain = collections.Counter((r.doc_id, r.fingerprint) for r in fingerprints(df, common=3).collect())
    assert plain == collections.Counter((r.doc_id, r.fingerprint) for r in got)
    by_text = collections.defaultdict(set)
    for i, t in rows:
        by_text[t or ""] |= {f for (j, f) in plain if j == i and i is not None}
    assert all(len(v) == 1 for t, v in by_text.items() if not t.startswith("no id"))


def test_few_documents(spark):
    from gridloom.llm.imatch import imatch_digest

    assert imatch_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = imatch_digest(spark.createDataFrame([(3, "alone in here", 1, "", True, 1)], SCHEMA)).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in one] == [(3, 1.0, hashlib.sha256(b"alone in h"[:7] + b"alone ").hexdigest())]


def test_term_sets_of_any_slice():
    from gridloom.llm import imatch, wordhash

    text = "Ab cd ab\tee " * 900
    whole = next(imatch._term_sets(pa.array([text])))
    assert len(whole) == 3
    kept, wordhash._SLICE = wordhash._SLICE, 100
    try:
        assert (next(imatch._term_sets(pa.array([text]))) == whole).all()
    finally:
        wordhash._SLICE = kept


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the supplied tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_fingerprint_query(spark, sf):
    from gridloom.llm.queries import queries

    docs = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{ROOT}/{sf}/documents.parquet").select(["doc_id", "text"]).to_pylist())
    got = queries()["op11_imatch_fingerprints"](spark, f"{ROOT}/{sf}").collect()
    check(got, docs)
    # Half a text is more of a likeness than a neighbour, unless that is a copy.
    texts = dict(docs)
    long = [r for r in got if len(words(texts[r.doc_id])) >= 30 and r.near_next < 0.5]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95 and np.mean([r.near_edited for r in long]) > 0.1 > np.mean([r.near_next for r in long])
