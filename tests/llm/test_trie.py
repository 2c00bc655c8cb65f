"""The prefix trie against plain Python, on small tables with odd rows and on the supplied ones."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import zlib

import pyarrow.parquet as pq
import pytest

ROOT = "/root/testdata"
SCHEMA = "conv_id long, turn long, role string, text string, depth string, docs int, id long"


def brute(rows) -> dict:
    """(conv_id, depth) -> the other columns, from all prefixes of all rebuilt conversations."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, role, code, (role, text)))
    own = {c: [t[4] for t in sorted(v)] for c, v in own.items()}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return {
        (m[0], len(p)): (members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    }


def found(df) -> dict:
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def odd_rows():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(200, 260), 1137, 5000, -300, -317, 9_000_000_000]:
        for t in range(rng.choice((1, 2, 3, 8, 9))):
            rows.append((c, t, rng.choice(("user", "assistant", None)), rng.choice(("a", "bé", "", None, "a long text 𝄞"))))
    rows += [(300 + i, t, "user", f"t{t}") for i in range(50) for t in range(20 + i % 2)]  # copies, and one turn more
    rows += [(c, None, "system", "s") for c in (1, 2, 201)] + [(c, None, "system", "r") for c in (2, 201)]
    rows += [(3, 1, "user", "a")] * 3 + [(None, 1, "user", "x"), (410, 0, "a", "bc"), (411, 0, "ab", "c")]
    rows += [(500, t, "user", "deep") for t in range(300)] + [(501 + i, t, "user", "deep") for i in range(4) for t in range(295 + i)]
    return rows


@pytest.mark.parametrize("local", [1, 12, 4096])
def test_trie_equals_brute_force(spark, local):
    from gridloom.llm.prefix_trie import trie_digest

    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1, 7) for r in rows], SCHEMA).repartition(5)
    assert found(trie_digest(df, local)) == brute(rows)


def test_trie_of_nothing(spark):
    from gridloom.llm.prefix_trie import trie_digest

    none = spark.createDataFrame([], SCHEMA)
    assert trie_digest(none).count() == 0
    assert found(trie_digest(spark.createDataFrame([(137, 0, "user", "x", "", 1, 1)], SCHEMA))) == brute([(137, 0, "user", "x")])


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the supplied tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_trie_query(spark, sf):
    from gridloom.llm.queries import queries

    rows = [tuple(r.values()) for r in pq.read_table(f"{ROOT}/{sf}/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    assert found(queries()["op12_conversation_prefix_trie"](spark, f"{ROOT}/{sf}")) == brute(rows)
