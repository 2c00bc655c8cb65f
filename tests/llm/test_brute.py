"""Registered queries that SQL cannot state, and the pipeline, over whole small tables, against plain Python."""

from __future__ import annotations

import bisect
import collections
import hashlib
import math
import os
import re
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.test_edges import TOKENIZER, brute_components

ROOT = "/root/testdata"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the supplied tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def rows(sf: str, name: str) -> list[dict]:
    return pq.read_table(f"{ROOT}/{sf}/{name}.parquet").to_pylist()


def base_spans(text: str) -> list[tuple[int, str, int]]:
    spans = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


def entropy_only(text: str, base) -> list[tuple[int, int]]:
    """Spans of windows with enough entropy, each window counted anew."""
    from gridloom.llm.secrets import ALLOW, CLASSES, WINDOW

    allow, out = re.compile("|".join(f"(?:{x})" for x in ALLOW)), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW, text):
        if allow.fullmatch(m[0]):
            continue
        hit = np.zeros(len(m[0]) + 2, bool)
        for at in range(len(m[0]) - WINDOW + 1):
            part = m[0][at : at + WINDOW]
            h = -sum(c / WINDOW * math.log2(c / WINDOW) for c in collections.Counter(part).values())
            if any(set(part) <= alphabet and h >= limit - 1e-9 for _, alphabet, limit in CLASSES):
                hit[at + 1 : at + WINDOW + 1] = True
        edge = np.flatnonzero(hit[1:] != hit[:-1]) + m.start()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if not allow.fullmatch(text[a:b]) and not any(s <= a and b <= e for s, _, e in base):
                out.append((a, b))
    return out


def brute_pieces(docs) -> collections.Counter:
    from tokenizers import Tokenizer

    bpe, want = Tokenizer.from_file(TOKENIZER), collections.Counter()
    for doc_id, text in docs:
        ids = bpe.encode(text or "", add_special_tokens=False).ids + [2]
        at, size, piece = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want[doc_id, piece, at, size, zlib.crc32(struct.pack(f"<{size}I", *ids[at : at + size]))] += 1
            at, size, piece = at + size, 1024, piece + 1
    return want


def check_packing(got, want: collections.Counter) -> None:
    """All pieces are there, sequences are gapless and few: never more than best fit decreasing may need."""
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    sizes = [k[3] for k, n in want.items() for _ in range(n)]
    bound = max(-(-sum(sizes) // 1024), sum(s > 512 for s in sizes))
    assert len(held) <= bound * 11 / 9 + 1


def auc(scores, y) -> float:
    order = np.argsort(np.argsort(scores)) + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("name,label,least", [("op2_toxicity_cnn", "toxic", 0.9), ("op7_quality_gbt", "quality", 0.97)])
def test_held_out_labels(spark, name, label, least):
    from gridloom.llm.queries import queries

    got = {r.doc_id: r for r in queries()[name](spark, f"{ROOT}/sf0.1").collect()}
    assert set(got) == {r["doc_id"] for r in rows("sf0.1", "documents")}
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= (0.5 if label == "toxic" else 0.3))
    held = [r for r in rows("sf0.1", "labels") if r[label] is not None and r["doc_id"] in got and got[r["doc_id"]].held_out]
    y = np.array([r[label] for r in held])
    guess = np.array([got[r["doc_id"]].predicted for r in held])
    assert len(y) > 200 and (guess == y).mean() >= 0.95
    assert auc(np.array([got[r["doc_id"]].score for r in held]), y) >= least
    assert guess[y == 1].mean() >= 0.8 and guess[y == 0].mean() <= 0.05


def test_warc_query(spark):
    from gridloom.llm.queries import op5_warc

    pages = [(r["page_id"], r["url"], (r["html"] or "").encode()) for r in rows("sf0.01", "pages")]
    best: dict[bytes, int] = {}
    for page, _, raw in pages:
        if len(raw) >= 1000:
            best[raw] = max(page, best.get(raw, page))
    want = [(p, url, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if best.get(raw, p) != p else "response", best[raw] if best.get(raw, p) != p else None) for p, url, raw in pages]
    got = op5_warc(spark, f"{ROOT}/sf0.01").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_embedding_query(spark, sf):
    from gridloom.llm.queries import op6_embedding_near_dedup

    held = rows(sf, "embeddings")
    x = np.array([r["embedding"] for r in held], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    ids = [r["vec_id"] for r in held]
    component = np.array(ids)
    for _ in ids:
        lower = np.minimum(component, np.where(close, component[None, :], max(ids)).min(axis=1))
        if (lower == component).all():
            break
        component = lower
    true = dict(zip(ids, component.tolist()))
    got = {r.vec_id: r for r in op6_embedding_near_dedup(spark, f"{ROOT}/{sf}").collect()}
    assert set(got) == set(ids) and len(held) == len(got)
    links = {i: int(n) for i, n in zip(ids, close.sum(axis=1))}
    assert all(r.n_links <= links[i] and r.kept == (r.component_id == i) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(links.values())
    assert all(true[r.component_id] == true[i] and r.component_id <= i for i, r in got.items())
    assert sum(r.component_id == true[i] for i, r in got.items()) >= 0.95 * len(ids)


def test_secret_query(spark):
    from gridloom.llm.queries import op8_secret_scan

    got = {r.doc_id: r for r in op8_secret_scan(spark, f"{ROOT}/sf0.01").collect()}
    held = rows("sf0.01", "documents")
    assert len(got) == len(held)
    for r in held:
        text, mine = r["text"] or "", got[r["doc_id"]]
        base = base_spans(text)
        joined = [f"{k}:{a}:{b}" for a, k, b in base]
        assert mine.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [mine.n_assign, mine.n_access, mine.n_hex] == [sum(k == kind for _, k, _ in base) for kind in ("assign", "access", "hex")]
        assert sorted(mine.spans.split(",") if mine.spans else []) == sorted([*joined, *(f"entropy:{a}:{b}" for a, b in entropy_only(text, base))])


def test_base_secrets_at_a_larger_size(spark):
    from gridloom.llm.queries import op8_secret_scan

    got = {r.doc_id: r.base_sha256 for r in op8_secret_scan(spark, f"{ROOT}/sf0.1").select("doc_id", "base_sha256").collect()}
    want = {r["doc_id"]: hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base_spans(r["text"] or "")).encode()).hexdigest() for r in rows("sf0.1", "documents")}
    assert got == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_packing_query(spark, sf):
    from gridloom.llm.queries import op10_best_fit_packing

    got = op10_best_fit_packing(spark, f"{ROOT}/{sf}").collect()
    check_packing(got, brute_pieces((r["doc_id"], r["text"]) for r in rows(sf, "documents")))
    # Sequential best fit decreasing, which places one piece after another.
    gaps, sequences = [], 0
    for size in sorted((r.length for r in got), reverse=True):
        at = bisect.bisect_left(gaps, size)
        sequences += at == len(gaps)
        left = (gaps.pop(at) if at < len(gaps) else 1024) - size
        if left:
            bisect.insort(gaps, left)
    assert len({r.sequence_id for r in got}) <= sequences * 1.002 + 1


def plain_logit(model: dict, text: str) -> float:
    """The network on one text, filter by filter and word by word."""
    from gridloom.llm.toxicity import FILTERS, WIDTHS, _blocks, _encode

    raw = np.frombuffer(text.encode(), np.uint8)
    coded, _ = _encode(raw, np.array([0, len(raw)]))
    x = model["table"][coded].sum(axis=1)
    n = len(x) - (max(WIDTHS) - 1)
    total = float(model["out_bias"][0])
    for w, width in enumerate(WIDTHS):
        for f in range(FILTERS):
            columns = [(k, at + f) for wide, k, at in _blocks() if wide == width]
            best = max(sum(float(x[i + k] @ model["filters"][:, c]) for k, c in columns if i + k < len(x)) for i in range(max(n, 1) + max(WIDTHS) - width))
            total += max(0.0, best + float(model["bias"][w * FILTERS + f])) * float(model["out"][w * FILTERS + f])
    return total


def plain_hash(raw: bytes) -> int:
    """The hash of a word, byte by byte."""
    from gridloom.llm import wordhash

    mask, total, power = (1 << 64) - 1, 0, 1
    for b in raw:
        total = (total + int(wordhash._BYTE[b]) * power) & mask
        power = power * wordhash._BASE & mask
    x = (total + len(raw)) & mask
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & mask
    return x ^ x >> 31


def plain_rows(text: str) -> list[list[int]]:
    """Table rows of every word, then padding as long as the widest filter less one; a text without words has one more."""
    from gridloom.llm.toxicity import PREFIXES, TABLE_BITS, WIDTHS

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    rows = [[1 + plain_hash(part) % (2**TABLE_BITS - 1) + (k << TABLE_BITS) for k, part in enumerate([w, *(w[:n] for n in PREFIXES)])] for w in words]
    return rows + [[0] * (1 + len(PREFIXES))] * (max(WIDTHS) - 1 + (not words))


def test_toxicity_scores_equal_a_plain_network(spark):
    from gridloom.llm.common import table
    from gridloom.llm.queries import op2_toxicity_cnn
    from gridloom.llm.toxicity import FILTERS, WIDTHS, _blocks, fit

    sf = f"{ROOT}/sf0.001"
    model = fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    got = {r.doc_id: r for r in op2_toxicity_cnn(spark, sf).collect()}
    docs = rows("sf0.001", "documents")
    assert len(got) == len(docs)
    for d in docs:
        coded = np.array(plain_rows(d["text"] or ""))
        x = model["table"][coded].astype(np.float64).sum(axis=1)
        total = float(model["out_bias"][0])
        for w, width in enumerate(WIDTHS):
            windows = [x[i : i + width] for i in range(len(x) - width + 1)]
            for f in range(FILTERS):
                columns = [at + f for wide, _, at in _blocks() if wide == width]
                best = max(sum(float(v @ model["filters"][:, c]) for v, c in zip(window, columns)) for window in windows)
                total += max(0.0, best + float(model["bias"][w * FILTERS + f])) * float(model["out"][w * FILTERS + f])
        mine = got[d["doc_id"]]
        assert mine.score == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), abs=1e-4)
        assert mine.toxic == (mine.score >= mine.threshold)


def plain_features(text: str) -> list[float]:
    """The statistics of a document, counted one by one."""
    from gridloom.llm.quality import _CLASSES

    raw = text.encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    inside = [sum(b in kind for b in raw) for kind in _CLASSES.values()]
    high = sum(b >= 128 for b in raw)
    out = [n / max(len(raw), 1) for n in (*inside, len(raw) - sum(inside) - high, high)]
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    lines = lower.split(b"\n")
    lines = lines[:-1] if not lines[-1] else lines
    filled = [x for x in lines if x]
    per_word, per_line = max(len(words), 1), max(len(filled), 1)
    mean = sum(map(len, words)) / per_word
    seen, repeated = set(), 0
    for x in filled:
        repeated += len(x) * (x in seen)
        seen.add(x)
    odd = set(_CLASSES["pipe"] + _CLASSES["mark"] + _CLASSES["bracket"])
    return out + [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), mean, math.sqrt(max(sum(len(w) ** 2 for w in words) / per_word - mean**2, 0)),
        max(map(len, words), default=0), sum(len(w) >= 14 for w in words) / per_word, sum(bool(odd & set(w)) for w in words) / per_word, sum(65 <= w[0] <= 90 for w in words) / per_word,
        len(set(low)) / per_word, len(set(zip(low, low[1:]))) / max(len(words) - 1, 1), len(seen) / per_line, len(words) / per_line, repeated / max(len(raw), 1),
        sum(x.endswith(b".") for x in filled) / per_line, max(collections.Counter(low).values(), default=0) / per_word,
    ]


def test_quality_scores_equal_a_plain_tree_walk(spark):
    import pyarrow as pa

    from gridloom.llm.common import table
    from gridloom.llm.quality import document_features, fit
    from gridloom.llm.queries import op7_quality_gbt

    sf = f"{ROOT}/sf0.001"
    docs = rows("sf0.001", "documents")
    odd = ["", "\n", "\n\n", "A a\nB b.\n", " x\n x\nX", "|a [b] {c}", "é\té\r\nü.", "word", "two Words"]
    texts = [d["text"] or "" for d in docs] + odd
    want = np.array([plain_features(t) for t in texts])
    assert np.allclose(document_features(pa.array(texts)), want, rtol=1e-9, atol=1e-7)
    model = fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    inner = model["feature"].shape[1]
    got = {r.doc_id: r.score for r in op7_quality_gbt(spark, sf).collect()}
    x = document_features(pa.array([d["text"] or "" for d in docs]))
    for d, row in zip(docs, x):
        logit = model["base"]
        for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"]):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            logit += value[node - inner]
        assert got[d["doc_id"]] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)


def shares(budget: int, children: dict) -> dict:
    """Budget among children (name -> (weight, capacity)): full ones leave, the rest share again by weight."""
    out = {}
    left = dict(children)
    while left:
        level = budget / sum(w for w, _ in left.values())
        full = [c for c, (w, cap) in left.items() if cap <= level * w]
        if not full:
            floors = {c: math.floor(level * w) for c, (w, _) in left.items()}
            spare = budget - sum(floors.values())
            return out | {c: n + (i < spare) for i, (c, n) in enumerate(sorted(floors.items()))}
        for c in full:
            out[c] = left.pop(c)[1]
            budget -= out[c]
    return out


def brute_mixture(docs: list[dict]) -> list[dict]:
    import corpus_pipeline as p

    leaves = collections.defaultdict(list)
    for d in docs:
        domain = ("web", "news", "forum", "books")[int(d["source"][3:]) % 4]
        leaves[domain, d["lang"], d["source"]].append(d)
    tokens = {leaf: sum(len(WORD.findall(d["text"])) for d in held) for leaf, held in leaves.items()}

    def family(prefix, budget):
        names = {leaf[: len(prefix) + 1] for leaf in leaves if leaf[: len(prefix)] == prefix}
        room = {c: (p.WEIGHTS.get(c, 1), p.MAX_EPOCHS * sum(n for leaf, n in tokens.items() if leaf[: len(c)] == c)) for c in names}
        return shares(budget, room)

    out = []
    for domain, b in family((), sum(tokens.values()) * p.SHARE[0] // p.SHARE[1]).items():
        for lang, b2 in family(domain, b).items():
            for leaf, b3 in family(lang, b2).items():
                whole, rest = divmod(b3, tokens[leaf]) if tokens[leaf] else (0, 0)
                out += leaves[leaf] * whole
                for d in sorted(leaves[leaf], key=lambda d: hashlib.md5(f"{p.SEED}:{whole}:{d['doc_id']}".encode()).hexdigest()):
                    if rest <= 0:
                        break
                    ends = [m.end() for m in WORD.finditer(d["text"])]
                    out.append(d if len(ends) <= rest else d | {"text": d["text"][: ends[rest - 1]]})
                    rest -= len(ends)
    return out


def test_pipeline(spark):
    """Every stage on all that the one before kept, in plain Python; only the fitted weights are the operator's."""
    import corpus_pipeline
    from gridloom.llm.common import table
    from gridloom.llm.toxicity import fit

    sf = f"{ROOT}/sf0.001"
    docs = rows("sf0.001", "documents")
    model = fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    clean = [d for d in docs if plain_logit(model, d["text"] or "") < model["cuts"].get(d["lang"], 0.0)]
    assert 0.5 * len(docs) < len(clean)
    kept = {i for i, _, c in brute_components([(d["doc_id"], d["text"]) for d in clean], 5, 80) if i == c}
    assert len(kept) < len(clean)
    masked = []
    for d in (d for d in clean if d["doc_id"] in kept):
        text, base = d["text"], base_spans(d["text"])
        out, done = [], 0
        for a, b in sorted([(a, b) for a, _, b in base] + entropy_only(text, base)):
            out += [text[done:a], "[SECRET]"] if a >= done else []
            done = max(done, b)
        masked.append(d | {"text": "".join([*out, text[done:]])})
    assert any("[SECRET]" in d["text"] for d in masked)
    mixed = brute_mixture(masked)
    got = corpus_pipeline.run(spark, sf).collect()
    check_packing(got, brute_pieces((d["doc_id"], d["text"]) for d in mixed))
