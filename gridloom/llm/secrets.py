"""Secret scan: base patterns, and sliding-window Shannon entropy over candidate strings.

Base patterns (fixed values):
    assign   (password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)
             letters of the names in either case, group 2 of 12 or more characters
    access   AKIA[A-Z0-9]+, 18 or more characters
    hex      [0-9a-f]+, 16 or more characters
Matches of a kind are leftmost and non-overlapping, the length test drops whole matches afterwards.

Entropy.  A candidate is a run of 20 or more characters of [A-Za-z0-9+/_=-].  A window of 20
characters slides over it; of every character class (hex, base32, base64) whose alphabet holds the
window, entropy is kept by incremental counts: one character leaves, one enters, and only their two
terms of sum(c * log2 c) change.  Windows at or above their class's limit merge into spans of kind
`entropy`.  An allow-list suppresses such spans (never base ones): text that a pattern matches,
words of one repeated or consecutive pattern, paths, and spans that a base match already covers.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare
from .wordhash import text_chunks

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_NAME = re.compile(rb"(?i:passw|secret|token|api_?key)")
_KEY = re.compile(rb"AKIA")

WINDOW = 20
_CANDIDATE_BYTES = np.zeros(256, bool)
_CANDIDATE_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True

# Classes: name, alphabet, least entropy in bits a character of a window.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.2),
    ("base32", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567="), 3.7),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.9),
)
# Allow-list: plain words (letters of one case, with joints), dates, numbers, paths of words.  Possessive
# quantifiers: a string is read once, whatever it holds.
ALLOW = (r"[A-Z]?+[a-z]++(?:[/_=+-]++[A-Z]?+[a-z]++)*+[/_=+-]*+", r"[A-Z]++(?:[/_=+-]++[A-Z]++)*+[/_=+-]*+", r"[0-9/_=+-]++", r"[/_=+-]*+")


@functools.cache
def _log_table(window: int) -> list[float]:
    return [0.0, *(c * float(np.log2(c)) for c in range(1, window + 1))]


def entropy_spans(text: str, limits=CLASSES, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged windows of a candidate string that reach their class's entropy, as (start, end)."""
    n = len(text)
    spans: list[tuple[int, int]] = []
    if n < window:
        return spans
    log = _log_table(window)
    for _, alphabet, limit in limits:
        counts: dict[str, int] = {}
        total, outside = 0.0, 0
        for i, new in enumerate(text):
            if i >= window:
                old = text[i - window]
                c = counts[old]
                total += log[c - 1] - log[c]
                counts[old] = c - 1
                outside -= old not in alphabet
            c = counts.get(new, 0)
            total += log[c + 1] - log[c]
            counts[new] = c + 1
            outside += new not in alphabet
            if i >= window - 1 and not outside and log[window] / window - total / window >= limit - 1e-9:
                start = i - window + 1
                if spans and spans[-1][1] >= start and spans[-1][0] <= start:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
    spans.sort()
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _runs(solid: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def _rows_with(pattern: re.Pattern, raw: bytes, offsets: np.ndarray) -> set[int]:
    """Texts that hold a match; one across a text's end is none, and the search goes on at that end."""
    rows = set()
    m = pattern.search(raw)
    while m:
        row = int(np.searchsorted(offsets, m.start(), side="right")) - 1
        end = int(offsets[row + 1])
        if m.end() <= end:
            rows.add(row)
        m = pattern.search(raw, end)
    return rows


def _scan(data: np.ndarray, offsets: np.ndarray, allow: re.Pattern) -> list[list[tuple[int, str, int]]]:
    """Spans (start, kind, end) of every text, in code points, sorted by start and kind as listed."""
    n = len(offsets) - 1
    found: list[list] = [[] for _ in range(n)]
    for least, table, kind in ((16, _HEX_BYTES, "hex"), (WINDOW, _CANDIDATE_BYTES, "candidate")):
        solid = table[data]
        for a, b in _runs(solid, least):
            row = int(np.searchsorted(offsets, a, side="right")) - 1
            while b > offsets[row + 1]:
                cut = int(offsets[row + 1])
                if cut - a >= least:
                    found[row].append((a, kind, cut))
                a, row = cut, row + 1
                while offsets[row + 1] == cut and row + 1 < n:
                    row += 1
            if b - a >= least:
                found[row].append((a, kind, b))
    raw = data.tobytes()
    text_of: dict[int, str] = {}
    named, keyed = _rows_with(_NAME, raw, offsets), _rows_with(_KEY, raw, offsets)
    out = []
    for row in range(n):
        if not found[row] and row not in named and row not in keyed:
            out.append([])
            continue
        begin = int(offsets[row])
        body = raw[begin : int(offsets[row + 1])]
        text = body.decode()
        # Code points before each byte, where they differ from bytes.
        lead = None if len(text) == len(body) else np.r_[0, np.cumsum((data[begin : begin + len(body)] & 0xC0) != 0x80)]
        point = (lambda b: b - begin) if lead is None else (lambda b: int(lead[b - begin]))  # noqa: B023
        spans = []
        if row in named:
            spans += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if row in keyed:
            spans += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        candidates = []
        for a, kind, b in found[row]:
            a, b = point(a), point(b)
            if kind == "hex":
                spans.append((a, "hex", b))
            else:
                candidates.append((a, b))
        # Of the base spans that begin at or before a place, the furthest end.
        base = sorted((a, b) for a, _, b in spans)
        begins, reach = [a for a, _ in base], list(itertools.accumulate((b for _, b in base), max))
        for a, b in candidates:
            whole = text[a:b]
            if allow.fullmatch(whole):
                continue
            for x, y in entropy_spans(whole):
                x, y = a + x, a + y
                before = bisect.bisect_right(begins, x)
                if not allow.fullmatch(text[x:y]) and not (before and reach[before - 1] >= y):
                    spans.append((x, "entropy", y))
        out.append(sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans, starts, ends) of every row.

    spans lists kind:start:end in code points, end exclusive.  A null text counts as empty; rows with
    null or repeated ids return as they came; an empty table gives no rows; other columns are
    ignored.  Whole texts are read, in one pass without a shuffle.  Patterns of a caller's `allow` see
    candidates of any length, so they should be free of nested repeats that match one string in
    several ways (possessive quantifiers are, as in ALLOW).
    """
    prepare(docs.sparkSession)
    pattern = "|".join(f"(?:{x})" for x in allow) or r"(?!)"

    def run(batches):
        allowed = re.compile(pattern)
        for batch in batches:
            rows = []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                rows += _scan(data, offsets, allowed)
            columns = [batch.column(0)]
            for kind in KINDS:
                columns.append(pa.array([sum(k == kind for _, k, _ in r) for r in rows], pa.int64()))
            columns.append(pa.array([hashlib.sha256(_joined([s for s in r if s[1] != "entropy"]).encode()).hexdigest() for r in rows], pa.string()))
            columns.append(pa.array([_joined(r) for r in rows], pa.string()))
            columns.append(pa.array([[s[0] for s in r] for r in rows], pa.list_(pa.int64())))
            columns.append(pa.array([[s[2] for s in r] for r in rows], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), _SCHEMA)


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans", "starts", "ends"]
_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string, starts array<long>, ends array<long>"


def redact(docs: DataFrame, mask: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The same rows and columns with every span that the scan finds replaced by `mask` in `text`.

    Overlapping spans are masked as one.  A null text stays null; a text without findings is unchanged;
    repeated rows and rows without an id are masked one by one; an empty table gives no rows; columns of
    any other name pass unchanged.
    """
    prepare(docs.sparkSession)
    pattern = "|".join(f"(?:{x})" for x in allow) or r"(?!)"
    at = docs.columns.index("text")

    def run(batches):
        allowed = re.compile(pattern)
        for batch in batches:
            spans = []
            for _, _, data, offsets in text_chunks(batch.column(at)):
                spans += _scan(data, offsets, allowed)
            if any(spans):
                texts = batch.column(at).to_pylist()
                for i, found in enumerate(spans):
                    if found:
                        texts[i] = _masked(texts[i], found, mask)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(lean(run), docs.schema)


def _masked(text: str, spans, mask: str) -> str:
    out, done = [], 0
    for a, _, b in spans:
        if a >= done:
            out += [text[done:a], mask]
        done = max(done, b)
    return "".join([*out, text[done:]])


def secrets_digest(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")
