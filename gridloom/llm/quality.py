"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are counted with numpy over the raw bytes of whole texts.  Trees are grown level by
level on binned features (gradient and hessian histograms, best split by gain), and kept as flat
arrays (feature, threshold, leaf value of complete trees), so that scoring walks all rows of a
batch through a tree at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare
from .labelled import fold, training_sample
from .wordhash import span_hashes, text_chunks, word_spans

# Byte classes counted per text.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" ", "newline": b"\n",
    "stop": b".", "comma": b",", "query": b"!?", "dash": b"-_", "pipe": b"|", "mark": b"#$%&*@^~", "bracket": b"()[]{}<>", "quote": b"\"'`", "sign": b"=+/\\:;",
}
_CODE = np.full(256, len(_CLASSES), np.int64)  # control bytes
for _k, _set in enumerate(_CLASSES.values()):
    _CODE[list(_set)] = _k
_CODE[128:] = len(_CLASSES) + 1
_N_CODES = len(_CLASSES) + 2

FEATURES = [f"share_{x}" for x in (*_CLASSES, "control", "high")] + [
    "log_bytes", "log_words", "log_lines", "word_mean", "word_sd", "word_max", "long_words", "odd_words", "capital_words", "distinct_words",
    "distinct_pairs", "distinct_lines", "line_words", "repeat_bytes", "stop_end_lines", "top_word",
]


def _distinct(groups: np.ndarray, hashes: np.ndarray, n: int, weights: np.ndarray | None = None):
    """Distinct values of each group, the summed weight of repeats, and the most frequent value's count."""
    order = np.lexsort((hashes, groups))
    g, h = groups[order], hashes[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
    distinct = np.bincount(g[new], minlength=n)
    repeat = np.bincount(g[~new], weights=(weights[order][~new] if weights is not None else None), minlength=n)
    top = np.zeros(n)
    first = np.flatnonzero(new)
    np.maximum.at(top, g[first], np.diff(np.r_[first, len(g)]))
    return distinct, repeat, top


def _chunk_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(n), size)
    counts = np.bincount(row_of * _N_CODES + _CODE[data], minlength=n * _N_CODES).reshape(n, _N_CODES)
    starts, ends, index = word_spans(data, offsets)
    words = np.diff(index)
    word_row = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(np.float64)
    per_word = np.maximum(words, 1)
    mean = np.bincount(word_row, length, n) / per_word
    sd = np.sqrt(np.maximum(np.bincount(word_row, length**2, n) / per_word - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, word_row, length)
    odd = np.concatenate([[0], np.cumsum((_CODE[data] >= 9) & (_CODE[data] <= 11))])
    # Lines: spans between line feeds within a text.
    feed = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][size > 0], feed + 1]))
    line_starts = line_starts[line_starts < len(data)]
    bounds = np.r_[line_starts, len(data)]
    line_ends = bounds[1:].copy()
    if len(line_ends):
        ends_feed = data[line_ends - 1] == 10
        line_ends -= ends_feed
    line_row = row_of[line_starts] if len(line_starts) else np.zeros(0, np.int64)
    lines = np.bincount(line_row, minlength=n)
    word_hash, line_hash = span_hashes(data, (starts, ends), (line_starts, line_ends))
    pair = word_hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + word_hash[1:] if len(word_hash) else word_hash
    within = word_row[:-1] == word_row[1:] if len(word_hash) else np.zeros(0, bool)
    d_words, _, top = _distinct(word_row, word_hash, n)
    d_pairs, _, _ = _distinct(word_row[:-1][within], pair[within], n)
    filled = line_ends > line_starts
    d_lines, repeat, _ = _distinct(line_row[filled], line_hash[filled], n, (line_ends - line_starts)[filled].astype(np.float64))
    full_lines = np.bincount(line_row[filled], minlength=n)
    stop_end = np.bincount(line_row[filled], data[line_ends[filled] - 1] == ord("."), n)
    per_byte = np.maximum(size, 1)
    return np.column_stack([
        counts / per_byte[:, None], np.log1p(size), np.log1p(words), np.log1p(lines), mean, sd, longest,
        np.bincount(word_row, length >= 14, n) / per_word, np.bincount(word_row, odd[ends] > odd[starts], n) / per_word,
        np.bincount(word_row, _CODE[data[starts]] == 1, n) / per_word, d_words / per_word, d_pairs / np.maximum(words - 1, 1),
        d_lines / np.maximum(full_lines, 1), words / np.maximum(full_lines, 1), repeat / per_byte, stop_end / np.maximum(full_lines, 1), top / per_word,
    ])


def document_features(column: pa.Array) -> np.ndarray:
    """Statistics (FEATURES) of every text of an Arrow column; an empty text has zeros."""
    out = np.zeros((len(column), len(FEATURES)))
    for first, end, data, offsets in text_chunks(column, 1 << 20):
        out[first:end] = _chunk_features(data, offsets)
    return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 12, l2: float = 2.0) -> dict:
    """Boost complete trees on the logistic loss; returns flat arrays."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    logit = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    flat = (binned + np.arange(f) * bins).ravel()
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            key = np.repeat(node * (f * bins), f) + flat
            shape = (width, f, bins)
            g, h, c = (np.bincount(key, None if w is None else np.repeat(w, f), width * f * bins).reshape(shape).cumsum(axis=2) for w in (grad, hess, None))
            tg, th, tc = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + l2) + (tg - g) ** 2 / (th - h + l2) - tg**2 / (th + l2)
            gain[(c < least) | (tc - c < least)] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, width - 1 + k], threshold[t, width - 1 + k] = j, edges[j][b]
            here = width - 1 + node
            node = 2 * node + (x[np.arange(n), feature[t, here]] > threshold[t, here])
        total = np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + l2)
        value[t] = -rate * total
        logit += value[t][node]
    return {"base": base, "feature": feature, "threshold": threshold, "value": value}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities; all rows walk a tree together, level by level."""
    logit = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    inner = model["feature"].shape[1]
    for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"]):
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < inner:
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        logit += value[node - inner]
    return 1 / (1 + np.exp(-logit))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000) -> dict:
    """Train on at most max_rows labelled rows outside fold 0; without two classes the share is the score.

    The statistics are counted on the executors; the driver gets a row of numbers a document.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            values = pa.array(document_features(batch.column(1)).ravel())
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "y", "x"])

    sample = training_sample(docs, labels, "quality", max_rows).select("doc_id", "text", "y").mapInArrow(lean(run), "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    y = sample.column("y").to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        y = np.append(y, [0.0, 1.0])
        return {"base": float(np.log(y.mean() / (1 - y.mean()))), "feature": np.zeros((0, 15), np.int64), "threshold": np.zeros((0, 15)), "value": np.zeros((0, 16))}
    x = np.array(sample.column("x").to_pylist())
    return train(x, y)


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row, score in 0 to 1: whole texts, one Python pass, no shuffle.

    Null and empty texts are scored by the statistics of a text without bytes; repeated rows and
    null ids return as they came; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = predict(sent.value, document_features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_quality(docs, fit(docs, labels))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
