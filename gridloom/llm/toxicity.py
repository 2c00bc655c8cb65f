"""Toxicity: a convolutional text classifier trained and run in numpy.

A word's embedding is the sum of three hashed embeddings: of the word and of its first 5 and 7
bytes (so that unseen words which share a stem with seen ones are placed near them).  Filters of
widths 1, 2 and 3 run over the words of the whole text, each is max-pooled over all positions, and
a logistic layer turns the pooled values into a score.  The gradient of a max reaches only the words of
the winning window.

Every labelled text is learned from.  Blocks of texts are written once; a network begins on the first of
them and then goes in rounds over all: a task learns on from the common network with the texts of a block,
and what the blocks changed is averaged.  Five networks go together, one of all texts and one without each
fold, so that every labelled text has a score of a network that has not seen it.  Scores are shifted so that
0.5 separates those best; a threshold by language is fitted on the same.

Text alone decides a score.  Language only selects the threshold of the decision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, lean_group, prepare, release
from .labelled import FOLDS, fold, labelled_texts
from .wordhash import span_hashes, text_chunks, word_spans

WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 16
TABLE_BITS = 15
PREFIXES = (5, 7)
MIN_TEXTS = 4
HIDDEN = 0.4
_PAD = max(WIDTHS) - 1
_OUT = FILTERS * sum(WIDTHS)
_ROWS = (len(PREFIXES) + 1) << TABLE_BITS
_POOLS = FILTERS * len(WIDTHS)
_DENSE = {"filters": (DIM, _OUT), "bias": (_POOLS,), "out": (_POOLS,), "out_bias": (1,)}
#: What a network is while it learns: its weights, their moments, the steps so far; table rows and their squared gradients.
_SHAPES = {**{f"{m}{k}": v for m in ("", "m_", "v_") for k, v in _DENSE.items()}, "step": (1,)}
_PART = 8192  # rows of the table that are merged together
_BINS = 1024  # steps of a logit that cuts may lie at, in 1
_FOLDS = range(1, FOLDS)  # network k lacks fold k, network 0 none


def _encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of every word (words + padding, 3), and the first position of each text.

    Every text is followed by padding as long as the widest filter less one; row 0 is the padding.
    """
    starts, ends, index = word_spans(data, offsets)
    spans = [(starts, ends), *((starts, np.minimum(ends, starts + k)) for k in PREFIXES)]
    counts = np.diff(index)
    begins = np.concatenate([[0], np.cumsum(counts + _PAD + (counts == 0))])
    rows = np.zeros((begins[-1], len(spans)), np.int32)
    if len(starts):
        place = np.arange(len(starts)) + np.repeat(begins[:-1] - index[:-1], counts)
        size = np.uint64(2**TABLE_BITS - 1)
        for k, h in enumerate(span_hashes(data, *spans)):
            rows[place, k] = 1 + (h % size).astype(np.int32) + (k << TABLE_BITS)
    return rows, begins


def _blocks():
    """(width, offset in the window, first column) of every block of the filter matrix."""
    at = 0
    for width in WIDTHS:
        for k in range(width):
            yield width, k, at
            at += FILTERS


def _pooled(model: dict, rows: np.ndarray, begins: np.ndarray, winners: bool = False):
    """Pooled filter values of each text, and if asked the winning positions."""
    x = model["table"][rows[:, 0]]
    for k in range(1, rows.shape[1]):
        x = x + model["table"][rows[:, k]]
    y = x @ model["filters"]
    n = len(y)
    pooled = np.empty((len(begins) - 1, FILTERS * len(WIDTHS)), np.float32)
    where = np.empty(pooled.shape, np.int64) if winners else None
    for w, width in enumerate(WIDTHS):
        conv = np.zeros((n, FILTERS), np.float32)
        for wide, k, at in _blocks():
            if wide == width:
                conv[: n - k] += y[k:, at : at + FILTERS]
        # Windows that begin in the padding of the widest filter would reach into the next text.
        last = begins[1:, None] - 1 - np.arange(_PAD)[None, :]
        if width > 1:
            conv[last[:, : width - 1].ravel()] = -np.inf
        span = slice(w * FILTERS, (w + 1) * FILTERS)
        pooled[:, span] = np.maximum.reduceat(conv, begins[:-1], axis=0)
        if winners:
            for i, (a, b) in enumerate(zip(begins[:-1], begins[1:])):
                where[i, span] = a + conv[a:b].argmax(axis=0)
    pooled += model["bias"]
    return (pooled, where, x) if winners else pooled


def _logits(model: dict, pooled: np.ndarray) -> np.ndarray:
    return np.maximum(pooled, 0) @ model["out"] + model["out_bias"]


def encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all texts of an Arrow column one after another, and the first position of each text."""
    rows, begins, total = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in text_chunks(column, 1 << 20):
        some, at = _encode(data, offsets)
        rows.append(some)
        begins.append(total + at[1:])
        total += len(some)
    return (np.concatenate(rows) if rows else np.zeros((0, 1 + len(PREFIXES)), np.int32)), np.concatenate(begins)


def _picked(rows: np.ndarray, begins: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of some of the texts, in that order."""
    sizes = begins[some + 1] - begins[some]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return rows[np.repeat(begins[some] - starts[:-1], sizes) + np.arange(starts[-1])], starts


def blank() -> dict:
    return {k: np.zeros(v, np.float32) for k, v in _SHAPES.items()} | {"table": np.zeros((_ROWS, DIM), np.float32), "second": np.zeros(_ROWS, np.float32)}


def begin(rng: np.random.Generator, rare: np.ndarray) -> dict:
    """A network with random weights; a row of few training documents says more about those than about the label: it stays zero."""
    state = blank()
    state["table"] = rng.normal(0, 0.1, (_ROWS, DIM)).astype(np.float32)
    state["filters"] = rng.normal(0, 0.3, (DIM, _OUT)).astype(np.float32)
    state["out"] = rng.normal(0, 0.3, _POOLS).astype(np.float32)
    state["table"][0] = 0
    state["table"][rare] = 0
    return state


def learn(model: dict, every: np.ndarray, begins_of: np.ndarray, chosen: np.ndarray, y: np.ndarray, rare: np.ndarray, positive: float, rng: np.random.Generator, epochs: int, rate: float = 0.02, batch: int = 64) -> None:
    """Go over the chosen ones of the encoded texts, whose labels are y; the model is changed in place."""
    positive = max(positive, 1e-3)
    weights = np.where(y == 1, min(0.5 / positive, 4.0), 0.5 / max(1 - positive, 1e-3))
    for _ in range(epochs):
        order = rng.permutation(len(chosen))
        for first in range(0, len(order), batch):
            some = order[first : first + batch]
            rows, begins = _picked(every, begins_of, chosen[some])
            # Hidden words make the network learn every word that tells, not one for each text.
            rows = np.where(rare[rows] | (rng.random((len(rows), 1)) < HIDDEN), 0, rows)
            pooled, where, x = _pooled(model, rows, begins, winners=True)
            active = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ model["out"] + model["out_bias"], -30, 30)))
            d = ((p - y[some]) * weights[some] / len(some)).astype(np.float32)
            back = d[:, None] * model["out"][None, :] * (pooled > 0)
            grads = {"out": active.T @ d + 1e-4 * model["out"], "out_bias": d.sum(keepdims=True), "bias": back.sum(axis=0), "filters": np.zeros_like(model["filters"])}
            touched, pushed = [], []
            for w, width in enumerate(WIDTHS):
                at = where[:, w * FILTERS : (w + 1) * FILTERS]
                g = back[:, w * FILTERS : (w + 1) * FILTERS]
                for wide, k, column in _blocks():
                    if wide != width:
                        continue
                    here = np.minimum(at + k, len(rows) - 1)
                    for f in range(FILTERS):
                        grads["filters"][:, column + f] += g[:, f] @ x[here[:, f]]
                        touched.append(rows[here[:, f]])
                        pushed.append(g[:, f, None] * model["filters"][None, :, column + f])
            touched, pushed = np.concatenate(touched), np.concatenate(pushed)
            busy = np.any(pushed != 0, axis=1)
            touched, pushed = touched[busy], pushed[busy]
            model["step"] += 1
            step = float(model["step"][0])
            for k, g in grads.items():
                m, v = model[f"m_{k}"], model[f"v_{k}"]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model[k] -= (rate / 4 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if len(touched):
                ids, inverse = np.unique(touched, return_inverse=True)
                total = np.zeros((len(ids), DIM), np.float32)
                np.add.at(total, inverse.reshape(touched.shape).ravel(), np.repeat(pushed, touched.shape[1], axis=0))
                model["second"][ids] += (total * total).mean(axis=1)
                model["table"][ids] -= rate * 2 * total / np.sqrt(model["second"][ids] + 1e-6)[:, None]
                model["table"][0] = 0


def raw_scores(model: dict, column: pa.Array) -> np.ndarray:
    """Logits of every text of an Arrow column; whole texts, in slices of bounded size."""
    out = np.empty(len(column), np.float64)
    for first, end, data, offsets in text_chunks(column, 1 << 19):
        out[first:end] = _logits(model, _pooled(model, *_encode(data, offsets)))
    return out


def _best_cut(values: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """Logit that separates the labels with the best F1, midway between neighbours; a value may stand for n rows, y of them positive.

    Only cuts count at which half or more of those above are positive; without one (scores that tell
    nothing, as after few examples, have their best F1 where all is positive) it lies above all.
    """
    order = np.argsort(-values, kind="stable")
    v, hit = values[order], y[order]
    tp, above = np.cumsum(hit), np.cumsum(np.ones(len(v)) if n is None else n[order])
    f1 = 2 * tp / (above + max(1, hit.sum()))
    # A cut is possible only where the value changes; of all about as good, a low one is taken.
    f1[:-1][v[:-1] == v[1:]] = -1
    f1[2 * tp < above] = -1
    if f1.max() <= 0:
        return float(v[0] + 1e-3)
    good = np.flatnonzero(f1 >= 0.99 * f1.max())
    k = int(good[len(good) * 3 // 4])
    return float((v[k] + v[k + 1]) / 2) if k + 1 < len(v) else float(v[k] - 1e-3)


_BLOB = "block int, texts binary, seen binary, n array<long>, hits array<long>"


def _blob(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A row of a block: its texts, labels and folds; in how many of a fold's texts a table row is (MIN_TEXTS at most), texts and hits by fold."""
    texts = pa.Table.from_batches(held).select(["text", "lang", "y", "fold"]).combine_chunks()
    rows, begins = encoded(texts.column("text"))
    folds, y = texts.column("fold").to_numpy(), texts.column("y").to_numpy()
    seen = np.zeros((FOLDS, _ROWS), np.int32)
    for i, k in enumerate(folds):
        seen[k, np.unique(rows[begins[i] : begins[i + 1]])] += 1
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(texts)
    tallies = [np.bincount(folds, w, FOLDS).astype(np.int64).tolist() for w in (None, y)]
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([np.minimum(seen, MIN_TEXTS).astype(np.uint8).tobytes()], pa.binary()), *(pa.array([t], pa.list_(pa.int64())) for t in tallies)],
        names=["block", "texts", "seen", "n", "hits"],
    )


def _blobs(batches):
    """Rows sorted by block and id to a row a block; of the texts of an id the first stays."""
    held, block, last = [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, blocks = batch.column(1).to_numpy(), batch.column(0).to_numpy()
        fresh = np.r_[ids[0] != last, ids[1:] != ids[:-1]]
        last = ids[-1]
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and block != blocks[a]:
                yield _blob(int(block), held)
                held = []
            block = blocks[a]
            some = batch.slice(a, b - a).filter(pa.array(fresh[a:b]))
            if some.num_rows:
                held.append(some)
    if held:
        yield _blob(int(block), held)


def _opened(blob: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    with pa.ipc.open_stream(blob) as stream:
        texts = stream.read_all().combine_chunks()
    return texts, texts.column("y").to_numpy().astype(np.float64), texts.column("fold").to_numpy()


#: How a row of the table changed; half precision, since changes are the most that is shuffled.
_CHANGED = np.dtype([("table", np.float16, DIM), ("second", np.float32)])
_CHANGE = "model int, part int, lane int, ids binary, change binary"


def _changes(model: int, lane: int, base: dict, state: dict):
    """What a network has become, less what it was: rows of parts of the table that changed, and its other numbers as part -1."""
    flat = np.concatenate([(state[k] - base[k]).ravel() for k in _SHAPES])
    found = [(-1, b"", flat.tobytes())]
    ids = np.flatnonzero(np.any(state["table"] != base["table"], axis=1) | (state["second"] != base["second"])).astype(np.int32)
    for part in np.unique(ids // _PART).tolist():
        some = ids[ids // _PART == part]
        change = np.zeros(len(some), _CHANGED)
        change["table"], change["second"] = state["table"][some] - base["table"][some], state["second"][some] - base["second"][some]
        found.append((part, some.tobytes(), change.tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = zip(*((model, part, lane, some, change) for part, some, change in found))
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=["model", "part", "lane", "ids", "change"])


def _mean_change(group: pa.Table) -> pa.Table:
    """The changes of a part by different lanes: their mean, of a table row over those that changed it."""
    group = group.sort_by("lane")
    part = group.column("part")[0].as_py()
    if part < 0:
        ids = np.zeros(0, np.int32)
        mean = np.mean([np.frombuffer(x.as_py(), np.float32) for x in group.column("change")], axis=0, dtype=np.float64).astype(np.float32)
    else:
        table, second, count = np.zeros((_PART, DIM)), np.zeros(_PART), np.zeros(_PART)
        for some, change in zip(group.column("ids"), group.column("change")):
            at, change = np.frombuffer(some.as_py(), np.int32) - part * _PART, np.frombuffer(change.as_py(), _CHANGED)
            table[at] += change["table"]
            second[at] += change["second"]
            count[at] += 1
        at = np.flatnonzero(count)
        ids, mean = (at + part * _PART).astype(np.int32), np.zeros(len(at), _CHANGED)
        mean["table"], mean["second"] = table[at] / count[at, None], second[at] / count[at]
    columns = [pa.array([ids.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())]
    return group.slice(0, 1).select(["model", "part", "lane"]).append_column("ids", [columns[0]]).append_column("change", [columns[1]])


def _apply(states: dict[int, dict], found: pa.Table) -> None:
    """Changed networks; what comes has the size of the networks."""
    for row in found.to_pylist():
        state = states[row["model"]]
        if row["part"] < 0:
            change, at = np.frombuffer(row["change"], np.float32), 0
            for k, shape in _SHAPES.items():
                size = int(np.prod(shape))
                state[k] = state[k] + change[at : at + size].reshape(shape)
                at += size
        else:
            ids, change = np.frombuffer(row["ids"], np.int32), np.frombuffer(row["change"], _CHANGED)
            state["table"][ids] += change["table"]
            state["second"][ids] += change["second"]


def _seen_by(blobs: DataFrame) -> dict[int, np.ndarray]:
    """For each fold, in how many texts of all blocks a table row is, MIN_TEXTS at most."""

    def parts(batches):
        for batch in batches:
            total = np.zeros((FOLDS, _ROWS), np.uint8)
            for seen in batch.column(0):
                total = np.minimum(total + np.frombuffer(seen.as_py(), np.uint8).reshape(FOLDS, _ROWS), MIN_TEXTS).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(_FOLDS, pa.int32()), pa.array([total[k].tobytes() for k in _FOLDS], pa.binary())], names=["fold", "seen"])

    def summed(group: pa.Table) -> pa.Table:
        total = np.zeros(_ROWS, np.uint8)
        for seen in group.column("seen"):
            total = np.minimum(total + np.frombuffer(seen.as_py(), np.uint8), MIN_TEXTS).astype(np.uint8)
        return pa.table({"fold": group.column("fold")[:1], "seen": pa.array([total.tobytes()], pa.binary())})

    schema = "fold int, seen binary"
    found = blobs.select("seen").mapInArrow(parts, schema).groupBy("fold").applyInArrow(lean_group(summed), schema).toArrow()
    return {r["fold"]: np.frombuffer(r["seen"], np.uint8) for r in found.to_pylist()}


def _without(rows_by_fold: dict[int, np.ndarray], model: int) -> np.ndarray:
    """Rows of the table that are in few training documents of a network."""
    return sum(rows_by_fold[k].astype(np.int32) for k in _FOLDS if k != model) < MIN_TEXTS


def fit(docs: DataFrame, labels: DataFrame, block_rows: int = 6_000, block_bytes: int = 32_000_000, epochs: int = 8, rounds: int = 2, lanes: int = 64, language_hits: int = 20, seed: int = 5) -> dict:
    """Train on every row with a label outside fold 0; cut and thresholds come from all of them, scored by networks that have not seen them.

    Texts are dealt by a hash of their id to blocks of about block_rows rows and block_bytes bytes, each
    held by a task.  Networks begin with `epochs` turns over the first block; where there are more, all are
    gone over `rounds` times, of which each block's changes are averaged.  Beyond so many `lanes` a task
    goes on with the network over several blocks, so that no more changes than lanes meet; what the driver
    holds has the size of the networks, and counts of logits by language.
    A language has a threshold of its own from `language_hits` toxic rows on; a null one is a language
    like others.  A fold without which labels are of one class has no such scores.  With labels of one class
    only that is the score of every text, without any it is 0, and nothing is rejected.  A document labelled
    twice counts with its larger label, one with several texts with the first by hash.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = labelled_texts(docs, labels, "toxic")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    n, total, low, high = rows.agg(F.count("*"), F.sum(size), F.min("y"), F.max("y")).first()
    if low == high:
        return {"constant": float(high or 0), "cuts": {}}
    blocks = max(-(-n // block_rows), -(-total // block_bytes), 1)
    lanes = min(lanes, blocks)
    scratch = Scratch(spark, "toxicity")
    rows = rows.select(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", F.xxhash64("text").alias("h"), "text", "lang", "y", "fold")
    rows = rows.repartitionById(lanes, (F.col("block") % lanes).cast("int")).sortWithinPartitions("block", "doc_id", "h")
    blobs = scratch.save(rows.mapInArrow(lean(_blobs), _BLOB), "blocks")
    tally = blobs.agg(*(F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("n", "hits") for k in _FOLDS), F.min("block").alias("first")).first()
    count = {c: {m: sum(tally[f"{c}{k}"] for k in _FOLDS if k != m) for m in range(FOLDS)} for c in ("n", "hits")}
    models = [m for m in range(FOLDS) if 0 < count["hits"][m] < count["n"][m]]
    share = {m: count["hits"][m] / count["n"][m] for m in models}
    states = {m: blank() for m in models}
    merged = lambda found: found.groupBy("model", "part").applyInArrow(lean_group(_mean_change), _CHANGE).toArrow()

    def first(batches):
        for batch in batches:
            for m, blob, seen in zip(*(batch.column(i).to_pylist() for i in range(3))):
                texts, y, folds = _opened(blob)
                every, begins = encoded(texts.column("text"))
                chosen = np.flatnonzero(folds != m)
                mine = np.frombuffer(seen, np.uint8).reshape(FOLDS, _ROWS)
                rare = _without({k: mine[k] for k in _FOLDS}, m)
                rng = np.random.default_rng(seed)
                state = begin(rng, rare)
                learn(state, every, begins, chosen, y[chosen], rare, share[m], rng, epochs)
                yield _changes(m, 0, blank(), state)

    # A task a network: the blocks' first.
    ids = spark.createDataFrame([(m,) for m in models], "model int")
    start = blobs.where(F.col("block") == tally["first"]).crossJoin(F.broadcast(ids)).select("model", "texts", "seen").repartitionById(FOLDS, "model")
    _apply(states, merged(start.mapInArrow(lean(first), _CHANGE)))
    if blocks > 1:
        seen = _seen_by(blobs)
        rare = {m: _without(seen, m) for m in models}
        lane = (F.col("block") % lanes).cast("int")
        dealt = blobs.select(lane.alias("lane"), "block", "texts")
        if blocks > lanes:
            dealt = dealt.repartitionById(lanes, "lane").sortWithinPartitions("lane", "block")
        for turn in range(rounds):
            sent = spark.sparkContext.broadcast((states, rare))

            def further(batches, turn=turn, sent=sent):
                base, rare = sent.value
                now, mine = None, {}
                for batch in batches:
                    for at, block, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                        if at != now:
                            for m in mine:
                                yield _changes(m, now, base[m], mine[m])
                            now, mine = at, {m: {k: v.copy() for k, v in base[m].items()} for m in base}
                        texts, y, folds = _opened(blob)
                        every, begins = encoded(texts.column("text"))
                        for m in mine:
                            chosen = np.flatnonzero(folds != m)
                            learn(mine[m], every, begins, chosen, y[chosen], rare[m], share[m], np.random.default_rng([seed, turn, block, m]), 1)
                for m in mine:
                    yield _changes(m, now, base[m], mine[m])

            _apply(states, merged(dealt.mapInArrow(lean(further), _CHANGE)))
            sent.unpersist()
    weights = {m: {k: states[m][k] for k in ("table", *_DENSE)} for m in models}
    sent = spark.sparkContext.broadcast({m: w for m, w in weights.items() if m})

    def unseen(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                texts, y, folds = _opened(blob)
                for m, model in sent.value.items():
                    out = pa.array(folds == m)
                    some = texts.filter(out)
                    at = np.floor(raw_scores(model, some.column("text")) * _BINS).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([some.column("lang").fill_null("").combine_chunks(), pa.array(at), pa.array(y[folds == m].astype(np.int64))], names=["lang", "at", "y"])

    bins = blobs.select("texts").mapInArrow(lean(unseen), "lang string, at long, y long").groupBy("lang", "at").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    bins = bins.toArrow().sort_by([("lang", "ascending"), ("at", "ascending")])
    sent.unpersist()
    # A value stands for the middle of its bin, so that midway between neighbours no row is cut in two.
    value, hits, n = (bins.column("at").to_numpy() + 0.5) / _BINS, bins.column("y").to_numpy(), bins.column("n").to_numpy()
    langs = np.array(bins.column("lang").to_pylist(), dtype=object)
    model = weights[0]
    every, which = np.unique(value, return_inverse=True)
    shift = _best_cut(every, np.bincount(which, hits), np.bincount(which, n)) if hits.sum() else 0.0
    model["out_bias"] = model["out_bias"] - np.float32(shift)
    cuts = {}
    for lang in sorted(set(langs)):
        mine = langs == lang
        if hits[mine].sum() >= language_hits:
            cuts[lang] = float(np.clip(_best_cut(value[mine], hits[mine], n[mine]) - shift, -1.0, 1.0))
    scratch.close()
    release()
    return model | {"cuts": cuts}


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, threshold, toxic) of every row: whole texts, one Python pass, no shuffle.

    score is 0 to 1; threshold is the language's (0.5 for a language without one of its own, and where
    docs has no lang); toxic is score >= threshold.  Null and empty texts are scored as texts without
    words; repeated rows and null ids each return as they came; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches):
        m = sent.value
        for batch in batches:
            if "constant" in m:
                score = np.full(batch.num_rows, m["constant"])
            else:
                score = 1 / (1 + np.exp(-np.clip(raw_scores(m, batch.column(1)), -30, 30)))
            cut = np.array([1 / (1 + np.exp(-m["cuts"].get(x or "", 0.0))) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(cut, pa.float64()), pa.array(score >= cut, pa.bool_())], names=["doc_id", "score", "threshold", "toxic"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    return texts.mapInArrow(lean(run), "doc_id long, score double, threshold double, toxic boolean")


def drop_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns, that the model does not reject by their language's threshold.

    Rows are filtered inside the scoring pass, so no text is shuffled or joined.  Null and empty texts
    are judged as texts without words; rows without a language, or a table without the column, by 0.5
    or by the threshold of a null language; repeated rows and rows without an id are judged one by one;
    an empty table gives no rows; columns of any other name pass unchanged.
    """
    prepare(docs.sparkSession)
    if "constant" in model:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches):
        m = sent.value
        for batch in batches:
            langs = [""] * batch.num_rows if lang is None else batch.column(lang).to_pylist()
            cut = np.array([m["cuts"].get(x or "", 0.0) for x in langs])
            yield batch.filter(pa.array(raw_scores(m, batch.column(at)) < cut, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_toxicity(docs, fit(docs, labels))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")
