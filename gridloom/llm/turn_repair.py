"""Repair of conversation structure by a min-plus matrix scan.

A conversation should have the role initials (s?(ua)+)?.  The automaton of that form has four states
(start, after s, after u, after a; start and after a accept).  Every turn becomes a 4x4 matrix over
(cost, audit) elements: entry (i, j) is the cheapest way to go from state i to state j by inserting
turns (the closure) and then keeping, reroling or deleting this one, audit being the letters of
these edits.  Elements add by the smaller cost, ties by the smaller audit in ASCII order, and
multiply by adding costs and joining audits.  Of two equally dear audits over the same turns none
begins with the other (letters determine costs), so the order of audits survives joining and the
product is associative.

Conversations of up to `long_rows` turns are scanned in one pass, a vector times matrices.  Longer
ones may be larger than a task: their rows are sorted in ranges, ranges are cut into segments of
512 turns, whose matrices are multiplied in a tree, 64 neighbours at a time, across partitions.

Edits: Keep 0 (role initial s, u or a where the form has it), Rerole to user or assistant 1, Delete
2 (the only one for blank and duplicate turns), Insert an empty turn of user or assistant 5; a
truncated turn that stays costs 5 more.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join, join_on_id, lean, prepare

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_START, _S, _U, _A = range(4)
_ACCEPT = (_START, _A)
_BY_USER, _BY_ASSISTANT = (_START, _S, _A), (_U,)  # states that a turn of user, of assistant may follow
_SEGMENT, _FANOUT = 512, 64
_BLANKS = " \t\n\x0b\x0c\r"

# A matrix is a tuple of four rows of four elements, an element (cost, audit) or None.


def _better(x, y):
    return y if x is None or (y is not None and y < x) else x


def multiply(a, b):
    """The min-plus product of two matrices."""
    out = []
    for row in a:
        sums = [None] * 4
        for x, onward in zip(row, b):
            if x is not None:
                for j, y in enumerate(onward):
                    if y is not None:
                        sums[j] = _better(sums[j], (x[0] + y[0], x[1] + y[1]))
        out.append(tuple(sums))
    return tuple(out)


def _matrix(entries):
    out = [[None] * 4 for _ in range(4)]
    for i, j, cost, audit in entries:
        out[i][j] = _better(out[i][j], (cost, audit))
    return tuple(map(tuple, out))


def _closure():
    one = _matrix([(i, i, 0, "") for i in range(4)] + [(i, _U, INSERT, "I") for i in _BY_USER] + [(i, _A, INSERT, "I") for i in _BY_ASSISTANT])
    return multiply(multiply(one, one), one)  # more than two insertions in a row only go round


CLOSURE = _closure()
IDENTITY = _matrix([(i, i, 0, "") for i in range(4)])


@functools.cache
def turn_matrix(initial: str, fault: str):
    """Insertions, then one edit of a turn; fault is blank, duplicate, truncated or empty."""
    moves = [(i, i, DELETE, "D") for i in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for states, to, letter in (((_START,), _S, "s"), (_BY_USER, _U, "u"), (_BY_ASSISTANT, _A, "a")):
            if initial == letter:
                moves += [(i, to, KEEP + more, "K") for i in states]
            if letter != "s":
                moves += [(i, to, REROLE + more, "R") for i in states]
    return multiply(CLOSURE, _matrix(moves))


def product(matrices):
    """The product of matrices in order, as a tree of neighbours."""
    matrices = list(matrices) or [IDENTITY]
    while len(matrices) > 1:
        matrices = [multiply(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def cheapest(row) -> tuple[int, str]:
    """(cost, audit) of the start state's row of a product: insertions at the end, then an accepting state."""
    last = multiply((row,), CLOSURE)[0]
    return functools.reduce(_better, (last[j] for j in _ACCEPT))


def _edits(audit: str):
    """(letter, role that the form wants there or None) of every edit: the length tells all roles."""
    length = sum(letter != "D" for letter in audit)
    at = 0
    for letter in audit:
        if letter == "D":
            yield letter, None
        else:
            place = at - length % 2
            yield letter, "system" if place < 0 else ("user", "assistant")[place % 2]
            at += 1


class _Repaired:
    """Running hash of the repaired turns, in order."""

    def __init__(self, audit: str):
        self.edits, self.sha, self.first = _edits(audit), hashlib.sha256(), True

    def _add(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def _next(self):
        for letter, role in self.edits:
            if letter != "I":
                return letter, role
            self._add(role, "")
        return None

    def turn(self, role: str, text: str) -> None:
        letter, wanted = self._next()
        if letter != "D":
            self._add(role if letter == "K" else wanted, text)

    def digest(self) -> str:
        self._next()
        return self.sha.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted damage, in their order: by crc32 of conv_id:turn modulo 20, 0 is dropped, 1 loses
    its text, 2 its [.!?], 3 is there twice, 4 gets the role user.  A null role, text or turn is one space there."""
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def _faults(turns: DataFrame) -> DataFrame:
    """Turns with what a turn alone tells: blank, truncated."""
    last = F.rtrim(F.col("text"), F.lit(_BLANKS))
    return turns.withColumns({"blank": last == "", "truncated": ~F.coalesce(F.substring(last, -1, 1).isin(".", "!", "?"), F.lit(False))})


_LEGAL = {"su", "ua", "au"}
_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NOTHING = hashlib.sha256(b"").hexdigest()


def _one(conv: int, rows) -> tuple:
    """The result of one conversation whose rows (turn, role, text, blank, truncated) are at hand."""
    seen, counts, row, before, illegal = set(), {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, IDENTITY[0], None, 0
    for _, role, text, blank, truncated in rows:
        fault = "blank" if blank else "duplicate" if (role, text) in seen else "truncated" if truncated else ""
        seen.add((role, text))
        counts[fault] += 1
        illegal += before is not None and before + role[:1] not in _LEGAL
        before = role[:1]
        row = multiply((row,), turn_matrix(before if before in "sua" else "", fault))[0]
    cost, audit = cheapest(row)
    repaired = _Repaired(audit)
    for _, role, text, *_ in rows:
        repaired.turn(role, text)
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, repaired.digest()


def _scan(batches):
    """Sorted rows of conversations to their results."""
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [f.partition(" ")[0] for f in _OUT.split(", ")]
    emitted = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    key, held, out = None, [], []
    for batch in batches:
        for conv, *row in zip(*(batch.column(c).to_pylist() for c in range(6))):
            if conv != key:
                if held:
                    out.append(_one(key, held))
                    if len(out) >= 2000:
                        yield emitted(out)
                        out = []
                key, held = conv, []
            held.append(row)
    if held:
        out.append(_one(key, held))
    if out:
        yield emitted(out)


_SEG = "conv_id long, seg long, costs array<long>, audits array<string>, first string, last string, illegal long"


def _packed(rows):
    """Segments (conv, seg, matrix, first initial, last initial, illegal) as a batch."""
    flat = [[x for row in m for x in row] for _, _, m, *_ in rows]
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([[-1 if x is None else x[0] for x in m] for m in flat], pa.list_(pa.int64())),
         pa.array([["" if x is None else x[1] for x in m] for m in flat], pa.list_(pa.string())), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.int64())],
        names=[f.partition(" ")[0] for f in _SEG.split(", ")],
    )


def _unpacked(costs, audits):
    cells = [None if c < 0 else (c, a) for c, a in zip(costs, audits)]
    return tuple(tuple(cells[i : i + 4]) for i in range(0, 16, 4))


def _segments(batches):
    """Rows (conv_id, seg, turns of the segment in order) to segment matrices."""
    for batch in batches:
        rows = []
        for conv, seg, turns in zip(*(batch.column(c).to_pylist() for c in range(3))):
            initials = [t["initial"] for t in turns]
            matrix = product(turn_matrix(t["initial"] if t["initial"] in "sua" else "", t["fault"]) for t in turns)
            illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
            rows.append((conv, seg, matrix, initials[0], initials[-1], illegal))
        if rows:
            yield _packed(rows)


def _joined(batches):
    """Rows (conv_id, seg, neighbouring segments in order) to one segment each."""
    for batch in batches:
        for conv, seg, parts in zip(*(batch.column(c).to_pylist() for c in range(3))):
            illegal = sum(p["illegal"] for p in parts) + sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(parts, parts[1:]))
            yield _packed([(conv, seg, product(_unpacked(p["costs"], p["audits"]) for p in parts), parts[0]["first"], parts[-1]["last"], illegal)])


def _final(batches):
    for batch in batches:
        rows = [(conv, *cheapest(_unpacked(costs, audits)[0]), illegal) for conv, costs, audits, illegal in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 6)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "cost", "audit", "illegal"])


def _hashed(batches):
    """Rows (conv_id, mid, role, text) in order, a conversation's audit ahead of its turns at mid -1, to hashes."""
    key, state = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.digest()], pa.string())], names=["conv_id", "repaired_sha256"])
    for batch in batches:
        for i in range(batch.num_rows):
            conv, mid, role, text = (batch.column(c)[i].as_py() for c in range(4))
            if mid < 0:
                if state is not None:
                    yield done()
                key, state = conv, _Repaired(text)
            else:
                state.turn(role, text)
    if state is not None:
        yield done()


def _long(rows: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """Results of conversations of any length, from rows with planted damage still to come."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, n // 1_000_000)
    # Rows that are equal in all columns may share a range of their own; the row number splits it.
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("salt")]
    placed = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    code = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32)
    # Ranges follow each other, so the row number rises with the order.
    placed = scratch.save(_faults(damaged(placed)).withColumns({"mid": F.monotonically_increasing_id(), "code": code}), "long")
    same = scratch.save(placed.groupBy("conv_id", "code").agg(F.min("mid").alias("first"), F.count("*").alias("docs")), "same")
    fault = F.when(F.col("blank"), "blank").when(F.col("mid") > F.col("first"), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    kinds = hot_join(placed.select("conv_id", "code", "mid", "blank", "truncated", F.substring("role", 1, 1).alias("initial")), same, ["conv_id", "code"])
    kinds = scratch.save(kinds.select("conv_id", "mid", "initial", fault.alias("fault")), "kinds")
    each = kinds.groupBy("conv_id", F.floor(F.col("mid") / _SEGMENT).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("mid", "initial", "fault"))).alias("turns"))
    segments = scratch.save(each.mapInArrow(lean(_segments), _SEG), "segments")
    while not segments.groupBy("conv_id").count().where("count > 1").isEmpty():
        cells = F.struct("seg", "costs", "audits", "first", "last", "illegal")
        near = segments.groupBy("conv_id", F.floor(F.col("seg") / _FANOUT).alias("up")).agg(F.array_sort(F.collect_list(cells)).alias("parts"))
        segments = scratch.save(near.mapInArrow(lean(_joined), _SEG), "segments")
    final = scratch.save(segments.mapInArrow(lean(_final), "conv_id long, cost long, audit string, illegal long"), "final")
    counted = kinds.groupBy("conv_id").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    turns = placed.select("conv_id", "turn").where("turn is not null").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    ahead = final.select("conv_id", F.lit(-1).cast("long").alias("mid"), F.lit("").alias("role"), F.col("audit").alias("text"))
    texts = placed.select("conv_id", "mid", "role", "text").unionByName(ahead).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "mid")
    hashes = texts.mapInArrow(lean(_hashed), "conv_id long, repaired_sha256 string")
    out = final.join(counted, "conv_id").join(turns, "conv_id", "left").join(hashes, "conv_id")
    return out.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))).select(*(f.partition(" ")[0] for f in _OUT.split(", ")))


def repair_conversations(conversations: DataFrame, long_rows: int = 256, long_chars: int = 16_000_000) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after planted damage.

    Turns are ordered by number, null first, ties by role and text before the damage; a turn that is there
    twice stands next to itself.  The first fault of a turn counts: blank (no character but white space),
    duplicate (role and text seen earlier), truncated (its last such character is not one of .!?).  gaps are
    the numbers missing between the first and the last turn, nulls left out; illegal counts neighbours
    whose role initials are not su, ua or au.  A null role or text is one space; a conversation without
    turns after damage has zeros, an empty audit and the hash of nothing; rows without a conv_id are left
    out; an empty table gives no rows; other columns are ignored.

    A conversation of more than long_rows turns or long_chars characters is spread over tasks; the root
    of its tree holds 16 audits, some 16 bytes a turn, and one task hashes its repaired text as it comes.
    """
    spark = conversations.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "turn-repair")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text")).where("conv_id is not null")
    convs = scratch.save(rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), "conversations")
    far = convs.where((F.col("n") > long_rows) | (F.col("chars") > long_chars))
    n = far.agg(F.sum("n")).first()[0]
    near = rows if n is None else join_on_id(rows, far.select("conv_id"), "conv_id", "left_anti")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    near = near.repartition("conv_id").sortWithinPartitions(*order)
    found = _faults(damaged(near)).mapInArrow(lean(_scan), _OUT)
    if n is not None:
        found = found.unionByName(_long(join_on_id(rows, far.select("conv_id"), "conv_id", "left_semi"), scratch, n))
    zero = F.lit(0).cast("long")
    out = convs.select("conv_id").join(found, "conv_id", "left")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")})
    return out.withColumns({"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(_NOTHING))})
