"""Prefix trie of conversations by distributed MSD radix partitioning over dictionary-encoded turns.

Turns are replaced by ids of a dictionary of all (role, text) pairs, conversations by arrays of such
ids, and equal conversations by one weighted sequence.  Starting from one bucket that holds all
sequences, every round takes all large buckets at once: the prefix that a bucket's sequences share
is skipped as a chain of nodes (smallest and largest sequence tell it), and the sequences are dealt
to child buckets by their next turn.  A bucket of at most `local_turns` turns, or of one sequence,
leaves the recursion: such buckets are packed into tasks, where a multikey quicksort splits them to
the end.  Both emit nodes; sums over subtrees go from the local buckets up through the rounds.

Scale.  No task holds a large bucket: its sequences are spread over files, what is known of it is
one row from partial aggregates, and rows of buckets that hold a large share of all rows meet that
row by broadcast (at most 100,000 buckets can).  The number of rounds follows the number of
branchings at which buckets are still large, not the length of conversations.  One row holds the
turn ids of one conversation, 12 bytes a turn.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join, lean, prepare

_CHAIN = 1024  # shared turns that a round looks ahead
_SEQ = "array<struct<id:bigint,chars:int>>"
_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, top boolean"


def encoded_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, seq) of every conversation: its turns in order, as dictionary ids with their code points.

    Turns are ordered by turn number, null first, ties by role and then by the SHA-256 of role and text.
    A null role or text is empty, rows without a conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), code.alias("code"), F.length(text).alias("chars")).where("conv_id is not null")
    turns = scratch.save(turns, "turns")
    words = scratch.save(turns.groupBy("code").agg(F.count("*").alias("docs")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    turns = hot_join(turns, words, ["code"])
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "code", "id", "chars")
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(place)).alias("s")).select("conv_id", F.transform("s", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("seq"))


def rebuilt(sequences: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c with its first h turns taken from c - c % family, h = crc32(c) % most.

    The remainder has the sign of c.  All turns are taken if there are fewer, none if that conversation
    is absent; the conversation's own turns after its first h follow.
    """
    own = sequences.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")})
    heads = sequences.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, most).alias("head"))
    head = F.slice(F.coalesce("head", F.array().cast(_SEQ)), F.lit(1), F.col("h"))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq"), F.lit(1)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("seq"))


def _quicksort(local: list, depth: int, parent, chars: int, nodes: list) -> None:
    """Nodes of one bucket: rows (rep, weight, ids, chars by turn) that share a prefix of `depth` turns.

    Multikey quicksort: rows are split three ways by their next turn; the middle part, if it is not
    empty, is a child and goes on with the turn after.
    """

    def node(rows, d, above, size):
        nodes.append([min(r[0] for r in rows), d, above, sum(r[1] for r in rows), size, None])
        return len(nodes) - 1

    top = node(local, depth, parent, chars)
    nodes[top].append(True)
    todo = [(local, 0, top)]
    while todo:
        rows, at, here = todo.pop()
        while len(rows) == 1:  # a chain to the end
            rep, _, ids, sizes = rows[0]
            if at == len(ids):
                nodes[here][5] = rep
                break
            here = node(rows, depth + at + 1, here, sizes[at])
            at += 1
        else:
            ended = [r for r in rows if len(r[2]) == at]
            if ended:
                nodes[here][5] = ended[0][0]  # sequences are distinct
                rows = [r for r in rows if len(r[2]) > at]
            if not rows:
                continue
            pivot = rows[len(rows) // 2][2][at]
            less, more, same = ([r for r in rows if r[2][at] < pivot], [r for r in rows if r[2][at] > pivot], [r for r in rows if r[2][at] == pivot])
            todo += [(part, at, here) for part in (less, more) if part]
            todo.append((same, at + 1, node(same, depth + at + 1, here, same[0][3][at])))


def _finish(batches):
    """Local buckets, sorted by bucket, to their nodes with the sums over their subtrees."""
    held, key, names = [], None, [f.partition(" ")[0] for f in _NODE.split(", ")]

    def nodes_of(rows):
        nodes: list = []
        _, depth, parent, chars = key
        _quicksort(rows, depth, parent, chars, nodes)
        n = len(nodes)
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            conv, d, above, convs, size, *_ = nodes[i]
            leaves[i] = leaves[i] or 1
            saved[i] += (convs - 1) * size
            if i:
                children[above] += 1
                leaves[above] += leaves[i]
                saved[above] += saved[i]
        for i, x in enumerate(nodes):
            yield x[0], x[1], x[2] if not i else nodes[x[2]][0], x[3], children[i], leaves[i], saved[i], x[5], not i

    def emitted(rows):
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    out: list = []
    for batch in batches:
        rests = batch.column(6)
        if isinstance(rests, pa.ChunkedArray):
            rests = rests.combine_chunks()
        for *bucket, rep, weight, rest in zip(*(batch.column(c).to_pylist() for c in range(6)), rests.to_pylist()):
            if tuple(bucket) != key:
                if held:
                    out += nodes_of(held)
                    if len(out) > 50_000:
                        yield emitted(out)
                        out = []
                held, key = [], tuple(bucket)
            held.append((rep, weight, [t["id"] for t in rest], [t["chars"] for t in rest]))
    if held:
        out += nodes_of(held)
    if out:
        yield emitted(out)


def _chunks(batches):
    """Sorted (rep, conv_id) to texts of comma-joined ids, of at most some 100,000 ids each."""
    key, ids = None, []

    def chunk():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=["rep", "first", "body"])

    for batch in batches:
        for rep, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (rep != key or len(ids) >= 100_000):
                yield chunk()
                ids = []
            key = rep
            ids.append(conv)
    if ids:
        yield chunk()


def _digests(batches):
    """Chunks sorted by rep and first id to the SHA-256 of each rep's joined ids, as a running hash."""
    key, state = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["rep", "ends_sha256"])
    for batch in batches:
        for rep, body in zip(batch.column(0).to_pylist(), batch.column(2)):
            if rep != key or state is None:
                if state is not None:
                    yield done()
                key, state = rep, hashlib.sha256()
            else:
                state.update(b",")
            state.update(body.as_buffer())
    if state is not None:
        yield done()


def _ends(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, ends_sha256) of (rep, conv_id, docs): the ids of each rep in order, comma-joined and hashed.

    Ids are sorted and joined in ranges, so that the one task that must hash a rep's text from its
    start to its end reads it in chunks.
    """
    alone = members.where("docs = 1").select("rep", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    many = scratch.save(members.where("docs > 1").select("rep", "conv_id"), "ends")
    parts = members.sparkSession.sparkContext.defaultParallelism
    parts = max(parts, many.count() // 1_000_000)
    chunks = many.repartitionByRange(parts, "rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(lean(_chunks), "rep long, first long, body string")
    joined = chunks.repartition(parts, "rep").sortWithinPartitions("rep", "first").mapInArrow(lean(_digests), "rep long, ends_sha256 string")
    return alone.union(joined)


def prefix_trie(sequences: DataFrame, local_turns: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """Nodes of the prefix trie of (conv_id, seq): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    seq is an array of (id, chars).  Every distinct prefix is a node, from the empty one at depth 0;
    conversations that start with it are its members, n_convs of them, conv_id the smallest, so that
    (conv_id, depth) names a node; the root's parent is null.  n_leaves counts the childless nodes of
    its subtree (itself included), saved_tokens sums (n_convs - 1) * chars of the last turn over it, and
    ends_sha256 hashes the comma-joined ids of the members that end there.

    An empty sequence ends at the root; no sequences give no nodes; conv_ids are taken as unique.
    """
    spark = sequences.sparkSession
    prepare(spark)
    scratch = scratch or Scratch(spark, "prefix-trie")
    hashes = {"k1": F.xxhash64("seq"), "k2": F.xxhash64(F.lit(1).cast("long"), "seq"), "size": F.size("seq")}
    every = scratch.save(sequences.withColumns(hashes), "sequences")
    keys = ["k1", "k2", "size"]
    groups = scratch.save(every.groupBy(*keys).agg(F.count("*").alias("docs"), F.min("conv_id").alias("rep")), "groups")
    ends = _ends(hot_join(every.select("conv_id", *keys), groups, keys).select("rep", "conv_id", "docs"), scratch)
    distinct = groups.select("rep", F.col("docs").alias("w")).join(every.select(F.col("conv_id").alias("rep"), F.col("seq").alias("rest")), "rep")
    first = groups.agg(F.min("rep").alias("rep"), F.count("*").alias("m"), F.sum("size").alias("turns")).first()
    if first["rep"] is None:
        return spark.createDataFrame([], _NODE.replace("end_rep long, top boolean", "ends_sha256 string").replace("depth int", "depth long"))

    # Rows of a bucket: its top node (conv, depth, parent, chars) and a sequence's turns after it.
    top = {"conv": F.lit(first["rep"]).cast("long"), "depth": F.lit(0), "parent": F.lit(None).cast("long"), "chars": F.lit(0)}
    columns = ["conv", "depth", "parent", "chars", "rep", "w", "rest"]
    rows = scratch.save(distinct.withColumns({**top, "local": F.lit(first["m"] == 1 or first["turns"] <= local_turns), "m": F.lit(first["m"])}), "buckets")
    local, chains, ended = rows.where("local").select(*columns), [], []
    large = rows.where("not local")
    while not large.isEmpty():
        ahead = F.slice("rest", 1, _CHAIN)
        bucket = ["conv", "depth"]
        chain = large.groupBy(*bucket).agg(F.first("parent").alias("parent"), F.first("chars").alias("chars"), F.first("m").alias("docs"), F.sum("w").alias("n"), F.min(ahead).alias("lo"), F.max(ahead).alias("hi"))
        same = F.transform(F.arrays_zip("lo", "hi"), lambda z: F.coalesce(z["lo"] == z["hi"], F.lit(False)))
        lcp = F.when(F.array_position(same, False) == 0, F.size("lo")).otherwise(F.array_position(same, False) - 1).cast("int")
        chain = chain.withColumn("lcp", lcp).withColumn("sizes", F.concat(F.array("chars"), F.transform(F.slice("lo", F.lit(1), F.col("lcp")), lambda t: t["chars"]))).drop("lo", "hi", "chars")
        chain = scratch.save(chain, "chains")
        chains.append(chain)
        # The rest after the shared prefix: empty at its end, or led by the turn that names the child.
        moved = hot_join(large.select("conv", "depth", "rep", "w", "rest"), chain.select(*bucket, "docs", "lcp"), bucket)
        moved = scratch.save(moved.select("conv", (F.col("depth") + F.col("lcp")).alias("depth"), "rep", "w", F.slice("rest", F.col("lcp") + 1, F.greatest(F.size("rest"), F.lit(1))).alias("rest")), "moved")
        ended.append(moved.where("size(rest) = 0").select("conv", "depth", F.col("rep").alias("end_rep")))
        child = ["parent", "depth", "digit"]
        on = moved.where("size(rest) > 0").select(F.col("conv").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("rest")[0]["id"].alias("digit"), F.col("rest")[0]["chars"].alias("chars"), "rep", "w", F.slice("rest", F.lit(2), F.greatest(F.size("rest"), F.lit(1))).alias("rest"))
        facts = on.groupBy(*child).agg(F.min("rep").alias("conv"), F.count("*").alias("docs"), F.sum(F.size("rest")).alias("turns"))
        facts = scratch.save(facts.select(*child, "conv", "docs", ((F.col("docs") == 1) | (F.col("turns") <= local_turns)).alias("local")), "children")
        rows = scratch.save(hot_join(on, facts, child).withColumnRenamed("docs", "m"), "buckets")
        local = local.unionByName(rows.where("local").select(*columns))
        large = rows.where("not local")

    parts = max(spark.sparkContext.defaultParallelism, first["turns"] // 1_000_000)
    shown = local.select("conv", "depth", "parent", "chars", "rep", "w", "rest")
    nodes = shown.repartition(parts, "conv", "depth").sortWithinPartitions("conv", "depth").mapInArrow(lean(_finish), _NODE)
    nodes = scratch.save(nodes, "local")
    above = nodes.where("top and parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("bottom"))
    above = scratch.save(above.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")), "above")
    whole = nodes.drop("top")
    later = None
    for chain, ends_here in zip(reversed(chains), reversed(ended)):
        below = above if later is None else above.union(later)
        below = below.groupBy("conv", "bottom").agg(F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        chain = chain.withColumn("bottom", F.col("depth") + F.col("lcp")).join(below, ["conv", "bottom"])
        chain = chain.join(ends_here.withColumnRenamed("depth", "bottom"), ["conv", "bottom"], "left")
        upto = lambda i: F.aggregate(F.slice("sizes", i + 1, F.col("lcp") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
        chain = scratch.save(chain.withColumn("total", F.col("saved") + (F.col("n") - 1) * upto(F.lit(0))), "totals")
        later = chain.where("parent is not null").select(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("bottom"), F.lit(1).cast("long").alias("n_children"), "n_leaves", F.col("total").alias("saved"))
        i = F.col("i")
        each = chain.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lcp"))))
        whole = whole.unionByName(each.select(
            F.col("conv").alias("conv_id"), (F.col("depth") + i).alias("depth"), F.when(i == 0, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(i < F.col("lcp"), F.lit(1).cast("long")).otherwise(F.col("n_children")).alias("n_children"), "n_leaves", (F.col("saved") + (F.col("n") - 1) * upto(i)).alias("saved_tokens"),
            F.when(i == F.col("lcp"), F.col("end_rep")).alias("end_rep"),
        ))
    whole = scratch.save(whole.withColumn("depth", F.col("depth").cast("long")), "nodes")
    none = hashlib.sha256(b"").hexdigest()
    with_ends = whole.where("end_rep is not null").join(ends.withColumnRenamed("rep", "end_rep"), "end_rep").drop("end_rep")
    return with_ends.unionByName(whole.where("end_rep is null").drop("end_rep").withColumn("ends_sha256", F.lit(none)))


def trie_digest(conversations: DataFrame, local_turns: int = 4096) -> DataFrame:
    """The trie of the rebuilt conversations; see encoded_turns, rebuilt and prefix_trie for odd rows."""
    prepare(conversations.sparkSession)
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    return prefix_trie(rebuilt(scratch.save(encoded_turns(conversations, scratch), "encoded")), local_turns, scratch)
