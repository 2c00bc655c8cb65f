"""Mixing sources to target weights, with built-in DataFrame functions only.

Budgets go down a domain - language - source tree.  A node's children share its budget by weight;
a child cannot take more than its capacity (its tokens times the allowed epochs), and what it
leaves is shared among its siblings, by weight again, until they are full.  Since a node never gets
more than all below it can hold, a shortage is made up by siblings first and reaches other
branches only when the whole branch is short.  The shares of a family follow in closed form: with
children in order of capacity per weight, the common level is the largest value of
(budget - capacities before) / (weights from here on), and a child gets min(capacity, level * weight),
rounded down; the few single tokens left over by that go to the first children with room.

A leaf takes its documents in whole epochs and then a prefix of one more epoch, in an order seeded
by epoch; the document in which the prefix ends is cut there.  The place is found by token counts over
256 ranges of the order, then over 256 ranges of that range, and once more, then among the documents
of one range of each leaf; the selection itself is a filter, so no text is shuffled and no window
holds a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small_enough

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: str = "text") -> Column:
    """Words of a text: maximal runs without ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _weights(df: DataFrame, level: int, weights: dict[tuple, int]) -> Column:
    """Weight of a node by its path; a node without one weighs 1."""
    column = F.lit(1)
    for path, weight in weights.items():
        if len(path) == level + 1:
            here = F.lit(True)
            for name, value in zip(LEVELS, path):
                here = here & (F.col(name) == F.lit(value))
            column = F.when(here, F.lit(int(weight))).otherwise(column)
    return column.cast("long")


def _fill(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Shares of `budget` among the rows of each family: columns weight, capacity and budget become budget."""
    family = Window.partitionBy(*(parents or [F.lit(0)]))
    order = family.orderBy((F.col("capacity") / F.when(F.col("weight") > 0, F.col("weight"))).asc_nulls_first(), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    step = children.withColumn("level", F.when(after > 0, (F.col("budget") - before).cast("double") / after.cast("double")))
    level = F.greatest(F.lit(0.0), F.coalesce(F.max("level").over(family), F.lit(0.0)))
    step = step.withColumn("share", F.least("capacity", F.floor(level * F.col("weight").cast("double")).cast("long")))
    # Single tokens that rounding down left over go to the first children, by name, that can take one.
    room = F.col("share") < F.col("capacity")
    spare = F.least(F.col("budget"), F.sum("capacity").over(family)) - F.sum("share").over(family)
    step = step.withColumns({"spare": spare, "turn": F.row_number().over(family.orderBy(room.desc(), name))})
    return step.withColumn("budget", F.col("share") + F.when(room & (F.col("turn") <= F.col("spare")), 1).otherwise(0)).drop("level", "share", "spare", "turn")


def leaf_budgets(leaves: DataFrame, total: Column, max_epochs: int, weights: dict[tuple, int]) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with the tokens that each may give (budget)."""
    node = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    for level in range(3):
        node = node.withColumn(f"w{level}", _weights(node, level, weights))
    # A node of weight 0 holds nothing, and neither does what is below it.
    node = node.withColumn("capacity", F.when(F.expr("w0 > 0 and w1 > 0 and w2 > 0"), F.col("capacity")).otherwise(F.lit(0)).cast("long"))
    top = node.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.max("w0").alias("weight"))
    top = _fill(top.withColumn("budget", total.cast("long")), [], "domain")
    mid = node.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.max("w1").alias("weight"))
    mid = _fill(mid.join(top.select("domain", "budget"), "domain"), ["domain"], "lang")
    low = node.select(*LEVELS, "tokens", "capacity", F.col("w2").alias("weight")).join(mid.select("domain", "lang", "budget"), ["domain", "lang"])
    return _fill(low, ["domain", "lang"], "source").select(*LEVELS, "tokens", "budget")


def _order_key(seed: int, epoch: Column, doc_id: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def mixture(docs: DataFrame, domain: Column, weights: dict[tuple, int], share: tuple[int, int], max_epochs: int = 3, seed: int = 42, broadcast_rows: int = 100_000, detail: bool = True):
    """(rows, leaves): selected rows of docs, once per epoch, and the leaf table.

    rows has the columns of docs, whatever their names, and with `detail`, under the names
    __domain, __lang, __source, __tokens, __epoch and __take, the leaf, the row's tokens, the epoch
    and the tokens taken (fewer than the row's only for the document at which a leaf's prefix ends;
    its text ends with the last token taken, all other texts and columns are unchanged).
    The total budget is share[0]/share[1] of all tokens.  Nulls in lang, source or domain count as 'unknown'; rows that share an id within a leaf
    are taken together; documents without words follow the order like others and cost nothing; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    # Columns of docs go by number, so that none of them can clash with the ones added here.
    number = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    named = docs.select(
        *(F.col(f"`{name}`").alias(c) for name, c in number.items()),
        F.coalesce(domain.cast("string"), F.lit("unknown")).alias("__domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("__lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("__source"),
    )
    doc_id, text = number["doc_id"], number["text"]
    leaf = [F.col(f"__{x}").alias(x) for x in LEVELS]
    narrow = scratch.save(named.select(F.col(doc_id).cast("long").alias("doc_id"), *leaf, token_count(text).alias("n")), "narrow")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves, F.lit(total * share[0] // share[1]), max_epochs, weights)
    budgets = budgets.withColumns({"whole": F.expr("coalesce(budget div nullif(tokens, 0), 0)"), "rest": F.expr("coalesce(budget % nullif(tokens, 0), 0)")})
    budgets = scratch.save(budgets, "budgets")
    small = small_enough(budgets, broadcast_rows)
    hint = F.broadcast if small else lambda df: df

    keyed = narrow.join(hint(budgets.where("rest > 0")), list(LEVELS)).withColumn("key", _order_key(seed, F.col("whole"), "doc_id"))
    held = keyed.groupBy(*LEVELS, "rest", "key", "doc_id").agg(F.sum("n").alias("n")).withColumn("base", F.lit(0).cast("long"))
    for depth in range(3):
        held = scratch.save(held.withColumn("range", F.substring("key", 1 + 2 * depth, 2)), "keyed")
        ranges = held.groupBy(*LEVELS, "rest", "base", "range").agg(F.sum("n").alias("n"))
        before = F.col("base") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range")) - F.col("n")
        ranges = ranges.withColumn("before", before).where("before < rest and before + n >= rest").select(*LEVELS, "range", F.col("before").alias("base"))
        held = held.drop("base").join(hint(ranges), [*LEVELS, "range"]).drop("range")
    inside = Window.partitionBy(*LEVELS).orderBy("key", F.col("doc_id").asc_nulls_first())
    cut = (
        held.withColumn("before", F.expr("base") + F.sum("n").over(inside) - F.col("n"))
        .where("before < rest and before + n >= rest")
        .select(*LEVELS, F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.expr("rest - before").alias("cut_take"))
    )
    plan = budgets.join(cut, list(LEVELS), "left").select(*(F.col(x).alias(f"__{x}") for x in LEVELS), F.struct("whole", "cut_key", "cut_id", "cut_take").alias("__p"))
    plan = scratch.save(plan, "plan")
    rows = named.join(hint(plan), [f"__{x}" for x in LEVELS])
    key = _order_key(seed, F.col("__p.whole"), doc_id)
    at_cut = (key == F.col("__p.cut_key")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__p.cut_id"))
    in_prefix = F.coalesce((key < F.col("__p.cut_key")) | at_cut, F.lit(False))
    rows = rows.withColumns({"__cut": F.coalesce(at_cut, F.lit(False)), "__n": F.col("__p.whole") + in_prefix.cast("long")}).where("__n > 0")
    rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    tokens = token_count(text)
    take = F.when(F.col("__cut") & (F.col("__epoch") == F.col("__p.whole")), F.least("__tokens", "__p.cut_take")).otherwise(F.col("__tokens"))
    rows = rows.withColumn("__tokens", tokens).withColumn("__take", take)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut_text = F.array_join(F.slice(words, F.lit(1), F.col("__take").cast("int")), "")
    rows = rows.withColumn(text, F.when(F.col("__take") < F.col("__tokens"), cut_text).otherwise(F.col(text)))
    added = [*(f"__{x}" for x in LEVELS), "__tokens", "__epoch", "__take"] if detail else []
    return rows.select(*(F.col(c).alias(name) for name, c in number.items()), *added), budgets


#: The registered mixture: domains by number of source, weights by path in the tree.
DOMAIN_SQL = "CASE try_cast(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'news' WHEN 2 THEN 'forum' WHEN 3 THEN 'books' END"
WEIGHTS = {("web",): 2, ("news",): 3, ("forum",): 1, ("books",): 4, ("books", "de"): 2, ("news", "en"): 3, ("web", "en"): 5, ("web", "en", "src4"): 3, ("forum", "es"): 0}


def mixture_digest(docs: DataFrame, share: tuple[int, int] = (6, 10), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    rows, _ = mixture(docs.select("doc_id", "text", "lang", "source"), F.expr(DOMAIN_SQL), WEIGHTS, share, max_epochs, seed)
    return rows.select(
        "doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"),
        F.col("__epoch").cast("int").alias("epoch"), F.col("__tokens").alias("n_tokens"), F.col("__take").alias("take_tokens"),
    )
