"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions alone.

A budget of tokens goes down a tree of domain, language and source.  At each node it is shared among the children in
proportion to their weights, but no child gets more than its subtree holds: its leaves' tokens times max_epochs.  What a full
child leaves over goes to its siblings first, by water filling; a parent's own share falls short only if its whole subtree is
full, and then the parent's siblings take it up.  All arithmetic is on integers, so shares add up exactly.

A leaf's budget is whole passes over its documents and a token-prefix of one more pass.  Each pass (epoch) has an order of
its own: SHA-256 of seed, epoch and id.  The prefix's cut is found by sums over 4096 ranges of that order, and then over the
rows of the one range that holds the cut, so a hot leaf is never sorted in one task.  The last document of the prefix is
taken in part.

Edge cases: null texts have no tokens and are never taken; null keys of the tree count as "" (a child like any other);
children without a given weight have weight 1, those with weight 0 get nothing; a budget above the capacity is cut to it;
repeated ids share their place in the order and are told apart by the text's hash; exact repeats at the cut share what is
left evenly, rounded down; an empty table gives no rows; other columns are kept, but for those called tokens, epoch and
take_tokens, in whose place the new ones stand.

What is sorted in one task is a parent's children, some 100 bytes each: a million sources under one language are 100 MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, checkpointed

LEVELS = ("domain", "lang", "source")
#: Leaf tables of up to so many rows (under 16 MiB) are broadcast; larger ones are joined as any other table.
BROADCAST_LEAVES = 100_000
BIG = "decimal(38,0)"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str, budget: str) -> DataFrame:
    """Adds `share`: budget (same for all children of a parent) by weight, at most cap each; whole tokens.

    In order of cap / weight, a child is full if its proportional part of what the smaller ones left exceeds its cap; from
    the first that isn't on, the rest is shared in proportion, rounded down cumulatively.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy(F.col("ratio"), F.col(name))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0).cast(BIG)
    total = lambda c, w: F.coalesce(F.sum(c).over(w).cast(BIG), zero)
    x = nodes.withColumn("ratio", ratio).withColumn("left", F.greatest(F.col(budget).cast(BIG) - total("cap", before), zero)).withColumn("w_left", total("weight", after))
    x = x.withColumn("full", (F.col("weight") > 0) & ((F.col("cap") * F.col("w_left")).cast(BIG) <= (F.col("weight") * F.col("left")).cast(BIG)))
    opened = F.max(F.when(~F.col("full") & (F.col("weight") > 0), F.struct((-F.col("rank")).alias("k"), F.col("left"), F.col("w_left")))).over(Window.partitionBy(*parent))
    x = x.withColumn("rank", F.row_number().over(order)).withColumn("open", opened)
    x = x.withColumn("is_open", (F.col("weight") > 0) & F.coalesce(F.col("rank") >= -F.col("open.k"), F.lit(False)))
    w_open = F.when(F.col("is_open"), F.col("weight")).otherwise(zero)
    x = x.withColumn("w_open", w_open).withColumn("w_cum", F.sum("w_open").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(BIG))
    part = lambda w: F.expr(f"(open.left * ({w})) div open.w_left").cast(BIG)
    share = F.when(F.col("is_open"), part("w_cum") - part("w_cum - w_open")).when(F.col("weight") > 0, F.col("cap")).otherwise(zero)
    return x.withColumn("share", share.cast(BIG)).drop("ratio", "left", "w_left", "full", "rank", "open", "is_open", "w_open", "w_cum")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """leaves: the levels and `tokens`.  Returns them with `share`, the leaf's budget in tokens.

    weights: for each level, whole numbers by child name.  budget: an expression over `all_tokens`.
    """
    cap = F.col("tokens").cast(BIG) * max_epochs

    def weight(level: str) -> Column:
        given = [x for k, v in weights.get(level, {}).items() for x in (F.lit(k), F.lit(v))]
        return (F.coalesce(F.create_map(*given)[F.col(level)], F.lit(1)) if given else F.lit(1)).cast(BIG)

    tree = checkpointed(leaves.withColumn("_cap", cap).withColumn("root", F.lit(0)))
    all_tokens, most = tree.agg(F.sum("tokens"), F.sum("_cap").cast(BIG).cast("string")).first()
    tree = tree.withColumn("all_tokens", F.lit(all_tokens).cast("long")).withColumn("budget", F.least(budget.cast(BIG), F.lit(most).cast(BIG)))
    for i, level in enumerate(levels):
        parent = ["root", *levels[:i]]
        nodes = tree.groupBy(*parent, level).agg(F.sum("_cap").cast(BIG).alias("cap"), F.first("budget").alias("budget")).withColumn("weight", weight(level))
        shares = _share(nodes, parent, level, "budget").select(*parent, level, F.col("share").alias("budget"))
        # Each level reads the tree twice: without a cut the plan would double with every level.
        tree = checkpointed(tree.drop("budget").join(shares, [*parent, level]))
    return tree.select(*levels, "tokens", F.col("budget").cast("long").alias("share"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def _with_leaves(rows: DataFrame, table: DataFrame, count: int, levels: tuple[str, ...]) -> DataFrame:
    return rows.join(F.broadcast(table) if count <= BROADCAST_LEAVES else table, list(levels))


def select_mixture(docs: DataFrame, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int = 3, seed: int = 0, levels: tuple[str, ...] = LEVELS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The mixture: one row for each document and epoch that takes it, with `take_tokens` and all of docs' columns.

    docs must have the levels as columns.  Adds tokens, epoch (from 0) and take_tokens.
    """
    keys = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in levels]
    text = F.col(f"`{text_column}`")
    tie = F.xxhash64(F.coalesce(text, F.lit("")))
    small = checkpointed(docs.select(F.col(f"`{id_column}`").alias("_id"), *keys, n_tokens(text).alias("tokens"), tie.alias("_tie")).where("tokens > 0"))
    leaves = small.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    shares = checkpointed(leaf_budgets(leaves, weights, budget, max_epochs, levels).where("share > 0").withColumn("passes", F.expr("share div tokens")).withColumn("rest", F.expr("share % tokens")).withColumnRenamed("tokens", "leaf_tokens"))
    count = shares.count()
    partial = _with_leaves(small, shares.where("rest > 0").select(*levels, "passes", "rest"), count, levels).withColumn("_key", order_key(seed, F.col("passes"), F.col("_id"))).withColumn("_range", F.substring("_key", 1, 3))
    ranges = partial.groupBy(*levels, "_range").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy(*levels).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    cut_range = ranges.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest"))).select(*levels, "_range", (F.col("rest") - F.col("upto") + F.col("n")).alias("inside"))
    inside = partial.join(F.broadcast(cut_range) if count <= BROADCAST_LEAVES else cut_range, [*levels, "_range"])
    alike = inside.groupBy(*levels, "_range", "_key", "_tie").agg(F.sum("tokens").alias("n"), F.count("*").alias("rows"), F.first("inside").alias("inside"))
    within = Window.partitionBy(*levels, "_range").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    cut = alike.withColumn("cum", F.sum("n").over(within)).where((F.col("cum") >= F.col("inside")) & (F.col("cum") - F.col("n") < F.col("inside")))
    cut = cut.select(*levels, F.col("_key").alias("cut_key"), F.col("_tie").alias("cut_tie"), F.expr("(inside - cum + n) div rows").alias("cut_take"))
    plan = checkpointed(shares.select(*levels, "passes", "rest").join(cut, list(levels), "left"))

    named = docs.columns
    own = {c: f"__{c}" for c in levels}
    full = docs.select("*", *[k.alias(own[c]) for k, c in zip(keys, levels)], n_tokens(text).alias("__tokens"), tie.alias("__tie"))
    for c in levels:
        plan = plan.withColumnRenamed(c, own[c])
    full = _with_leaves(full.where("__tokens > 0"), plan, count, tuple(own.values()))
    key = order_key(seed, F.col("passes"), F.col(f"`{id_column}`"))
    at_cut = (key == F.col("cut_key")) & (F.col("__tie") == F.col("cut_tie"))
    before = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (F.col("__tie") < F.col("cut_tie")))
    last = F.when(F.col("cut_key").isNull(), 0).when(before, F.col("__tokens")).when(at_cut, F.col("cut_take")).otherwise(0)
    full = full.withColumn("__last", last.cast("long"))
    epochs = F.when(F.col("__last") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    out = full.where(epochs >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs)))
    take = F.when(F.col("epoch") == F.col("passes"), F.col("__last")).otherwise(F.col("__tokens"))
    return out.select(*[F.col(f"`{c}`") for c in named if c not in ("epoch", "tokens", "take_tokens")], F.col("__tokens").alias("tokens"), F.col("epoch").cast("int").alias("epoch"), take.alias("take_tokens"))
