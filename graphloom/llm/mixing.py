"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_kept, materialize

#: Leaves up to which their table is broadcast to the documents; beyond, the join is left to the planner.
BROADCAST_LEAVES = 50_000


def _water_fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (parents..., name, weight, cap, given) -> with ``got``: ``given`` of the parent shared by weight, no child over its cap.

    In order of cap / weight a child is full as long as what is left, shared among it and those after it, reaches its cap; the first that isn't full sets the level for all that follow.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    ordered = by.orderBy("_ratio", name)
    left = F.col("given") - F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return (
        nodes.withColumn("_ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("_level", left / F.nullif(F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0)))
        .withColumn("_first", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", name, "_level"))).over(by))
        .withColumn("got", F.when(F.col("weight") <= 0, 0.0).otherwise(F.least("cap", F.coalesce(F.col("weight") * F.col("_first._level"), F.col("cap")))))
        .drop("_ratio", "_level", "_first")
    )


def budgets(leaves: DataFrame, levels: list[str], budget: float | Column, weights: dict[tuple, float] | None = None) -> DataFrame:
    """leaves (levels..., tokens, cap) -> with ``target`` tokens for each leaf.

    Weights are of a node among its siblings, by path ((domain,), (domain, lang), ...); a node without one has 1, one of weight 0 gets nothing and leaves its room to the others. Caps add up from the leaves, and budgets go down from the root: what a node can't use goes to its siblings first, and only what the whole parent can't use to the parent's siblings.
    """
    for i in range(len(levels)):
        path, own = levels[: i + 1], [(k, float(w)) for k, w in (weights or {}).items() if len(k) == i + 1]
        if own:
            rows = F.array(*(F.struct(*(F.lit(v).cast("string").alias(c) for c, v in zip(path, k)), F.lit(w).alias(f"_w{i}")) for k, w in own))
            leaves = leaves.join(leaves.sparkSession.range(1).select(F.inline(rows)), path, "left")
        leaves = leaves.withColumn(f"_w{i}", F.coalesce(f"_w{i}", F.lit(1.0)) if own else F.lit(1.0))
        leaves = leaves.withColumn("cap", F.when(F.col(f"_w{i}") > 0, F.col("cap")).otherwise(0.0))
    given = None
    for i, name in enumerate(levels):
        path = levels[: i + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first(f"_w{i}").alias("weight"))
        nodes = nodes.withColumn("given", F.lit(budget) if not isinstance(budget, Column) else budget) if given is None else nodes.join(given, levels[:i])
        given = _water_fill(nodes, levels[:i], name).select(*path, F.col("got").alias("given"))
    return leaves.drop(*(f"_w{i}" for i in range(len(levels)))).join(given.withColumnRenamed("given", "target"), levels)


@columns_kept("_epoch", inner=("_l0", "_l1", "_l2", "_l3", "_l4", "_l5", "_l6", "_l7", "_full", "_cut", "_times", "_tokens"))
def mix(docs: DataFrame, levels: dict[str, Column], fraction: float = 1.0, max_epochs: int = 4, weights: dict[tuple, float] | None = None, key: str = "doc_id", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """docs with ``_epoch`` (0 and up), each row as often as its leaf's target asks.

    ``levels`` name the tree from the root down (null counts as the empty name); tokens are runs of characters other than space, tab and line ends. The budget is ``fraction`` of all tokens; a leaf gives at most ``max_epochs`` times its tokens. A leaf gives whole epochs first, then of one more the longest prefix, in order of md5(seed|epoch|key), that doesn't pass its target; rows of one key come or go together, null keys count as one key, rows without tokens follow that order too, and a leaf without any token gives nothing.
    The prefix is found on 4,096 hash ranges of each leaf and then within the one range where the target falls, so no task gathers a leaf; texts are never shuffled. An empty table gives none.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    hashed = lambda epoch: F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    leaf = {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(names, levels.values())}
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    slim = materialize(docs.select(F.col(key), *(c.alias(n) for n, c in leaf.items()), count.alias("_tokens")))
    leaves = slim.groupBy(*names).agg(F.sum("_tokens").alias("tokens")).withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    total = leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    plan = budgets(leaves, names, float(min(total * max_epochs, int(total * fraction))), weights)
    plan = plan.withColumn("target", F.floor(F.col("target") + 1e-6)).withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(0).cast("int")).withColumn("rest", F.col("target") - F.col("full") * F.col("tokens"))
    plan = materialize(plan.select(*names, "tokens", "target", "full", "rest"))
    small = plan.count() <= BROADCAST_LEAVES
    placed = slim.join(F.broadcast(plan) if small else plan, names).filter("rest > 0").withColumn("_h", hashed(F.col("full"))).withColumn("_range", F.substring("_h", 1, 3))
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(*names, "_range", "rest").agg(F.sum("_tokens").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    split = ranges.filter((F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("_sum") > F.col("rest"))).select(*names, "_range", "_before")
    within = Window.partitionBy(*names, "_range").orderBy("_h").rangeBetween(Window.unboundedPreceding, 0)
    inside = placed.select(*names, "_range", "_h", "_tokens", "rest").join(split, [*names, "_range"]).withColumn("_sum", F.col("_before") + F.sum("_tokens").over(within))
    last = inside.filter("_sum <= rest").groupBy(*names).agg(F.max("_h").alias("_last"))
    cut = split.join(last, names, "left").select(*names, F.coalesce("_last", "_range").alias("_cut"))
    plan = materialize(plan.join(cut, names, "left").select(*names, F.col("full").alias("_full"), F.when(F.col("rest") > 0, F.coalesce("_cut", F.lit("g"))).alias("_cut")))
    out = docs.withColumns(leaf).join(F.broadcast(plan) if small else plan, names)
    times = F.col("_full") + F.when(hashed(F.col("_full")) <= F.col("_cut"), 1).otherwise(0)
    return out.withColumn("_times", times).filter("_times > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).select(*docs.columns, "_epoch")
