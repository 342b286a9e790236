"""Mixing sources to target weights: budgets flow down a domain-language-source tree, documents fill them by epoch.

Budgets are whole tokens. At every node the budget is dealt among the children by weight; a child that cannot use
its share (its subtree has too few tokens even at the most epochs allowed) is filled, and what it leaves goes to
its siblings by weight. Only when all siblings are full does a shortage reach their parent, whose own siblings then
take it: capacities are summed upwards first, so one pass downwards settles everything. Each leaf takes whole
epochs of its documents and then the prefix, in the next epoch's seeded order, that reaches its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

LEVELS = ("domain", "lang", "source")
#: Leading hex digits of the key that name a slice of a leaf's seeded order; only the slice in which a budget ends is sorted.
SLICE_DIGITS = 4


def deal(nodes: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Give each row of `nodes` its share of the parent's `budget`, by integer `weight` and limited by `cap`.

    Siblings sort by cap / weight. One is full exactly if its cap is at most its weighted part of what is left
    after the full ones before it; full siblings form a prefix of that order, the rest divide the remainder.
    Parts round down, so a node may leave fewer tokens than it has children undealt.
    """
    big = "decimal(38,0)"
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), node)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast(big)
    weights = (F.sum("weight").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast(big)
    tried = nodes.withColumn("left", left).withColumn("weights", weights)
    tried = tried.withColumn("full", F.col("cap").cast(big) * F.col("weights") <= F.col("weight").cast(big) * F.col("left"))
    whole = Window.partitionBy(*parent)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    rest_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    part = F.expr("cast(floor(cast(rest as decimal(20,0)) * cast(weight as decimal(18,0)) / rest_weight) as bigint)")
    tried = tried.withColumn("rest", rest).withColumn("rest_weight", rest_weight)
    return tried.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("left", "weights", "full", "rest", "rest_weight")


def leaf_budgets(leaves: DataFrame, weight_of: dict[str, dict[str, int]], total: Column, max_epochs: int) -> DataFrame:
    """Budget of each leaf. `leaves` has domain, lang, source and tokens, a row per leaf.

    `weight_of` maps a level to integer weights of its values; a value without one weighs 1, and a leaf with a value
    of weight 0 has no budget and no capacity. Other weights than integers from 0 are refused. `total` is the whole
    budget as an expression over `tokens` of all leaves; what no leaf can hold stays unspent.
    """
    for level, known in weight_of.items():
        if level not in LEVELS or any(not isinstance(w, int) or w < 0 for w in known.values()):
            raise ValueError(f"weights are integers from 0, by one of {LEVELS}, not {level}: {known}")

    def weight(level: str) -> Column:
        known = weight_of.get(level, {})
        expr = F.lit(None).cast("bigint")
        for value, w in known.items():
            expr = F.when(F.col(level) == value, F.lit(w).cast("bigint")).otherwise(expr)
        return F.coalesce(expr, F.lit(1).cast("bigint"))

    used = (weight(LEVELS[0]) > 0) & (weight(LEVELS[1]) > 0) & (weight(LEVELS[2]) > 0)
    caps = leaves.withColumn("root", F.col("tokens") * 0).withColumn("cap", F.when(used, F.col("tokens") * max_epochs).otherwise(0))
    held, keys = caps.groupBy("root").agg(F.least(total.cast("bigint"), F.sum("cap")).alias("budget")), ["root"]
    caps = caps.where(used)
    for level in LEVELS:
        nodes = caps.groupBy(*keys, level).agg(F.sum("cap").alias("cap")).withColumn("weight", weight(level))
        held = deal(nodes.join(held, keys), keys, level).select(*keys, level, "budget")
        keys = [*keys, level]
    return leaves.join(held.drop("root"), list(LEVELS))


def mix(
    docs: DataFrame, weight_of: dict[str, dict[str, int]], total: Column, tokens: Column, domain: Column,
    seed: int = 7, max_epochs: int = 4, id_col: str = "doc_id",
) -> DataFrame:
    """Rows to train on: id, domain, lang, source, tokens, epoch (from 0), budget; a row for each use of a document.

    A document is used in epoch e of its leaf if the tokens before it, over earlier epochs and in that epoch's
    order, are fewer than the leaf's budget: the last one used may cross it. The order within an epoch is by
    md5('seed:epoch:id'), then id, then tokens; rows that tie in all three are used together or not.
    Nulls in lang or source form leaves named '' and null text has no tokens; documents without tokens are never
    used. An empty table gives no rows. Other columns of `docs` are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), domain.alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"), tokens.cast("bigint").alias("tokens"),
    ).where("tokens > 0")
    return select_prefixes(rows, weight_of, total, seed, max_epochs).withColumnRenamed("id", id_col)


def select_prefixes(rows: DataFrame, weight_of: dict, total: Column, seed: int, max_epochs: int) -> DataFrame:
    """The selection over rows (id, domain, lang, source, tokens); see `mix`."""
    keys = list(LEVELS)
    rows = written(rows, "leaves")
    leaves = rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weight_of, total, max_epochs)
    budgets = written(budgets.select(*keys, F.col("tokens").alias("leaf_tokens"), "budget", F.expr("budget div tokens").alias("whole")), "budgets")
    slots = rows.join(budgets, keys).withColumn("epoch", F.explode(F.expr("sequence(0, cast(least(whole, (budget - 1) div leaf_tokens) as int))")))
    slots = slots.where("budget > 0")
    part = F.col("epoch") == F.col("whole")
    full = slots.where(~part)
    last = slots.where(part).withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("id").cast("string"))))
    last = last.withColumn("slice", F.conv(F.substring("key", 1, SLICE_DIGITS), 16, 10).cast("int")).withColumn("need", F.expr("budget - whole * leaf_tokens"))
    sums = last.groupBy(*keys, "need", "slice").agg(F.sum("tokens").alias("slice_tokens")).withColumn("part", F.shiftright("slice", 2 * SLICE_DIGITS))
    # running sums over the parts of a leaf, then over the slices of a part: 256 rows at most in either window
    upto = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy(*keys, "part").agg(F.sum("slice_tokens").alias("part_tokens"))
    parts = parts.select(*keys, "part", F.coalesce(F.sum("part_tokens").over(upto), F.lit(0)).alias("part_start"))
    within = Window.partitionBy(*keys, "part").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("slice_tokens").over(within), F.lit(0))).join(parts, [*keys, "part"])
    starts = starts.withColumn("start", F.col("part_start") + F.col("before")).where("start < need").select(*keys, "slice", "slice_tokens", "start")
    last = last.join(starts, [*keys, "slice"])
    inside = last.where("start + slice_tokens <= need")
    order = Window.partitionBy(*keys, "slice").orderBy("key", "id", "tokens").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    border = last.where("start + slice_tokens > need")
    same = Window.partitionBy(*keys, "slice", "key", "id", "tokens")
    border = border.withColumn("upto", F.sum("tokens").over(order) - F.sum("tokens").over(same)).where("start + upto < need")
    out = ["id", *keys, "tokens", "epoch", "budget"]
    return full.select(*out).unionByName(inside.select(*out)).unionByName(border.select(*out))
