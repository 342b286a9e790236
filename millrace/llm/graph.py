"""Connected components of a table of links, by minimum labels with pointer jumping, and how new links change them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import compact, hot_keys, spread_join, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): component is the smallest node reachable.

    Every round joins by node and takes partial minima before it shuffles. A node with very many links, and a label
    that very many nodes have, are dealt over copies. Each round's labels are written to the shared folder, and
    rounds grow with the logarithm of the longest chain.
    """
    both = links.select("a", "b").where("a != b")
    most = 2 * links.count()
    both = written(compact(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), most), "links")
    hot = hot_keys(both.groupBy("a").agg(F.count(F.lit(1)).alias("n")), ["a"], most)
    labels = written(compact(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), most), "labels")
    nodes = labels.count()
    while True:
        told = spread_join(both, labels.withColumnRenamed("node", "a"), "a", "b", hot)
        seen = told.groupBy(F.col("b").alias("node")).agg(F.min("component").alias("low"))
        lower = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        shared = hot_keys(labels.groupBy(F.col("component").alias("mid")).agg(F.count(F.lit(1)).alias("n")), ["mid"], nodes)
        step = written(compact(spread_join(lower, jump, "mid", "node", shared).select("node", "old", F.least("mid", "far").alias("component")), nodes), "labels")
        labels = step.select("node", "component")
        if step.where("component < old").isEmpty():
            return labels


def relabelled(labels: DataFrame, fresh: DataFrame) -> DataFrame:
    """The written labels (node, component) once the written links `fresh` (a, b) count too; nodes may be new.

    Only the components that `fresh` joins are labelled again, each as one node of a smaller graph.
    """
    joined = fresh.count()
    ends = fresh.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    most = labels.count() + 2 * joined
    labels = written(compact(labels.unionByName(ends.join(labels, "node", "left_anti").withColumn("component", F.col("node"))), most), "nodes")
    hot = hot_keys(fresh.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["b"], joined)
    placed = spread_join(spread_join(fresh, labels.toDF("a", "ca"), "a", "b"), labels.toDF("b", "cb"), "b", "a", hot)
    seams = written(compact(placed.where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), joined), "seams")
    if seams.isEmpty():
        return labels
    moved = components(seams).toDF("component", "to")
    each = labels.select("component").distinct().join(moved, "component", "left").select("component", F.coalesce("to", "component").alias("to"))
    return written(compact(spread_join(labels, each, "component", "node").select("node", F.col("to").alias("component")), most), "labels")
