"""Connected components of a graph given as edges: hooking to the smallest neighbouring label, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """Edges a, b (any orderable type, a <> b) to node, label: the least node of its component; only nodes with edges.

    Each round every root takes the least label among its members' neighbours, and labels jump to their labels' labels until they are
    roots; rounds grow with the logarithm of the longest path at worst, and each is a few joins and partial aggregations of narrow rows.
    """
    spark = edges.sparkSession
    both = common.stored(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "components-edges")
    labels = common.stored(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "components-labels")
    while True:
        labels = _rooted(labels)
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        mine = labels.select(F.col("node").alias("a"), F.col("label").alias("own"))
        hooks = both.join(of, "b").join(mine, "a").where("other < own").groupBy(F.col("own").alias("label")).agg(F.min("other").alias("lower"))
        hooks = common.stored(spark, hooks, "components-hooks")
        if hooks.isEmpty():
            return labels
        labels = common.stored(spark, labels.join(hooks, "label", "left").select("node", F.coalesce("lower", "label").alias("label")), "components-labels")


def _rooted(labels: DataFrame) -> DataFrame:
    """Jump until every label is the label of itself."""
    spark = labels.sparkSession
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = common.stored(spark, labels.join(up, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")), "components-labels")
        labels = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return labels
