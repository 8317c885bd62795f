"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``label`` for every node of ``links`` (columns ``a`` and ``b``): nodes share a label if and only
    if they are connected; the label is the smallest node.

    Each round hooks every label to the smallest label that a link joins it to, shortens the chains that this
    makes, and relabels the links; only links between different labels stay. Every round writes its tables to the
    shared folder, so nothing is recomputed from the start if an executor is lost."""
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")), f"{name}-labels")
    open_links = links.where("a <> b").select("a", "b")
    while True:
        hooks = materialize(open_links.groupBy(F.greatest("a", "b").alias("old"))
                            .agg(F.min(F.least("a", "b")).alias("new")), f"{name}-hooks")
        if hooks.isEmpty():
            return labels
        for _ in range(3):
            further = hooks.select(F.col("old").alias("new"), F.col("new").alias("far"))
            hooks = hooks.join(further, "new", "left").select("old", F.coalesce("far", "new").alias("new"))
        hooks = materialize(hooks, f"{name}-hooks")
        labels = materialize(
            labels.join(hooks.withColumnRenamed("old", "label"), "label", "left")
            .select("node", F.coalesce("new", "label").alias("label")), f"{name}-labels")
        for end in ("a", "b"):
            open_links = (open_links.join(hooks.withColumnRenamed("old", end), end, "left")
                          .withColumn(end, F.coalesce("new", end)).drop("new"))
        open_links = materialize(open_links.where("a <> b").distinct(), f"{name}-links")
