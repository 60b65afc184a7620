"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.common import settling, written


@settling("components")
def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) can reach.

    Labels spread along edges and are then replaced by their own label's label, so that the number of
    rounds follows the logarithm of the longest path. Each round's labels are a written table, deleted with the
    others once the last stands.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(near.join(own, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = new.drop("old")
        if new.filter("old <> label").isEmpty():
            return labels
