"""Connected components of a table of links, by smallest label with pointer jumping; every round is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by ``links`` (a, b), for every node that has a link. No row is collected."""
    space = Workspace(links.sparkSession)
    both = space.table(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges")
    labels = space.table(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("theirs"))
        near = both.join(other, "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "theirs").alias("label"))
        # jump to the label of the label; a label is a node of the same component, so it is at least as low
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = space.table(lower.join(jump, "label").select("node", "was", F.least("label", "further").alias("label")), "labels")
        if new.filter("label < was").isEmpty():
            space.keep(new)
            return new.select("node", F.col("label").alias("component"))
        space.keep(both, new)
        labels = new.select("node", "label")
