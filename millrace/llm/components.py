"""Connected components of a link table, with joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm.common import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id that its links reach.

    Each round takes the smallest label around every node and then the label's own label, which halves the length
    of chains. A node with very many links is no group in one task: its neighbours' labels are minimised before
    they are shuffled, and the join that fetches labels is one that Spark can split.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["id"]).select(F.col("a").alias("id"), "component", F.lit(None).cast("long").alias("old"))
        least = near.union(labels.select("id", "component", F.col("component").alias("old"))).groupBy("id").agg(F.min("component").alias("step"), F.max("old").alias("old"))
        up = labels.select(F.col("id").alias("up"), F.col("component").alias("over"))
        moved = least.join(up, least["step"] == up["up"]).select("id", F.least("step", "over").alias("component"), "old")
        seen = Observation()
        labels = written(moved.observe(seen, F.count_if(F.col("component") != F.col("old")).alias("changed"))).select("id", "component")
        if not seen.get["changed"]:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
