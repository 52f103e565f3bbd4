"""Connected components of a table of links, by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): for each node of a link the smallest node reachable. Links may repeat and run either way."""
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = stash(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stash(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        low = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("to"))
        new = stash(low.join(jump, "l").select("u", "old", F.least("l", "to").alias("l")), "labels")
        if new.where("l <> old").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("l").alias("comp"))
        labels = new.select("u", "l")
