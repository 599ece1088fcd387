"""Connected components of a large edge table, by DataFrame rounds only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbark.llm.common import cut, heavy_join, hot_keys


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the component's smallest node.

    Each round gives a node the smallest label among its own and its
    neighbours', then follows labels twice (pointer jumping), so rounds grow
    with the logarithm of a component's diameter in practice.  The edges stay
    on the cluster; the driver sees one emptiness test a round.  Minima are
    aggregated before the shuffle, and labels of hubs and of large components'
    roots are looked up by broadcast, so neither is a hot key.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    hubs = hot_keys(both, "b")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        near = heavy_join(both, labels.withColumnRenamed("node", "b"), "b", hubs).groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        low = cut(low, "labels")
        up = low.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = cut(heavy_join(low, up, "root").select("node", "old", F.least("root", "top").alias("root")), "labels")
        labels = jumped.select("node", "root")
        if jumped.filter("root <> old").isEmpty():
            return labels
