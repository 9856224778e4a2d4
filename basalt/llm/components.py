"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a join and an aggregate on the whole link table; nothing is collected but one count a round. A vertex with
very many links is only ever min-aggregated or joined, which Spark pre-aggregates and splits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """links(u, v), any direction, loops and repeats allowed -> (vertex, component), component the smallest vertex of it.

    Vertices without links to others are absent. An empty table gives an empty result.
    """
    edges = cut(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    while True:
        # large star: every vertex hangs its larger neighbours on the smallest of its neighbourhood
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: every vertex hangs itself and its smaller neighbours on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = cut(small, "links")
        # a star forest is the fixed point: no parent has a parent of its own
        if after.join(after.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty() and after.groupBy(
            "u"
        ).count().where("count > 1").isEmpty():
            return after.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(
                after.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
            )
        edges = after


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For vertices 0 .. n - 1 and links (i, j), the smallest vertex of each component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        np.minimum.at(after, root[i], least)
        np.minimum.at(after, root[j], least)
        after = after[after]
        if (after == root).all():
            return root
        root = after
