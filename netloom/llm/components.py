"""Connected components of a link table by alternating large-star and small-star steps.

Published method (Kiveris et al., "Connected Components in MapReduce and Beyond"): every step only
groups links by one end and re-links neighbours to the smallest id seen, so that a node with a third
of all links costs a partial aggregation and a join that Spark may split. The number of steps grows
with the logarithm of the table. Joins are by merging, so that small tables aren't broadcast by the driver in every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(lowest.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select(F.col("u"), F.col("m").alias("v")))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Map every id that has a link to the smallest id it can reach: columns ``id``, ``root``.

    ``links`` may repeat links, hold both directions, or link an id with itself (left out). Links with
    a null end are left out. The smallest id of a component isn't listed. An empty table gives an
    empty result.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNull() | F.col(b).isNull()).alias("open")).filter("not open and u <> v").select("u", "v").distinct(),
        "links",
    )
    state = _state(edges)
    while True:
        large = _large_star(edges).filter("u <> v").distinct()
        after = materialize(_small_star(large).filter("u <> v").distinct(), "links")
        new = _state(after)
        discard(edges)
        edges = after
        if new == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = new
