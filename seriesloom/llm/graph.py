"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """Rows (node, component): every node that has a link, with the smallest node it reaches.

    Alternates large-star steps (each node links its larger neighbours to the
    smallest node around it) and small-star steps (it links its smaller ones), so
    paths shorten geometrically. Minima are taken with map-side combine and the
    joins can be split, so one node with very many links is not one task's work.
    Each step is written to the shared folder, which cuts the lineage. Links of a
    node to itself and null ends are ignored; an empty table gives an empty result.
    """
    edges = materialise(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        ).distinct()
        large = materialise(large)
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(floor, "hi")
            .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
            .where(F.col("hi") != F.col("lo"))
            .distinct()
        )
        edges = materialise(small)
        # Both steps keep the number of nodes; the sums stand still once every node hangs on its root.
        state = tuple(
            edges.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
            ).first()
        )
        if state == before:
            break
        before = state
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
