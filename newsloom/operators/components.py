"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.cutpoint import materialize, release


def _both(edges: DataFrame) -> DataFrame:
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return edges.select(ways.alias("w")).select("w.u", "w.v")


def _beside_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m the least of u and all its v. The least combines before the shuffle."""
    least = pairs.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("n"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", F.least("u", "n").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    return _beside_least(_both(edges)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    beside = _beside_least(down)
    return beside.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(node, component): the smallest node id of each node's component.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until no edge
    changes, which takes about log(n) squared rounds at worst. Every round is two
    aggregates and two joins over edges; nothing is gathered on the driver but one
    checksum a round, and each round ends in a written table. Nodes without an edge, and
    edges with a null end, are not returned.
    """
    now = materialize(
        edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64(F.greatest("u", "v"), F.least("u", "v")).cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()
            )
        mark = seen
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        release(before)
