"""Connected components of an edge table as alternating large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.storage import materialise, scope


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return int(row["n"]), int(row["h"] or 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node that has an edge; the component is its least node.

    Each round joins edges with the least neighbour of each node.  The
    neighbour minimum has one row per node (partial aggregation takes the heat
    out of hub nodes) and the edge side of the join may be split by AQE, so a
    hub with a third of all edges does not end up in one task.  Every round is
    written to the shared folder: lineage stays short and lost executors only
    cost a re-read.

    Null endpoints and self loops carry no edge and are ignored; repeated
    edges count once; an empty table yields an empty result.
    """
    spark = edges.sparkSession
    with scope(spark):
        e = materialise(
            edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
            .distinct(),
            "edges",
        )
        before = _signature(e)
        for _ in range(max_rounds if before[0] else 0):
            with scope(spark):
                e = _round(e)
            after = _signature(e)
            if after == before:
                break
            before = after
        else:
            if before[0]:
                raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return materialise(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components", hand_on=True)


def _round(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    large = materialise(large, "large-star")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v")
    return materialise(small.distinct(), "small-star", hand_on=True)
