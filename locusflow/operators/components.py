"""Connected components by alternating large-star and small-star joins, every step a written table.

Both steps are joins on a node plus an aggregate with map-side partials; no step gathers the
neighbours of a node, so a hub with a third of all links is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.runtime import Stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Stage, label: str = "cc") -> DataFrame:
    """(u, v) long links to (node, root): root is the smallest node reachable.  Isolated nodes are not listed.

    Null ends are ignored, self links drop, repeated links count once; no link gives an empty result.
    """
    oriented = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    now, step = scratch.write(oriented, f"{label}-0"), 0
    mark = _mark(now)
    old = [f"{label}-0"]
    while mark[0]:
        step += 1
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{label}-a{step}"
        )
        large = scratch.write(
            both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            f"{label}-b{step}",
        )
        below = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-c{step}")
        small = (
            large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(below.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = scratch.write(small, f"{label}-{step}")
        scratch.drop(*old, f"{label}-a{step}", f"{label}-b{step}", f"{label}-c{step}")
        old = [f"{label}-{step}"]
        mark, before = _mark(now), mark
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
