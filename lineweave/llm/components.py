"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, a: str, b: str, scratch: Scratch | None = None, max_steps: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b).

    Each step is a minimum for each node and a join, on a table that is written before the next step;
    the number of steps grows with the logarithm of the longest path.  Rows never come to the driver.
    Rows with a null end, and those of a node with itself, are no edges; repeated rows count once; an
    empty table gives no rows.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    scratch = scratch or Scratch(edges.sparkSession)
    others, name = list(scratch.names), f"edges_{len(scratch.names)}"
    edges = scratch.write(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(u.alias("u"), v.alias("v")).where("u > v").distinct(), name)
    before = _state(edges)
    for step in range(max_steps):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), f"{name}_{step}")
        scratch.keep(*others, f"{name}_{step}")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {max_steps} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
