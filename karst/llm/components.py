"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One pass.  Every node u takes m, the least of itself and the neighbours the pass looks at,
    and links the larger neighbours (large) or the smaller ones and itself (small) to m.

    The minimum is a partial aggregate; the join back has one row a node on one
    side, so a node with very many neighbours can be split by the adaptive join.
    """
    if large:
        seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = seen.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select("v", "m").union(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (u, v: long); component is its least node.

    Self-loops, repeated edges and nulls change nothing.  It ends when a round
    leaves the edges as they were: then every node is linked to its least node.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.keep(e, "edges")
    mark = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    before = e.agg(*mark).first()
    for _ in range(most):
        nxt = scratch.keep(_star(_star(e, True), False), "star")
        scratch.drop(e)
        e, after = nxt, nxt.agg(*mark).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
