"""Connected components by randomised contraction, in a number of rounds that grows with the
logarithm of the number of vertices (Bögeholz, Brand and Todor, "In-database connected component
analysis", 2020).

Each round every vertex picks the neighbour (or itself) with the smallest hash under a fresh seed,
edges are carried over to the picked vertices, and loops and repeats fall away.  All steps are
aggregations with map-side combining and joins that skew handling can split; tables are rewritten
each round, nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component_id)``: the smallest node reachable, for every node that
    an edge names.  Loops only name their node; rows with a null end are left out."""
    ends = edges.select("a", "b").where("a is not null and b is not null")
    both = scratch.keep(ends.union(ends.select("b", "a")).distinct())
    if both.isEmpty():
        return both.toDF("node", "component_id")
    nodes = both.select(F.col("a").alias("node")).distinct()
    roots = None
    live = both.where("a <> b")
    seed = 0
    while True:
        seed += 1
        rank = lambda c: F.xxhash64(F.lit(seed), c)
        picked = live.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("n"))).alias("m")).select(
            F.col("a").alias("v"),
            F.when(F.struct(rank(F.col("a")).alias("r"), F.col("a").alias("n"))
                   < F.col("m"), F.col("a"))
            .otherwise(F.col("m.n")).alias("to"))
        picked = scratch.keep(picked)
        if roots is None:
            moved = scratch.keep(nodes.join(picked, F.col("node") == F.col("v"), "left").select(
                "node", F.coalesce("to", "node").alias("root")))
        else:
            moved = scratch.keep(roots.join(picked, F.col("root") == F.col("v"), "left").select(
                "node", F.coalesce("to", "root").alias("root")))
        first, second = picked.toDF("va", "ta"), picked.toDF("vb", "tb")
        carried = scratch.keep(
            live.join(first, F.col("a") == F.col("va")).select("ta", "b")
            .join(second, F.col("b") == F.col("vb")).select(F.col("ta").alias("a"), F.col("tb").alias("b"))
            .where("a <> b").distinct())
        scratch.drop(picked, *([roots] if roots is not None else []), *([live] if seed > 1 else []))
        roots, live = moved, carried
        if live.isEmpty():
            break
    scratch.drop(live)
    smallest = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    return scratch.keep(roots.join(smallest, "root").select("node", "component_id"))
