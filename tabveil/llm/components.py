"""Connected components of a set of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.blobs import Steps


def components(links: DataFrame, steps: Steps, rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that links of (a, b) reach.

    Each round replaces an edge set by one that joins every node to smaller neighbours (the large-star
    and small-star steps), so a path of n nodes needs about log n rounds. Aggregation by node combines
    on the map side, hence a node of very high degree isn't gathered anywhere. No links: no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = steps.keep(edges)
    before = None
    for _ in range(rounds):
        # large star: each node's larger neighbours go to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        edges = steps.keep(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now[0] == now[2] and (before is not None and now == before or now[0] == 0):
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
