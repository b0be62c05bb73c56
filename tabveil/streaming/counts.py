"""Marginals and sketches over streams: both are sums, so a running aggregation is exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.operators.sketches import sha_bucket


def running_marginal(stream: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Counts of all combinations so far, for the output modes complete and update. State grows with cells, not rows."""
    return stream.groupBy(*attrs).agg(F.count("*").alias("count"))


def running_sketch(stream: DataFrame, key: str, depth: int, width: int) -> DataFrame:
    """Counters of a sketch so far: state is depth * width counters at most."""
    rows = stream.select(F.col(key).alias("key"), F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row"))
    return rows.groupBy("row", sha_bucket(F.col("key"), F.col("row"), width).alias("bucket")).agg(F.count("*").cast("double").alias("value"))
