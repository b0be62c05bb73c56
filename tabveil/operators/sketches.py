"""Frequency sketches as tables (row, bucket, value): counters that add up across tasks, batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha_bucket(key: Column, seed: Column, width: int) -> Column:
    """A 256-bit digest of key and seed, modulo `width`: four hex digits at a time."""
    digest = F.sha2(F.concat(key.cast("string"), seed.cast("string")), 256)
    fold = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("long"), lambda acc, i: (acc * 65536 + F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("long")) % width)
    return fold.cast("int")


def fast_bucket(key: Column, seed: Column, width: int) -> Column:
    return F.pmod(F.xxhash64(key, seed), F.lit(width)).cast("int")


def parity(key: Column) -> Column:
    """The last bit of a key's digest."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 64, 1), 16, 10).cast("int") % 2


def _rows(keys: DataFrame, depth: int) -> DataFrame:
    return keys.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))


def build(df: DataFrame, key: str, depth: int, width: int, bucket=sha_bucket) -> DataFrame:
    """Counters. Rows are counted by key first, so a digest is taken once for each distinct key and row."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").cast("double").alias("n"))
    return _rows(counts, depth).select("row", bucket(F.col("key"), F.col("row"), width).alias("bucket"), "n").groupBy("row", "bucket").agg(F.sum("n").alias("value"))


def query(keys: DataFrame, sketch: DataFrame, depth: int, width: int, how: str = "min", bucket=sha_bucket) -> DataFrame:
    """(key, estimate) for a table of distinct keys; a sketch has depth * width counters at most, so it is broadcast."""
    asked = _rows(keys.select("key"), depth).withColumn("bucket", bucket(F.col("key"), F.col("row"), width))
    found = asked.join(F.broadcast(sketch), ["row", "bucket"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return found.groupBy("key").agg((F.min("value") if how == "min" else F.percentile("value", F.lit(0.5))).alias("estimate"))


def signed(df: DataFrame, key: str, depth: int, width: int) -> DataFrame:
    """A count sketch with random signs: unbiased, unlike `build` with the median."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").cast("double").alias("n"))
    rows = _rows(counts, depth).select("row", fast_bucket(F.col("key"), F.col("row"), width).alias("bucket"), (F.col("n") * sign(F.col("key"), F.col("row"))).alias("n"))
    return rows.groupBy("row", "bucket").agg(F.sum("n").alias("value"))


def sign(key: Column, row: Column) -> Column:
    return 1 - 2 * F.pmod(F.xxhash64(F.lit("sign"), key, row), F.lit(2))


def signed_query(keys: DataFrame, sketch: DataFrame, depth: int, width: int) -> DataFrame:
    asked = _rows(keys.select("key"), depth).withColumn("bucket", fast_bucket(F.col("key"), F.col("row"), width))
    found = asked.join(F.broadcast(sketch), ["row", "bucket"], "left")
    return found.groupBy("key").agg(F.percentile(F.coalesce("value", F.lit(0.0)) * sign(F.col("key"), F.col("row")), F.lit(0.5)).alias("estimate"))


def layer_widths(width: int, layers: int) -> list[int]:
    return [max(1, width >> k) for k in range(layers)]


def univmon(df: DataFrame, key: str, depth: int, width: int, layers: int) -> list[DataFrame]:
    """Layers of median sketches over the keys of odd parity: such a key is in every layer, any other in none."""
    odd = df.where(parity(F.col(key)) == 1)
    return [build(odd, key, depth, w) for w in layer_widths(width, layers)]


def univmon_query(keys: DataFrame, sketch: list[DataFrame], depth: int, width: int) -> DataFrame:
    """Odd keys: from the layer before the last one down, twice the estimate less that layer's. Even ones read the last layer."""
    widths = layer_widths(width, len(sketch))
    odd, even = keys.where(parity(F.col("key")) == 1), keys.where(parity(F.col("key")) == 0)
    top = len(sketch) - 2
    out = query(odd, sketch[top], depth, widths[top], "median")
    for k in range(top - 1, -1, -1):
        lower = query(odd, sketch[k], depth, widths[k], "median").withColumnRenamed("estimate", "__e")
        out = out.join(lower, "key").select("key", (2 * F.col("estimate") - F.col("__e")).alias("estimate"))
    return out.unionByName(query(even, sketch[-1], depth, widths[-1], "median"))


def estimates(df: DataFrame, key: str, kind: str, depth: int = 5, width: int = 1000, layers: int = 10) -> DataFrame:
    """(key, estimate) of every distinct key under one of cms, median, univmon, nitro."""
    keys = df.select(F.col(key).alias("key")).distinct()
    if kind == "univmon":
        return univmon_query(keys, univmon(df, key, depth, width, layers), depth, width)
    bucket = fast_bucket if kind == "nitro" else sha_bucket
    return query(keys, build(df, key, depth, width, bucket), depth, width, "median" if kind == "median" else "min", bucket)


def heavy_hitters(df: DataFrame, key: str, kind: str, share: float = 0.001, **shape: int) -> DataFrame:
    """(hitters, total): distinct keys whose estimate is at least `share` of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return estimates(df, key, kind, **shape).crossJoin(F.broadcast(total)).groupBy("total").agg(F.sum(F.when(F.col("estimate") >= F.col("total") * share, 1).otherwise(0)).alias("hitters")).select("hitters", "total")


def relative_error(raw: DataFrame, syn: DataFrame, key: str, kind: str, share: float = 0.001, **shape: int) -> DataFrame:
    """|s - r| / r for the shares of heavy hitters in the synthetic and the raw rows; infinite if r is 0."""
    r, s = (heavy_hitters(x, key, kind, share, **shape).select((F.col("hitters") / F.col("total")).alias(n)) for x, n in ((raw, "r"), (syn, "s")))
    return r.crossJoin(s).select(F.lit(kind).alias("sketch"), F.when(F.col("r") == 0, F.lit(float("inf"))).otherwise(F.abs(F.col("s") - F.col("r")) / F.when(F.col("r") != 0, F.col("r"))).alias("error"))


SHAPES = {"nitro": {"depth": 5, "width": 100}, "univmon": {"depth": 5, "width": 1000, "layers": 10}, "cms": {"depth": 5, "width": 1000}, "median": {"depth": 5, "width": 1000}}


def report(raw: DataFrame, syn: DataFrame, key: str = "dstip", share: float = 0.001) -> DataFrame:
    """Relative errors of all four sketches."""
    from functools import reduce

    return reduce(DataFrame.union, (relative_error(raw, syn, key, kind, share, **shape) for kind, shape in SHAPES.items()))
