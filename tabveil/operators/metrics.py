"""Distances between raw and synthetic tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _shares(a: DataFrame, b: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Shares p and q of every combination that occurs on either side; nulls are a value like others."""
    count = F.sum(weight) if weight else F.count("*")
    both = a.select(*keys, *([weight] if weight else []), F.lit(1).alias("__s")).unionByName(b.select(*keys, *([weight] if weight else []), F.lit(0).alias("__s")))
    one = both.groupBy(*keys, "__s").agg(count.cast("double").alias("__c"))
    cells = one.groupBy(*keys).agg(F.sum(F.col("__c") * F.col("__s")).alias("__a"), F.sum(F.col("__c") * (1 - F.col("__s"))).alias("__b"))
    total = cells.agg(F.sum("__a").alias("__ta"), F.sum("__b").alias("__tb"))
    return cells.crossJoin(F.broadcast(total)).select(*keys, (F.col("__a") / F.col("__ta")).alias("p"), (F.col("__b") / F.col("__tb")).alias("q"))


def l1(a: DataFrame, b: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    return _shares(a, b, keys, weight).agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("l1"))


def jsd(a: DataFrame, b: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """The root of the Jensen-Shannon divergence, with natural logarithms."""
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(2 * F.col(x) / (F.col("p") + F.col("q")))).otherwise(0.0)
    return _shares(a, b, keys, weight).agg(F.sqrt(F.greatest(F.sum(part("p") + part("q")) / 2, F.lit(0.0))).alias("jsd"))


def emd(a: DataFrame, b: DataFrame, fields: Sequence[str], at_once: int = 1_000_000) -> DataFrame:
    """(field, emd): the area between the two distribution functions, for all fields in one job.

    Each field's distinct values are summed before they are sorted. A field of more than `at_once` of them is cut into buckets
    of equal width, which are summed first, so that no task sorts a whole field.
    """
    stacked = [x.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields))).alias("e"), F.lit(s).alias("s")).select("e.*", "s").where("x is not null") for x, s in ((a, 1), (b, 0))]
    one = stacked[0].union(stacked[1]).groupBy("field", "x").agg(F.sum("s").alias("a"), F.sum(1 - F.col("s")).alias("b"))
    spans = one.groupBy("field").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.ceil(F.count("*") / at_once).alias("n"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    wide = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("n")), F.col("n") - 1)).otherwise(0)
    one = one.join(F.broadcast(spans), "field").withColumn("bucket", F.coalesce(wide, F.lit(0)))
    per = one.groupBy("field", "bucket").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.min("x").alias("begin"))  # a row a bucket
    row = Window.partitionBy("field").orderBy("bucket")
    before = lambda c: F.coalesce(F.sum(c).over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("field", "bucket", before("sa").alias("ba"), before("sb").alias("bb"), F.lead("begin").over(row).alias("next"))
    w = Window.partitionBy("field", "bucket").orderBy("x")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c: (F.col(f"b{c}") + F.sum(c).over(upto)) / F.when(F.col(f"n{c}") > 0, F.col(f"n{c}"))
    gap = F.abs(share("a") - share("b")) * (F.coalesce(F.lead("x").over(w), F.col("next")) - F.col("x"))
    return one.join(F.broadcast(per), ["field", "bucket"]).select("field", gap.alias("d")).groupBy("field").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("emd"))


def normalized_emd(distances: DataFrame) -> DataFrame:
    """Distances scaled over the fields to 0.1 .. 0.9; null if all are equal."""
    every = Window.partitionBy()
    low, high = F.min("emd").over(every), F.max("emd").over(every)
    return distances.withColumn("normalized", F.when(high > low, 0.1 + 0.8 * (F.col("emd") - low) / (high - low)))


def with_flow_size(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the number of rows of its key. Counts are joined back, so one frequent key isn't sorted into one task."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("flow_size"))
    near = None
    renamed = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), "flow_size")
    for k in keys:
        near = df[k].eqNullSafe(renamed[f"__{k}"]) if near is None else near & df[k].eqNullSafe(renamed[f"__{k}"])
    return df.join(renamed, near).drop(*(f"__{k}" for k in keys))


FLOW_KEY = ("srcip", "dstip", "srcport", "dstport", "proto")


def report(raw: DataFrame, syn: DataFrame, jsd_fields: Sequence[str], emd_fields: Sequence[str]) -> DataFrame:
    """(metric, field, value, normalized) for one pair of tables."""
    spark = raw.sparkSession
    rows = [("jsd", f, jsd(raw, syn, [f]).first()[0], None) for f in jsd_fields]
    rows += [("emd", r["field"], r["emd"], r["normalized"]) for r in normalized_emd(emd(raw, syn, emd_fields)).collect()]
    return spark.createDataFrame(rows, "metric string, field string, value double, normalized double")


def flow_report(raw: DataFrame, syn: DataFrame) -> DataFrame:
    return report(raw, syn, FLOW_KEY, ("ts", "td", "pkt", "byt"))


def packet_report(raw: DataFrame, syn: DataFrame) -> DataFrame:
    """Packets: times in milliseconds, and the size of each packet's flow."""
    a, b = (with_flow_size(x.withColumn("time_ms", F.col("time") / 1e6), FLOW_KEY) for x in (raw, syn))
    return report(a, b, FLOW_KEY, ("pkt_len", "time_ms", "flow_size"))
