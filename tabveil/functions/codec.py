"""Reversible encoding of raw columns as codes from 0: dictionaries are tables, everything else is an expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabveil.config import FieldSpec
from tabveil.domain import Domain
from tabveil.functions.binning import bin_exponential, bin_integer, bin_ip, bin_port, unbin

LOCAL_VALUES = 100_000  # distinct values of all columns together that are numbered on the driver
LITERALS = 64  # values that are looked up in a literal array instead of a joined table
BROADCAST_ROWS = 1_000_000
TS_DIFF = "ts_diff"


def dictionary(df: DataFrame, value: Column) -> DataFrame:
    """(raw, code): distinct values numbered from 0 in their order. Nulls have no code.

    A distributed sort; a value's number is its place in its partition after the sizes of earlier ones.
    """
    ordered = df.select(value.alias("raw")).where("raw is not null").distinct().orderBy("raw")
    placed = ordered.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33)).persist()
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = sizes.select("__p", before.alias("__before"))
    number = F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(offsets), "__p").select("raw", number.cast("int").alias("code"))


def distinct_values(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, list] | None:
    """The sorted values of each column from one job; None if all columns together have more than LOCAL_VALUES."""
    names = list(columns)
    stacked = df.select(*(c.alias(n) for n, c in columns.items()))
    grouped = stacked.groupingSets([[F.col(n)] for n in names], *names).agg(F.grouping_id().alias("__g"))
    rows = grouped.limit(LOCAL_VALUES + 1).collect()
    if len(rows) > LOCAL_VALUES:
        return None
    out: dict[str, list] = {n: [] for n in names}
    mask = {(1 << len(names)) - 1 - (1 << (len(names) - 1 - k)): n for k, n in enumerate(names)}
    for r in rows:
        if r[mask[r["__g"]]] is not None:
            out[mask[r["__g"]]].append(r[mask[r["__g"]]])
    return {n: sorted(v, key=lambda x: (x != x, x)) for n, v in out.items()}  # as Spark sorts: NaN last


def table_of(spark: SparkSession, values: list, kind: str) -> DataFrame:
    """(raw, code) of sorted values."""
    return spark.createDataFrame(list(zip(values, range(len(values)), strict=True)), f"raw {kind}, code int")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has few rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lookup(df: DataFrame, value: Column, codes: DataFrame, to: str) -> DataFrame:
    codes = codes.select(F.col("raw").alias("__r"), F.col("code").alias("__c"))
    joined = df.withColumn("__raw", value).join(codes, F.col("__raw") == F.col("__r"), "left")
    return joined.withColumn(to, F.col("__c")).drop("__raw", "__r", "__c")


def labels(df: DataFrame, columns: Mapping[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """The table with codes of the columns' values under the given names, and how many codes each has."""
    spark = df.sparkSession
    kinds = dict(df.select(*(c.alias(n) for n, c in columns.items())).dtypes)
    values = distinct_values(df, columns)
    out, later, sizes = df, {}, {}
    for n, c in columns.items():
        if values is None:
            codes = dictionary(df, c)
            sizes[n] = codes.count()
            out, later[f"__to_{n}"] = lookup(out, c, F.broadcast(codes) if sizes[n] <= BROADCAST_ROWS else codes, f"__to_{n}"), n
        elif len(values[n]) <= LITERALS:
            sizes[n] = len(values[n])
            place = F.array_position(F.array(*(F.lit(v).cast(kinds[n]) for v in values[n])), c) - 1 if values[n] else F.lit(None)
            out, later[f"__to_{n}"] = out.withColumn(f"__to_{n}", place.cast("int")), n
        else:
            sizes[n] = len(values[n])
            out, later[f"__to_{n}"] = lookup(out, c, F.broadcast(table_of(spark, values[n], kinds[n])), f"__to_{n}"), n
    kept = [c for c in df.columns if c not in columns]
    order = [c if c not in columns else f"__to_{c}" for c in df.columns] + [f"__to_{n}" for n in columns if n not in df.columns]
    return out.select(*(F.col(f"`{c}`") if c in kept else F.col(f"`{c}`").alias(later[c]) for c in order)), sizes


def label(df: DataFrame, column: str, value: Column | None = None, to: str | None = None) -> DataFrame:
    """The table with a column's dictionary codes."""
    return labels(df, {to or column: F.col(column) if value is None else value})[0]


def epoch(c: Column, kind: str) -> Column:
    """Timestamps as microseconds; integers as they are."""
    return F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c.cast("long")


@dataclass
class CodecModel:
    """What encoding learned from the raw table: dictionaries, first timestamps, least bins, and the domain."""

    fields: dict[str, FieldSpec]
    domain: Domain
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)
    firsts: dict[str, int] = field(default_factory=dict)
    lows: dict[str, int] = field(default_factory=dict)

    def encode(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Codes of all fields in the domain's order, after the columns to keep; ts_diff, if there is a timestamp, comes last."""
        kinds = dict(df.dtypes)
        out = df
        for c, first in self.firsts.items():
            spec = self.fields[c]
            if spec.diff_bin:
                since = (epoch(F.col(c), kinds[c]) - first) % int(spec.bin)
                out = out.withColumn(TS_DIFF, bin_integer(since, spec.diff_bin).cast("int"))
        for c, spec in self.fields.items():
            out = out.withColumn(c, binned(F.col(c), spec, kinds[c], self.firsts.get(c)))
            if c in self.lows:
                out = out.withColumn(c, (F.col(c) - self.lows[c]).cast("int"))
        for c, table in self.dictionaries.items():
            out = lookup(out, F.col(c), F.broadcast(table) if self.domain[c] <= BROADCAST_ROWS else table, c)
        return out.select(*keep, *(F.col(a).cast("int").alias(a) for a in self.domain.attrs))

    def decode(self, df: DataFrame, seed: int | None = None, use_diff: bool = False) -> DataFrame:
        """Random raw values in each code's bin; unknown codes become 0, ts_diff is dropped, or with use_diff added to its timestamp."""
        out = df
        for k, (c, spec) in enumerate(self.fields.items()):
            s = None if seed is None else seed + k
            if c in self.dictionaries:
                codes = self.dictionaries[c].select(F.col("code").alias("__c"), F.col("raw").alias("__r"))
                codes = F.broadcast(codes) if self.domain[c] <= BROADCAST_ROWS else codes
                out = out.join(codes, F.col(c) == F.col("__c"), "left").withColumn(c, F.col("__r")).drop("__r", "__c")
            if c in self.lows:
                out = out.withColumn(c, F.col(c) + self.lows[c])
            if spec.kind != "categorical":
                first = F.lit(self.firsts[c]) if c in self.firsts else None
                raw = unbin(spec.kind, F.col(c), spec.bin, spec.threshold, first, spec.diff_bin, s)
                if c in self.firsts and use_diff and TS_DIFF in df.columns:
                    raw = raw + (F.col(TS_DIFF) - 1) * F.lit(int(spec.diff_bin))
                out = out.withColumn(c, raw)
        out = out.drop(TS_DIFF)
        numbers = [c for c, t in out.dtypes if t in ("double", "float")]
        for c in numbers:
            out = out.withColumn(c, F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c)))
        return out.na.fill(0)


def binned(c: Column, spec: FieldSpec, kind: str, first: int | None = None) -> Column:
    if spec.kind == "binned-ip":
        return bin_ip(c, int(spec.bin))
    if spec.kind == "binned-port":
        return bin_port(c, spec.threshold, int(spec.bin))
    if spec.kind == "binned_integer":
        return bin_integer(c.cast("long"), spec.bin)
    if spec.kind == "timestamp":
        return bin_integer(epoch(c, kind) - F.lit(first or 0), spec.bin)
    if spec.kind.endswith("exponential"):
        return bin_exponential(c.cast("long") if spec.kind == "int-exponential" else c.cast("double"), spec.bin)
    return c


def fit(df: DataFrame, fields: Mapping[str, FieldSpec]) -> CodecModel:
    """One job for the first timestamps, one for all least and largest bins, one for all dictionaries that are small together."""
    unknown = [c for c in fields if c not in df.columns]
    if unknown:
        raise KeyError(f"no such columns: {unknown}")
    kinds = dict(df.dtypes)
    stamps = [c for c, s in fields.items() if s.kind == "timestamp"]
    firsts = df.agg(*(F.min(epoch(F.col(c), kinds[c])).alias(c) for c in stamps)).first().asDict() if stamps else {}
    ranged = [c for c, s in fields.items() if s.kind in ("binned_integer", "timestamp") or s.kind.endswith("exponential")]
    values = {c: binned(F.col(c), fields[c], kinds[c], firsts.get(c)) for c in ranged}
    got = df.agg(*(f(values[c]).cast("long").alias(f"{n}_{c}") for c in ranged for n, f in (("low", F.min), ("high", F.max)))).first() if ranged else {}
    sizes, lows, tables = {}, {}, {}
    listed = {c: binned(F.col(c), s, kinds[c]) for c, s in fields.items() if c not in ranged}
    found = distinct_values(df, listed) if listed else {}
    for c, s in fields.items():
        if c in ranged:
            low = got[f"low_{c}"] if s.kind.endswith("exponential") else 0
            if s.kind.endswith("exponential"):
                lows[c] = low or 0
            sizes[c] = (got[f"high_{c}"] or 0) - (low or 0) + 1
        else:
            raw = dict(df.select(listed[c].alias("raw")).dtypes)["raw"]
            tables[c] = dictionary(df, listed[c]) if found is None else table_of(df.sparkSession, found[c], raw)
            sizes[c] = tables[c].count() if found is None else len(found[c])
    for c in stamps:
        if fields[c].diff_bin:
            sizes[TS_DIFF] = int(fields[c].bin // fields[c].diff_bin) + 1
    return CodecModel(dict(fields), Domain.from_dict(sizes), tables, firsts, lows)


def bin_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, low, high, mean) of all columns in one job."""
    aggs = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("n", F.count), ("low", F.min), ("high", F.max), ("mean", F.avg))]
    return df.agg(*aggs).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high"), F.col(f"mean_{c}").alias("mean")) for c in columns))).alias("e")).select("e.*")
