"""Counts over combinations of attributes. Marginals are long tables (attributes, cell, count)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabveil.domain import Domain

DENSE_CELLS = 10_000_000
SETS_AT_ONCE = 30
COUNTED_CELLS = 20_000_000  # 8 bytes each in a task


def cell_of(domain: Domain, attrs: Sequence[str]) -> Column:
    """Row-major id of a cell."""
    return reduce(lambda a, b: a + b, (F.col(a).cast("long") * w for a, w in zip(attrs, domain.weights(attrs), strict=True)), F.lit(0).cast("long"))


def cells(spark: SparkSession, domain: Domain, attrs: Sequence[str]) -> DataFrame:
    """Every cell with its codes, by arithmetic on a range."""
    n = domain.size(attrs)
    if n > DENSE_CELLS:
        raise ValueError(f"{n} cells are too many to list; the limit is {DENSE_CELLS}")
    out = spark.range(n).select(F.col("id").alias("cell"))
    return out.select(*((F.floor(F.col("cell") / w) % domain[a]).cast("int").alias(a) for a, w in zip(attrs, domain.weights(attrs), strict=True)), "cell")


def local(marginal: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """A marginal computed once and held by the plan itself, if it has few rows; else as it was."""
    rows = marginal.limit(limit + 1).toArrow()
    return marginal.sparkSession.createDataFrame(rows) if rows.num_rows <= limit else marginal


def observed(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Counts of the combinations that occur: a partial count in each task, then one shuffle of those."""
    return df.groupBy(*attrs).agg(F.count("*").alias("count"))


def dense(df: DataFrame, domain: Domain, attrs: Sequence[str]) -> DataFrame:
    """Counts of all cells, zeros included. Codes outside the domain raise an error."""
    bad = reduce(lambda a, b: a | b, (F.col(a).isNull() | (F.col(a) < 0) | (F.col(a) >= domain[a]) for a in attrs))
    counts = observed(df, attrs).select(F.when(bad, F.raise_error(F.lit(f"a code lies outside the domain of {tuple(attrs)}"))).otherwise(cell_of(domain, attrs)).alias("cell"), "count")
    return cells(df.sparkSession, domain, attrs).join(counts, "cell", "left").select(*attrs, "cell", F.coalesce("count", F.lit(0)).cast("double").alias("count"))


def count_sets(df: DataFrame, sets: Iterable[Sequence[str]]) -> DataFrame:
    """Counts for many sets of attributes in few scans: columns of all attributes (null where unused), view and count.

    Grouping sets multiply rows by their number before the partial count, hence at most SETS_AT_ONCE of them a scan.
    """
    sets = [tuple(s) for s in sets]
    attrs = list(dict.fromkeys(a for s in sets for a in s))
    out = []
    for k in range(0, len(sets), SETS_AT_ONCE):
        part = sets[k : k + SETS_AT_ONCE]
        used = [a for a in attrs if any(a in s for s in part)]
        grouped = df.select(*used).groupingSets([[F.col(a) for a in s] for s in part], *used).agg(F.grouping_id().alias("__g"), F.count("*").alias("count"))
        name = {sum(1 << (len(used) - 1 - i) for i, a in enumerate(used) if a not in s): ",".join(s) for s in part}
        view = F.element_at(F.create_map(*(F.lit(x) for kv in name.items() for x in (int(kv[0]), kv[1]))), F.col("__g").cast("int"))
        out.append(grouped.select(*(F.col(a) if a in used else F.lit(None).cast(df.schema[a].dataType).alias(a) for a in attrs), view.alias("view"), "count"))
    return reduce(DataFrame.unionByName, out)


def count_views(df: DataFrame, domain: Domain, sets: Iterable[Sequence[str]]) -> DataFrame:
    """(view, cell, count) of the cells that occur in many marginals; a view is a set's place. Nulls belong to no cell.

    One scan. Each task adds to an array of all cells, unless there are more than COUNTED_CELLS: then a row becomes one for each set.
    """
    sets = [tuple(s) for s in sets]
    weights = [np.array(domain.weights(s), np.int64) for s in sets]
    ends = np.cumsum([0, *(domain.size(s) for s in sets)], dtype=object)
    if ends[-1] > COUNTED_CELLS:
        keys = F.array(*(F.struct(F.lit(k).alias("view"), cell_of(domain, s).alias("cell")) for k, s in enumerate(sets)))
        return df.select(F.explode(keys).alias("k")).select("k.*").where("cell is not null").groupBy("view", "cell").agg(F.count("*").alias("count"))
    attrs = list(dict.fromkeys(a for s in sets for a in s))
    sizes, ends = domain.sizes, ends.astype(np.int64)

    def count(batches):
        total = np.zeros(ends[-1], np.int64)
        for batch in batches:
            held, known = {}, {}
            for a in attrs:
                column = batch.column(a)
                known[a] = None if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
                held[a] = (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False).astype(np.int64)
                if len(held[a]) and (held[a].min() < 0 or held[a].max() >= sizes[a]):
                    raise ValueError(f"a code lies outside the domain of {a}")
            for s, w, at, end in zip(sets, weights, ends, ends[1:], strict=False):
                cell = sum((held[a] * k for a, k in zip(s, w, strict=True)), np.zeros(batch.num_rows, np.int64))
                some = [known[a] for a in s if known[a] is not None]
                cell = cell[np.logical_and.reduce(some)] if some else cell
                if end - at <= batch.num_rows:
                    total[at:end] += np.bincount(cell, minlength=end - at)
                else:
                    np.add.at(total, cell + at, 1)
        found = np.flatnonzero(total)
        view = np.searchsorted(ends, found, "right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array(found - ends[view]), pa.array(total[found])], ["view", "cell", "count"])

    columns = df.select(*(F.col(a).cast("int").alias(a) for a in attrs)) if attrs else df.select(F.lit(0).alias("none"))
    return columns.mapInArrow(count, "view int, cell long, count long").groupBy("view", "cell").agg(F.sum("count").alias("count"))


def count_cells(df: DataFrame, domain: Domain, sets: Iterable[Sequence[str]]) -> tuple[DataFrame, list[int]]:
    """(key, count) of the cells that occur in many marginals, and the first key of each; a key is that plus the cell."""
    sets = [tuple(s) for s in sets]
    first = [0]
    for s in sets:
        first.append(first[-1] + domain.size(s))
    start = F.element_at(F.array(*(F.lit(k).cast("long") for k in first)), F.col("view") + 1)
    return count_views(df, domain, sets).select((start + F.col("cell")).alias("key"), "count"), first[:-1]


def normalize(marginal: DataFrame, value: str = "count") -> DataFrame:
    total = marginal.agg(F.sum(value).alias("__total"))
    return marginal.crossJoin(F.broadcast(total)).withColumn("share", F.col(value) / F.when(F.col("__total") != 0, F.col("__total"))).drop("__total")


def roll_up(marginal: DataFrame, attrs: Sequence[str], value: str = "count") -> DataFrame:
    """A smaller marginal from a bigger one."""
    return marginal.groupBy(*attrs).agg(F.sum(value).alias(value))


def rolled_weight(domain: Domain, attrs: Sequence[str], onto: Sequence[str]) -> float:
    """1 over the cells that fall together when `attrs` is rolled up onto `onto`."""
    return 1.0 / domain.project(attrs).marginalize(onto).size()


def matrix(marginal: DataFrame, row: str, column: str, values: Sequence[int], value: str = "count") -> DataFrame:
    """One attribute against another; column k holds code k."""
    return marginal.groupBy(row).pivot(column, list(values)).agg(F.sum(value))


def having(marginal: DataFrame, least: float, value: str = "count") -> DataFrame:
    return marginal.where(F.col(value) >= least)


def sorted_counts(marginal: DataFrame, value: str = "count") -> DataFrame:
    """All of a marginal, largest counts first."""
    return marginal.orderBy(F.col(value).desc(), *[c for c in marginal.columns if c != value])


def dump(marginal: DataFrame, path: str, value: str = "count") -> None:
    """A marginal as one CSV, largest counts first."""
    sorted_counts(marginal, value).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def from_lists(spark: SparkSession, lists: dict[str, Sequence]) -> DataFrame:
    """The product of given value lists, as small tables."""
    frames = [spark.createDataFrame([(x,) for x in v], [a]) for a, v in lists.items()]
    out = reduce(lambda a, b: a.crossJoin(b), frames)
    return out.withColumn("cell", F.row_number().over(Window.orderBy(*lists)).cast("long") - 1)
