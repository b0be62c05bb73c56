"""How far each pair of attributes is from independence."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.domain import Domain
from tabveil.operators.marginals import count_views


def pair_dependence(df: DataFrame, domain: Domain, attrs: Sequence[str] | None = None) -> DataFrame:
    """(first_attr, second_attr, num_cells, error): the sum over all cells of |P(a, b) - P(a) P(b)|.

    Only combinations that occur are made: the cells that don't add up to 1 - sum of P(a) P(b) over those that do.
    All pairs come from one scan, and single attributes and the total from the pairs' cells. Rows with a null in a pair
    count in its total only.
    """
    attrs = list(attrs or domain.attrs)
    pairs = list(combinations(attrs, 2))
    wide = Domain.from_dict({a: domain[a] + 1 for a in attrs})  # a null is the code after the last one
    filled = df.select(*(F.coalesce(F.col(a), F.lit(domain[a])).alias(a) for a in attrs))
    names = df.sparkSession.createDataFrame([(k, f"{a},{b}", a, b, domain[a], domain[b]) for k, (a, b) in enumerate(pairs)], "k int, view string, first_attr string, second_attr string, size_a long, size_b long")
    two = count_views(filled, wide, pairs).withColumnRenamed("view", "k").join(F.broadcast(names), "k")
    known = lambda code, size: F.when(code < F.col(size), code)
    two = two.select("view", "first_attr", "second_attr", known(F.expr("cell div (size_b + 1)"), "size_a").alias("a"), known(F.expr("cell % (size_b + 1)"), "size_b").alias("b"), F.col("count").alias("c"))
    over = lambda *by: F.sum("c").over(Window.partitionBy("view", *by)).cast("double")
    both = two.withColumn("ca", over("a")).withColumn("cb", over("b")).withColumn("n", over()).where("a is not null and b is not null")
    p, q = F.col("c") / F.col("n"), F.col("ca") / F.col("n") * (F.col("cb") / F.col("n"))
    error = F.sum(F.abs(p - q)) + 1 - F.sum(q)
    size = F.create_map(*(F.lit(v) for (a, b) in pairs for v in (f"{a},{b}", int(domain[a]) * int(domain[b]))))
    return both.groupBy("first_attr", "second_attr", "view").agg(error.alias("error")).select("first_attr", "second_attr", F.element_at(size, F.col("view")).cast("long").alias("num_cells"), "error")


def connect_isolated(dependence: DataFrame, attrs: Sequence[str], selected: Sequence[str]) -> DataFrame:
    """(attr, first_attr, second_attr): for each attribute not selected, its pair of highest error with a selected one."""
    missing = [a for a in attrs if a not in selected]
    ends = dependence.withColumn("attr", F.explode(F.array("first_attr", "second_attr"))).withColumn("other", F.when(F.col("attr") == F.col("first_attr"), F.col("second_attr")).otherwise(F.col("first_attr")))
    ends = ends.where(F.col("attr").isin(missing) & F.col("other").isin(list(selected)))
    best = Window.partitionBy("attr").orderBy(F.col("error").desc(), "first_attr", "second_attr")
    return ends.withColumn("r", F.row_number().over(best)).where("r = 1").select("attr", "first_attr", "second_attr")
