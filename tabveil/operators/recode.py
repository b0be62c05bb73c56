"""Grouping of rare codes: one code for all whose noisy count is under three standard deviations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.operators.marginals import local
from tabveil.operators.nonneg import cut_array, norm_cut
from tabveil.operators.quota import fill, ordered


def recode_map(marginal: DataFrame, attr: str, sigma: float) -> DataFrame:
    """(old_code, new_code, is_group) from a noisy one-way marginal (attr, cell, count).

    Kept codes are renumbered in their order; all others get the next code. Without a rare code nothing changes.
    """
    clean = norm_cut(marginal).select(F.col(attr).alias("old_code"), (F.col("count") < 3 * sigma).alias("is_group"))
    upto = Window.orderBy("old_code").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    kept = F.when(F.col("is_group"), 0).otherwise(1)
    number = F.when(F.col("is_group"), F.sum(kept).over(every)).otherwise(F.sum(kept).over(upto) - 1)
    return clean.select("old_code", number.cast("int").alias("new_code"), "is_group")


def map_array(counts: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """recode_map on an array of noisy counts: old codes, new codes, whether grouped."""
    group = cut_array(counts) < 3 * sigma
    return np.arange(len(counts)), np.where(group, (~group).sum(), np.cumsum(~group) - 1), group


def recode(df: DataFrame, attr: str, mapping: DataFrame) -> DataFrame:
    """Replace an attribute's codes; the map has one row for each code of a domain that fits a marginal. Other codes are an error."""
    m = mapping.select(F.col("old_code").alias("__old"), F.col("new_code").alias("__new"))
    out = df.join(F.broadcast(m), F.col(attr) == F.col("__old"), "left")
    unknown = F.raise_error(F.concat(F.lit(f"{attr} has a code that its map lacks: "), F.coalesce(F.col(attr).cast("string"), F.lit("null"))))
    out = out.withColumn("__new", F.coalesce(F.col("__new"), unknown.cast("int")))
    return out.withColumn(attr, F.col("__new")).drop("__old", "__new")


def decode(df: DataFrame, attr: str, mapping: DataFrame, key: Column, sizes: DataFrame | None = None, spread: Column | None = None) -> DataFrame:
    """Kept codes back; the rows of the group code are shared out equally, in the order of `key`, over the grouped codes.

    `sizes`, (code, count) of the attribute, spares a second reading of the rows.
    """
    m = mapping.select(F.col("old_code").alias("__old"), F.col("new_code").alias("__new"), "is_group")
    every = Window.partitionBy("__new")
    m = m.withColumn("__i", F.row_number().over(every.orderBy("__old"))).withColumn("__m", F.count("*").over(every))
    sizes = df.groupBy(F.col(attr).alias("__new")).agg(F.count("*").alias("__n")) if sizes is None else sizes.toDF("__new", "__n")
    m = m.join(F.broadcast(sizes), "__new")
    edge = lambda i: F.rint(F.round(i / F.col("__m"), 12) * F.col("__n")).cast("long")
    m = m.select("__new", "__old", edge(F.col("__i") - 1).alias("__from"), edge(F.col("__i")).alias("__to"))
    # only the group code stands for several: its rows get places, all others their one old code
    group = local(m.where("is_group"))
    alone = m.where("not is_group").select("__new", "__old")
    new = group.select("__new").distinct()
    several = df.join(F.broadcast(new), F.col(attr) == F.col("__new"), "left_semi")
    placed = ordered(several, key, [attr], "__place", spread)
    cuts = group.select(F.col("__new").alias(attr), "__old", F.col("__from").alias("first"), F.col("__to").alias("last"))
    shared = fill(placed, cuts, ["__old"], "__place", [attr])
    kept = df.join(F.broadcast(alone), F.col(attr) == F.col("__new"))
    out = [x.withColumn(attr, F.col("__old")).select(*df.columns) for x in (kept, shared)]
    return out[0].union(out[1])
