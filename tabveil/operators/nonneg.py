"""Non-negative counts with an unchanged total, as prefix sums over a marginal, and the same on arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def norm_cut(marginal: DataFrame, value: str = "count", key: str = "cell") -> DataFrame:
    """Negative counts become 0, and their sum is taken from the smallest positive ones, in the order of count and cell."""
    below = Window.orderBy(value, key).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    positive = F.sum(F.greatest(v, F.lit(0.0))).over(below)
    negative = F.sum(F.greatest(-v, F.lit(0.0))).over(Window.partitionBy())
    return marginal.withColumn("__p", positive).withColumn("__n", negative).withColumn(value, F.when(v <= 0, 0.0).otherwise(F.least(v, F.greatest(F.lit(0.0), F.col("__p") - F.col("__n"))))).drop("__p", "__n")


def norm_sub(marginal: DataFrame, value: str = "count", key: str = "cell") -> DataFrame:
    """One amount is taken from every count, and what falls below 0 is set to 0, so that the total stays; 0 if it isn't positive."""
    above = Window.orderBy(F.col(value).desc(), key).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    v = F.col(value)
    df = marginal.withColumn("__s", F.sum(value).over(every)).withColumn("__c", F.sum(value).over(above)).withColumn("__r", F.count("*").over(above))
    df = df.withColumn("__d", (F.col("__c") - F.col("__s")) / F.col("__r"))
    # the amount grows with the rank while counts exceed it: the last such rank has the largest
    df = df.withColumn("__d", F.max(F.when(v > F.col("__d"), F.struct("__r", "__d"))).over(every)["__d"])
    out = F.when(F.col("__s") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), v - F.col("__d")))
    return df.withColumn(value, out).drop("__s", "__c", "__r", "__d")


def apply(marginal: DataFrame, method: str, iteration: int = 0) -> DataFrame:
    """N1: norm_cut; N2: norm_sub; N3: norm_sub in the first 400 rounds, then norm_cut."""
    if method not in ("N1", "N2", "N3"):
        raise ValueError(f"unknown method {method}")
    return norm_cut(marginal) if method == "N1" or method == "N3" and iteration >= 400 else norm_sub(marginal)


def cut_array(v: np.ndarray) -> np.ndarray:
    by = np.argsort(v, kind="stable")
    sums = np.cumsum(np.maximum(v[by], 0))
    out = np.empty_like(v, dtype=float)
    out[by] = np.minimum(np.maximum(v[by], 0), np.maximum(0, sums - np.maximum(-v, 0).sum()))
    return out


def sub_array(v: np.ndarray) -> np.ndarray:
    total = v.sum()
    if total <= 0:
        return np.zeros_like(v, dtype=float)
    x = np.sort(v)[::-1]
    d = (np.cumsum(x) - total) / np.arange(1, len(x) + 1)
    return np.maximum(0, v - d[np.flatnonzero(x > d)[-1]])


def apply_array(v: np.ndarray, method: str, iteration: int = 0) -> np.ndarray:
    if method not in ("N1", "N2", "N3"):
        raise ValueError(f"unknown method {method}")
    return cut_array(v) if method == "N1" or method == "N3" and iteration >= 400 else sub_array(v)
