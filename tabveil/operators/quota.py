"""Quotas: turning shares into whole numbers of rows by rounded prefix sums (halves to even)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def boundaries(marginal: DataFrame, n: int | Column, order: Sequence[str], value: str = "count", within: Sequence[str] = ()) -> DataFrame:
    """`first` and `last` (exclusive) row of each cell: a marginal's cells in an order, n rows for each group of `within`."""
    group = Window.partitionBy(*within)
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(group)
    share = F.when(total != 0, F.sum(value).over(upto) / total).otherwise(F.row_number().over(group.orderBy(*order)) / F.count("*").over(group))
    df = marginal.withColumn("last", F.rint(F.round(share, 12) * n).cast("long"))
    return df.withColumn("first", F.coalesce(F.lag("last").over(group.orderBy(*order)), F.lit(0).cast("long")))


def fill(rows: DataFrame, cuts: DataFrame, attrs: Sequence[str], place: str = "row_id", on: Sequence[str] = ()) -> DataFrame:
    """Give each row the attributes of the cell whose interval its place lies in.

    Intervals are cut at blocks of about their mean length, so that rows meet theirs in a hash join by block; there are at
    most twice as many pieces as intervals, and few of them are broadcast.
    """
    spark = rows.sparkSession
    cuts = cuts.where("last > first").select(*(F.col(c).alias(f"__{c}") for c in on), *attrs, F.col("first").alias("__first"), F.col("last").alias("__last"))
    held = cuts.limit(BROADCAST_ROWS + 1).toArrow()
    few = held.num_rows <= BROADCAST_ROWS
    cuts = spark.createDataFrame(held) if few else cuts
    total, n = cuts.agg(F.sum(F.col("__last") - F.col("__first")), F.count("*")).first()
    size = max(1, int(total or 0) // max(1, n))
    pieces = cuts.withColumn("__block", F.explode(F.sequence(F.expr(f"__first div {size}"), F.expr(f"(__last - 1) div {size}"))))
    near = (F.col("__at") == F.col("__block")) & (F.col(place) >= F.col("__first")) & (F.col(place) < F.col("__last"))
    for c in on:
        near &= F.col(c) == F.col(f"__{c}")
    joined = rows.withColumn("__at", F.expr(f"`{place}` div {size}")).join(F.broadcast(pieces) if few else pieces, near)
    return joined.select(*rows.columns, *attrs)


def ordered(df: DataFrame, key: Column, by: Sequence[str] = (), name: str = "place", spread: Column | None = None, at_once: int = 1_000_000) -> DataFrame:
    """0-based places within groups in the order of `key`.

    `spread` is a number that never falls as the key grows, the key itself if that is a number. More than `at_once` rows are
    dealt to buckets of it: a place is a rank within group and bucket plus the rows of the group's earlier buckets, so that a
    group with a third of all rows is sorted by many tasks.
    """
    place = lambda *more: F.row_number().over(Window.partitionBy(*by, *more).orderBy(key)).cast("long") - 1
    if spread is None and df.select(key.alias("k")).dtypes[0][1] in ("int", "bigint"):
        spread = key
    low, high, n = df.agg(F.min(spread), F.max(spread), F.count("*")).first() if spread is not None else (None, None, 0)
    if n <= at_once or low is None:
        return df.withColumn(name, place())
    buckets = 4 * -(-n // at_once)
    share = (spread.cast("double") - float(low)) / (float(high) - float(low) + 1.0)
    dealt = df.withColumn("__bucket", F.coalesce(F.least(F.floor(share * buckets), F.lit(buckets - 1)), F.lit(-1)))
    sizes = dealt.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before"))
    near = F.col("__bucket") == F.col("__b")
    for c in by:
        near &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return dealt.join(F.broadcast(offsets), near).withColumn(name, F.col("__before") + place("__bucket")).select(*df.columns, name)


def grid(n: int) -> tuple[int, int]:
    """Rows and columns of a grid of n cells, or a few more."""
    root = int(n**0.5)
    a = min(range(max(min(2, root), int(n ** (1 / 3))), max(2, root + 1)), key=lambda a: (-n % a, -a))
    return a, -(-n // a)


def permuted(df: DataFrame, place: str, n: int, keys: Mapping[str, str]) -> DataFrame:
    """Columns with keyed permutations of a place in 0 .. n - 1, one for each (name, key): no shuffle, and independent of each other.

    A place is a cell of a grid. In each half round the row moves by a keyed hash of the column, or the other way
    round, which can be undone; a cell beyond the n moves on until it is one of them.
    """
    a, b = grid(n)
    out = df.withColumns({c: F.col(place).cast("long") for c in keys})
    for turn in range(1 + a * b - n):
        out = out.withColumns({f"__i_{c}": F.expr(f"`{c}` div {b}") for c in keys} | {f"__j_{c}": F.col(c) % b for c in keys})
        for half in range(6):
            x, y, size = ("__i_", "__j_", a) if half % 2 == 0 else ("__j_", "__i_", b)
            out = out.withColumns({f"{x}{c}": F.pmod(F.col(f"{x}{c}") + F.pmod(F.xxhash64(F.col(f"{y}{c}"), F.lit(f"{key}|{half}")), F.lit(size)), F.lit(size)) for c, key in keys.items()})
        new = {c: F.col(f"__i_{c}") * b + F.col(f"__j_{c}") for c in keys}
        out = out.withColumns({c: x if turn == 0 else F.when(F.col(c) < n, F.col(c)).otherwise(x) for c, x in new.items()})
    return out.drop(*(f"{x}{c}" for c in keys for x in ("__i_", "__j_")))


def conditional(marginal: DataFrame, existing: DataFrame, overlap: Sequence[str], value: str = "count") -> DataFrame:
    """Rescale a marginal so that its shares of the overlapping attributes are those of the existing rows; without an overlap it stays."""
    if not overlap:
        return marginal
    have = existing.groupBy(*overlap).agg(F.count("*").alias("__have"))
    ours = Window.partitionBy(*overlap)
    df = marginal.withColumn("__sum", F.sum(value).over(ours)).join(F.broadcast(have), list(overlap), "left")
    return df.withColumn(value, F.when(F.col("__sum") != 0, F.col(value) * F.coalesce("__have", F.lit(0)) / F.col("__sum")).otherwise(0.0)).drop("__sum", "__have")


def append(rows: DataFrame, marginal: DataFrame, anchor: str, attr: str, key: Column, value: str = "count") -> DataFrame:
    """Give rows an attribute by its shares given the anchor; uniform where the anchor's row of the marginal is empty."""
    placed = ordered(rows, key, [anchor])
    sizes = rows.groupBy(anchor).agg(F.count("*").alias("__n"))
    cuts = boundaries(marginal.join(F.broadcast(sizes), anchor), F.col("__n"), [attr], value, [anchor])
    return fill(placed, cuts, [attr], "place", [anchor]).drop("place")


def weighted_corr(x: str, y: str, value: str = "count") -> Column:
    """Pearson's correlation of two codes, each cell weighted by its rounded count, without expanding rows."""
    w = F.rint(F.col(value))
    n, sx, sy = F.sum(w), F.sum(w * F.col(x)), F.sum(w * F.col(y))
    sxx, syy, sxy = F.sum(w * F.col(x) * F.col(x)), F.sum(w * F.col(y) * F.col(y)), F.sum(w * F.col(x) * F.col(y))
    bottom = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return (n * sxy - sx * sy) / F.when(bottom != 0, bottom)


def expand(marginal: DataFrame, value: str = "count") -> DataFrame:
    """Rows repeated by their rounded counts."""
    n = F.rint(F.col(value)).cast("int")
    return marginal.where(n > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), n))).drop("__k", value)
