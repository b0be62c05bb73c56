"""Mixing of sources to target weights along a time-varying curriculum, in DataFrame operations.

Each source has a target of words and a weight that changes over training time t in [0, 1]. The integral of the
weight is the source's cumulative demand; a document that begins at word u of its source's stream is due at
the t where the demand reaches u, and its k-th repeat where the demand reaches u + k * the source's size. Rows are
sorted by range of the first position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.blobs import Steps, docs_of

WORD = r"[^\x20\x09-\x0D]++"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, weight, turn, target) for each source of (source, source_size).

    Weights repeat over the sources in the order of code points, null last. Targets are the weights' shares of
    `share` of all words, but at most `limit` times the source's size; the excess is shared by weight again.
    That is one water level v with target = least(weight * v, limit * size): sources sorted by the level at which
    they are full, the level is the first at which the rest take what remains (later ones are lower). One row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = sizes.withColumn("turn", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("turn") % len(weights) + 1).cast("int")))
    s = s.withColumn("__most", F.col("source_size") * F.lit(float(limit))).withColumn("__full", F.col("__most") / F.col("weight"))
    by_full = Window.orderBy("__full", "turn")
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("__taken", F.coalesce(F.sum("__most").over(before), F.lit(0.0)))
    s = s.withColumn("__left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("__level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("__taken")) / F.col("__left"))
    s = s.withColumn("__v", F.max(F.when(F.col("__level") <= F.col("__full"), F.col("__level"))).over(everything))
    # without a level below, every source is full
    target = F.when(F.col("__v").isNull(), F.col("__most")).otherwise(F.least(F.col("__most"), F.col("weight") * F.col("__v")))
    return s.select("source", "source_size", "weight", "turn", target.alias("target"))


def due(part: Column, slope: Column) -> Column:
    """The t at which the integral of 1 + slope * (2t - 1) reaches `part`, for slopes between -1 and 1."""
    root = F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * part, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-9, part).otherwise((root - (1 - slope)) / (2 * slope))


def order_of(docs: DataFrame, seed: int) -> Column:
    """A seeded hash by which a source's documents stand: hexadecimal digits, the same in any engine."""
    text = F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), text).cast("binary"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0, slopes: tuple[float, ...] = (-0.5, 0.0, 0.5), seed: int = 17, sort: bool = True) -> DataFrame:
    """How many words of each document the mix takes, and where in training they come.

    A source's target over its size gives whole passes plus a part of one more; documents stand in a
    seeded hash order, and the one at the end of the last part is taken up to the exact word. Returns the input's
    columns and size, source_size, target, taken, positions (one for each time that the document is taken, ascending; empty if
    it isn't) and position, the first of them (null if none). Rows come sorted by range of position, nulls first.
    A name that the input has already is replaced. Sizes are words; null texts have 0. Null sources are a source.
    Ties fall by doc_id, then by a hash of the text; rows that repeat both can't be told apart and lie in one bucket. Empty tables give none.

    A source may hold any share of the rows: its documents are dealt to about as many hash buckets as a bucket has rows,
    summed by bucket, and only a bucket's rows are sorted together.
    """
    spark = docs.sparkSession
    made = ("size", "source_size", "target", "taken", "position", "positions")
    names = [c for c in docs.columns if c not in made]
    n = max(1, int(docs.count() ** 0.5))

    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("__h", order_of(df, seed))
        share = F.conv(F.substr("__h", F.lit(1), F.lit(13)), 16, 10).cast("long") / float(1 << 52)  # grows with the hash
        return df.withColumn("__b", F.floor(share * n))

    rows = dealt(docs.select(*(F.col(f"`{c}`") for c in names)))
    # sizes alone are summed first: a map task sends one row for each source and bucket
    parts = dealt(docs_of(docs, "doc_id", "text", "source")).groupBy("source", "__b").agg(F.sum("size").alias("__size"))
    parts = Steps(spark).keep(parts)
    plan = targets(parts.groupBy("source").agg(F.sum("__size").alias("source_size")), weights, limit)
    ahead = F.sum("__size").over(Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("__ahead", F.coalesce(ahead, F.lit(0))).select(F.col("source").alias("__s"), F.col("__b").alias("__b2"), "__ahead")
    plan = plan.select(F.col("source").alias("__p"), "source_size", F.col("turn").alias("__turn"), "target")
    to = parts.join(plan, F.col("__s").eqNullSafe(F.col("__p"))).drop("__p")
    out = rows.join(to, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__b2")))
    inside = Window.partitionBy("__s", "__b").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("__u", F.col("__ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.rint("target") / F.col("source_size"))).otherwise(F.lit(0))
    out = out.withColumn("__whole", whole).withColumn("__cut", F.rint("target") - F.col("__whole") * F.col("source_size"))
    part = F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), F.col("__cut") - F.col("__u")))
    out = out.withColumn("taken", (F.col("__whole") * F.col("size") + part).cast("long"))
    slope = F.element_at(F.array(*(F.lit(float(x)) for x in slopes)), (F.col("__turn") % len(slopes) + 1).cast("int"))
    times = F.when(F.col("taken") > 0, F.col("__whole") + F.when(part > 0, 1).otherwise(0)).otherwise(0).cast("int")
    at = lambda k: due(F.least(F.lit(1.0), (F.col("__u") + k * F.col("source_size")) / F.col("target")), slope)
    out = out.withColumn("positions", F.transform(F.slice(F.array(*(F.lit(k) for k in range(int(limit) + 1))), F.lit(1), times), at))
    out = out.withColumn("position", F.get("positions", F.lit(0)))
    out = out.select(*(F.col(f"`{c}`") for c in names), *made)
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id") if sort else out
