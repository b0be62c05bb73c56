"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is the hash of the words that a mask selects at a position; words under a mask's gaps may differ. Seeds of
the benchmark's items meet seeds of all document positions in a hash join. Around each hit the item is laid over the
document and compared word by word, so that substituted words are tolerated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.llm.blobs import Steps

WORD = r"[^\x20\x09-\x0D]++"
#: (least words of an item, masks): up to a fifth of its words may be substituted and a mask still fits somewhere (a test
#: tries all cases from 5 to 20 words). Of 4 words or fewer none may, so that they are sought as a whole sequence.
MASKS = ((10, ("11101", "110011")), (5, ("1101", "1011")), (4, ("1111",)), (3, ("111",)), (2, ("11",)), (1, ("1",)))
BLOCK = 4 << 20  # bytes of benchmark text that are joined at once
SENT = 1_000_000  # rows of three numbers that are broadcast at most


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once a row, also where `use` names it in a loop."""
    return F.transform(F.array(value), use)[0]


def seeds(words: Column, masks: list[str]) -> Column:
    """For each position, the hash of each mask there; null where a mask doesn't fit."""

    def of_hashes(h: Column) -> Column:
        def at(i: Column) -> Column:
            out = []
            for mask in masks:
                chosen = [F.get(h, i + j) for j, c in enumerate(mask) if c == "1"]
                out.append(F.when(chosen[-1].isNotNull(), F.xxhash64(F.lit(mask), *chosen)))
            return F.array(*out)

        return F.when(F.size(h) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - 1), at)))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def places(seeded: DataFrame, masks: list[str], *keep: str) -> DataFrame:
    """One row for each seed, with its position; only the named columns go along, never a text."""
    out = seeded.select(*keep, F.posexplode("seeds").alias("p", "seed")).where("seed is not null")
    return out.select(*keep, F.expr(f"p div {len(masks)}").cast("int").alias("i"), "seed")


def held(docs: DataFrame, benchmark: DataFrame, percent: int, window: int) -> DataFrame:
    """(doc_id, key, item, item_id, start, n_match, n_words) of each place that holds an item; key is a hash of the text.

    Items are told apart by id and text, so null and repeated ids are items like others.
    """
    steps = Steps(docs.sparkSession)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    items = items.select(F.xxhash64("item_id", F.lit(0), "text").alias("item"), "item_id", words_of(F.col("text")).alias("b"), F.octet_length("text").alias("size")).where(F.size("b") > 0)
    facts = items.agg(F.sum("size"), F.collect_set(F.least(F.size("b"), F.lit(MASKS[0][0])))).first()  # ten numbers at most
    blocks = int((facts[0] or 0) // BLOCK) + 1
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    tiers = [(least, more, masks) for (least, masks), more in zip(MASKS, [1 << 31, *(t for t, _ in MASKS)], strict=False) if any(least <= n < more for n in facts[1] or [])]
    used = [m for _, _, masks in tiers for m in masks]
    here = places(rows.select("doc_id", "key", seeds(words_of(F.col("text")), used).alias("seeds")), used, "doc_id", "key") if used else None
    found = [rows.where("false").select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), F.lit(0).cast("long").alias("item"), F.lit(0).alias("start"))]
    for k in range(blocks if used else 0):
        one = items.where(F.pmod("item", F.lit(blocks)) == k) if blocks > 1 else items
        keyed = [places(one.where((F.size("b") >= least) & (F.size("b") < more)).select("item", seeds(F.col("b"), list(masks)).alias("seeds")), list(masks), "item") for least, more, masks in tiers]
        keyed = reduce(DataFrame.union, keyed).withColumnRenamed("i", "j")
        near = here.join(F.broadcast(keyed), "seed").select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "item", (F.col("i") - F.col("j")).alias("start"))
        found.append(near.distinct())
    near = steps.keep(reduce(DataFrame.union, found))
    # only texts with a hit are opened again; a document is told by its id and a hash of its text
    sent = F.broadcast(near) if near.count() <= SENT else near
    hits = rows.join(sent, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("key").eqNullSafe(F.col("__k")))
    laid = items.select("item", "item_id", "b")
    hits = hits.join(F.broadcast(laid) if blocks == 1 else laid, "item")
    hits = hits.select("doc_id", "key", "item", "item_id", "text", "b", "start", F.least(F.size("b"), F.lit(window)).alias("span"))

    def agree(w: Column) -> Column:
        there = lambda k: F.get(w, F.greatest(F.col("start") + k, F.lit(0)))
        return F.transform(F.col("b"), lambda x, k: F.when((F.col("start") + k >= 0) & (there(k) == x), 1).otherwise(0))

    same = bind(words_of(F.col("text")), agree)
    hits = hits.select("doc_id", "key", "item", "item_id", "start", "span", F.size("b").alias("n_words"), same.alias("same"))
    total = F.aggregate("same", F.lit(0), lambda acc, x: acc + x)
    hits = hits.select("*", total.alias("n_match")).where(F.col("n_match") * 100 >= F.col("span") * percent)

    def dense(same: Column) -> Column:
        enough = lambda s: F.aggregate(F.slice(same, s + 1, F.col("span")), F.lit(0), lambda acc, x: acc + x) * 100 >= F.col("span") * percent
        return F.exists(F.sequence(F.lit(0), F.size(same) - F.col("span")), enough)

    return hits.where(dense(F.col("same"))).drop("same", "span")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, window: int = 20) -> DataFrame:
    """(doc_id, item_id, start_word, n_match, n_words) for each document and benchmark item that it holds.

    An item is held if, laid over the document at one place, at least `percent` of some `window` consecutive words
    of it agree (of all its words if it has fewer). `percent` must be 80 or more: up to a fifth of substitutions is what the
    masks are sure to find. Words are maximal runs other than space and 0x09-0x0D, lower-cased. start_word is the first
    such place (negative if the item begins before the document), n_match the most agreeing words. Texts without
    words, null ones among them, hold nothing and are held by nothing. Items are told apart by id and text: a null item_id is
    an item like others, a repeated one with another text a further row. Rows that repeat a doc_id count as one document, and so
    do rows of null doc_id. Further columns have no effect. Empty tables give no rows.

    The benchmark is taken in blocks of at most BLOCK bytes, whose seeds are broadcast (80 MB at most).
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    hits = held(docs, benchmark, percent, window)
    out = hits.groupBy("doc_id", "item", "item_id").agg(F.min("start").cast("long").alias("start_word"), F.max("n_match").cast("long").alias("n_match"), F.max("n_words").cast("long").alias("n_words"))
    return out.drop("item")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80, window: int = 20) -> DataFrame:
    """The rows that hold no benchmark item, with their columns as they were; each row is judged by its own text."""
    bad = held(docs, benchmark, percent, window).select(F.col("doc_id").alias("__tabveil_d"), F.col("key").alias("__tabveil_k")).distinct()
    bad = Steps(docs.sparkSession).keep(bad)
    same = docs["doc_id"].cast("long").eqNullSafe(bad["__tabveil_d"]) & (F.xxhash64(docs["text"].cast("string")) == bad["__tabveil_k"])
    return docs.join(F.broadcast(bad) if bad.count() <= SENT else bad, same, "left_anti")
