"""Quality rules: repetition within a text, and lines that many documents of one host share. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.llm.blobs import Steps

WORD = r"[^\x20\x09-\x0D]++"
MARKS = "#*$%&|<>"
WINDOW = 5


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once: Catalyst would copy an expression into each place that names it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of five words found twice or more."""

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            n = F.size(s)
            twice = lambda j: F.get(s, j)["h"].eqNullSafe(F.get(s, j + 1)["h"]) | ((j > 0) & F.get(s, j)["h"].eqNullSafe(F.get(s, F.greatest(j - 1, F.lit(0)))["h"]))
            at = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), twice), lambda j: F.get(s, j)["i"]))
            start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
            step = lambda acc, p: F.struct((acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total"), p.alias("last"))
            return F.aggregate(at, start, step)["total"]

        return bind(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))
    found = bind(hashes, lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), 0).otherwise(covered(a)))
    return F.when(F.size(words) < WINDOW, 0).otherwise(found)


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_replace(line, r"[\x20\x09-\x0D]++", "")))


def rules(docs: DataFrame, least_docs: int = 20, left_percent: int = 30, least_words: int = 10, most_sent: int = 500_000, hot_docs: int = 10_000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_boiler_words, base_failed, kept, text, by row.

    A line (compared without blanks and in lower case) is boilerplate on its host, the source, if it stands in more than
    `least_docs` documents there, whatever the host's size. Rows that repeat a doc_id are one document; rows of null
    doc_id are told apart by their texts. text is what is left when boilerplate lines are taken out;
    other lines stay as they were, null stays null. A document is depleted if, without boilerplate, it has fewer than
    `least_words` words or under `left_percent` of them. kept is false if base_failed (fewer than 10 words, or over 20% of
    them in repeated windows) or if depleted. Null and empty texts have no words and fail. A null source is a host of its
    own. Rows that repeat doc_id, text and source get the same result. An empty table gives none.

    Lines are counted by rows first, which combines before the shuffle; only those in over `least_docs` rows are looked up
    again, for their distinct documents. Up to `most_sent` such lines are broadcast. Of more, only those in over `hot_docs`
    rows are, at most one in so many lines of the table, and the others are joined by shuffle. Texts are shuffled once.
    """
    steps = Steps(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    key = F.xxhash64("text")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    stats = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    length = F.coalesce(F.length("text"), F.lit(0))
    chars = F.coalesce(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]++", "")), F.lit(0)).cast("long")
    symbols = (length - F.coalesce(F.length(F.translate("text", MARKS, "")), F.lit(0))).cast("long")
    dup = bind(lines_of(F.col("text")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    base = rows.select("doc_id", "text", "source", key.alias("__k"), stats.alias("s"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"))
    base = base.select("doc_id", "text", "source", "__k", "s.n_words", "word_chars", "n_symbols", "n_dup_lines", "s.n_repeat_words")
    base = base.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))

    per_row = rows.select("source", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_hash))).alias("line"))
    often = per_row.groupBy("source", "line").agg(F.count("*").alias("c")).where(F.col("c") > least_docs)
    often = steps.keep(often.select(F.col("source").alias("__host"), F.col("line").alias("__line"), "c"))
    few = often.count() <= most_sent  # 500,000 rows of 30 bytes at most are broadcast

    def on_hosts(each: DataFrame, lines: DataFrame) -> DataFrame:
        """Rows of `each` (source, line) that one of `lines` (__host, __line, c) names."""
        same = F.col("source").eqNullSafe(F.col("__host")) & (F.col("line") == F.col("__line"))
        lost = ("__host", "__line", "c")
        if few:
            return each.join(F.broadcast(lines), same).drop(*lost)
        hot, rest = F.broadcast(lines.where(F.col("c") > hot_docs)), lines.where(F.col("c") <= hot_docs)
        return each.join(hot, same).drop(*lost).union(each.join(hot, same, "left_anti").join(rest, same).drop(*lost))

    each = rows.select("doc_id", key.alias("__k"), "source", F.posexplode(F.split("text", "\n")).alias("at", "t")).where(F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    each = each.select("doc_id", "__k", "source", "at", line_hash(F.col("t")).alias("line"), F.regexp_count("t", F.lit(WORD)).alias("n"))
    each = steps.keep(on_hosts(each, often))
    document = F.when(F.col("doc_id").isNull(), F.col("__k")).alias("__other")
    ids = each.groupBy("source", "line", "doc_id", document).agg(F.lit(1).alias("one"))
    many = steps.keep(ids.groupBy("source", "line").agg(F.count("*").alias("c")).where(F.col("c") > least_docs).select(F.col("source").alias("__host"), F.col("line").alias("__line"), "c"))
    # the first step makes rows that repeat doc_id, text and source count once
    boiler = on_hosts(each, many).groupBy("doc_id", "__k", "source", "at").agg(F.max("n").alias("n")).groupBy("doc_id", "__k", "source").agg(F.sum("n").alias("__b"), F.collect_list("at").alias("__at"))
    boiler = boiler.select(F.col("doc_id").alias("__d"), F.col("__k").alias("__k2"), F.col("source").alias("__s"), "__b", "__at")
    out = base.join(boiler, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("__k").eqNullSafe(F.col("__k2")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    out = out.withColumn("__b", F.coalesce("__b", F.lit(0)))
    out = out.withColumn("n_boiler_words", F.least("__b", "n_words").cast("long"))
    left = F.col("n_words") - F.col("n_boiler_words")
    depleted = (left < least_words) | (100 * left < left_percent * F.col("n_words"))
    spared = bind(F.split("text", "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__at")), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col("__at").isNull(), F.col("text")).otherwise(spared)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boiler_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), text.alias("text"))
