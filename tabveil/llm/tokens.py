"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how the byte-level vocabulary splits a text into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# Fixed value: the blanks that \\s stands for above.
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encoder(path: str = VOCABULARY):
    """A tokenizer from a file of base64 pieces and ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> Iterator[str]:
    """The text cut around long runs of blanks, so that its parts encode to the tokens of the whole.

    Of blanks before anything else, all but the last form one piece; the pattern would find that by as many nested
    attempts as there are blanks. Blanks at the end of a text are one piece anyway.
    """
    at = 0
    for run in BLANKS.finditer(text):
        if run.end() < len(text):
            yield text[at : run.start()]
            yield text[run.start() : run.end() - 1]
            at = run.end() - 1
    yield text[at:]


def size(code, text: str | None) -> int:
    """Tokens of a whole text; 0 for null."""
    return sum(len(code.encode_ordinary(part)) for part in parts(text or ""))


def histogram(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(length, n_docs): how many whole texts encode to each number of tokens. Null and empty texts have 0.

    The vocabulary's file is read on the driver and sent to the tasks (a megabyte, fixed); a task adds up its own
    documents first, so what is shuffled is bounded by the number of distinct lengths.
    """
    import tiktoken

    with open(path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.value.splitlines())}
        code = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        total: dict[int, int] = {}
        for batch in batches:
            for text in batch["text"]:
                n = size(code, text.as_py())
                total[n] = total.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["length", "n_docs"])

    part = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "length long, n_docs long")
    return part.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def lengths(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The histogram with, for each length as a context limit, suffix sums over longer documents.

    length, n_docs, n_tokens, docs_over (longer documents), tokens_over (theirs), tokens_within (of the others),
    tokens_kept (all tokens if every document is cut at this length), tokens_lost, share_at_most (of documents: the
    quantile that this length is). Limits between two lengths follow from the next smaller one: `truncated`.
    Rows are distinct lengths, whatever the number of documents; ties and repeated rows add up. An empty table gives none.
    """
    h = histogram(docs, path).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    after = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    h = h.withColumn("docs_over", F.coalesce(F.sum("n_docs").over(after), F.lit(0))).withColumn("tokens_over", F.coalesce(F.sum("n_tokens").over(after), F.lit(0)))
    h = h.withColumn("docs", F.sum("n_docs").over(every)).withColumn("tokens", F.sum("n_tokens").over(every))
    kept = F.col("tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")
    return h.select("length", "n_docs", "n_tokens", "docs_over", "tokens_over", (F.col("tokens") - F.col("tokens_over")).alias("tokens_within"), kept.alias("tokens_kept"), (F.col("tokens") - kept).alias("tokens_lost"), ((F.col("docs") - F.col("docs_over")) / F.col("docs")).alias("share_at_most"))


def truncated(table: DataFrame, limit: int) -> int:
    """All tokens if every document is cut at any `limit`, from the output of `lengths`."""
    row = table.agg(
        F.sum(F.when(F.col("length") <= limit, F.col("n_tokens")).otherwise(F.col("n_docs") * limit)).alias("n"),
    ).first()
    return row["n"] or 0


def quantile(table: DataFrame, q: float) -> int | None:
    """The least length that a share `q` of documents don't exceed, from the output of `lengths`."""
    return table.where(F.col("share_at_most") >= q).agg(F.min("length")).first()[0]


def brute(texts: list[str | None], path: str = VOCABULARY) -> np.ndarray:
    """Encoded lengths one by one, for tests."""
    code = encoder(path)
    return np.array([len(code.encode_ordinary(t or "")) for t in texts])
