"""Stupid-backoff scores of every document under the n-gram counts of the whole corpus.

Count tables are partitioned by the hash of the n-gram. Documents form batches; a batch sends each of its distinct
n-grams once with its count (the combine before the shuffle), a partition of the table adds the counts up and joins
them back to the batches that asked, and a batch sums the scores of its documents. So a frequent n-gram costs one
entry a batch, never one an occurrence. n-grams are told apart by 56-bit hashes, sent as packed differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.llm.blobs import docs_of, pack_planes, tidy, unpack_planes
from tabveil.llm.text import LOWER, U64, buffers, grams, mix, prefix, slabs, span_hash, words

WORD = r"[^\x20\x09-\x0D]++"
KEEP = U64(8)  # bits of a hash that are dropped


def slab_grams(column, order: int):
    """Slab by slab: its first and last row, the row of each word, and for each n the hashes of n-grams and their last words' places."""
    data, offs = buffers(column)
    for a, b in slabs(offs):
        part = LOWER[data[offs[a] : offs[b]]]
        start, end, row = words(part, offs[a : b + 1] - offs[a])
        h = span_hash(prefix(part), start, end)
        found = [grams(h, row, n) for n in range(1, order + 1)]
        yield a, b, row, [(mix(g + U64(n)) >> KEEP, at + n - 1) for n, (g, at) in enumerate(found, 1)]


def distinct_grams(column, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the distinct n-grams of a batch in their order, and their counts; one n at a time is held."""
    found: list[list[np.ndarray]] = [[] for _ in range(order)]
    for _, _, _, by_n in slab_grams(column, order):
        for k, (g, _) in enumerate(by_n):
            found[k].append(g)
    for k in range(order):
        part = found[k]
        found[k] = []
        g = np.concatenate(part) if part else np.zeros(0, U64)
        del part
        yield np.unique(g, return_counts=True)


def counted(row: np.ndarray, g: np.ndarray, values: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram what the table of (values, told) says, and how often it stands in its own row."""
    u, place = np.unique(g, return_inverse=True)
    _, back, own = np.unique(row * len(u) + place, return_inverse=True, return_counts=True)
    return told[np.searchsorted(values, u)][place], own[back]


def log_scores(counts: list[np.ndarray], inside: list[np.ndarray], n_words: np.ndarray, backoff: float) -> np.ndarray:
    """Log of each word's score from the counts of its n-grams; a word counts once at least, so that no score is 0."""
    logs, open_ = np.zeros(len(n_words)), np.ones(len(n_words), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(len(counts), 0, -1):
            c = counts[n - 1] if n > 1 else np.maximum(counts[0], 1)
            below = np.concatenate([[0], counts[n - 2][:-1]]) if n > 1 else np.maximum(n_words, 1)
            hit = open_ & (c > 0)
            logs[hit] += np.log(c[hit] / below[hit])
            open_ &= ~hit
            if n > 1:  # there is a longer history to give up only where the document has one
                logs[open_ & inside[n - 1]] += np.log(backoff)
    return logs


def score(docs: DataFrame, order: int = 3, backoff: float = 0.4, least: int = 1, batch_mb: float = 16, bucket_grams: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, log_score, per_word, rest_score, rest_per_word): sums of natural logs of stupid-backoff scores.

    The score of a word after its history is count(history, word) / count(history) for the longest n-gram of at most
    `order` words, within the document, that the corpus has `least` times or more; each shorter step costs a factor
    `backoff`, and a word alone scores its count over all words. log_score takes the counts of the whole corpus; rest_score
    takes them without the row's own text (a word that no other row has counts once), so that it tells a text that the
    corpus has elsewhere from one that it has not. The per_word columns are over n_words. Words are maximal runs other than
    space and 0x09-0x0D, with A-Z lower-cased. Null and empty texts: 0 words, scores 0, per_word null. Counts are over
    all rows, repeated ones included; equal texts get equal scores. An empty table gives none.
    """
    docs = docs_of(docs, "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(WORD)))).first()
    size, n_words = total[0] or 0, total[1] or 0
    batches = int(size // (batch_mb * (1 << 20))) + 1
    buckets = int(n_words * order // bucket_grams) + 1
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(batches)))
    step = U64((1 << (64 - int(KEEP))) // buckets + 1)

    def send(key, table):
        out = {"batch": [], "bucket": [], "n": [], "grams": [], "counts": []}
        for n, (values, counts) in enumerate(distinct_grams(table["text"], order), 1):
            cut = np.searchsorted(values // step, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                v = values[cut[b] : cut[b + 1]]
                for name, x in (("batch", key[0].as_py()), ("bucket", int(b)), ("n", n), ("grams", pack_planes(np.diff(v, prepend=U64(0)))), ("counts", pack_planes(counts[cut[b] : cut[b + 1]].astype(np.uint64)))):
                    out[name].append(x)
        return pa.table({"batch": pa.array(out["batch"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()), "n": pa.array(out["n"], pa.int32()), "grams": pa.array(out["grams"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    def add(key, table):
        asked = [np.cumsum(unpack_planes(x.as_py(), U64), dtype=U64) for x in table["grams"]]
        told = [unpack_planes(x.as_py(), np.uint64) for x in table["counts"]]
        values, place = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate(told).astype(np.float64)).astype(np.uint64)  # exact up to 2**53
        ends = np.cumsum([len(x) for x in asked])
        blobs = [pack_planes(s) for s in np.split(sums[place], ends[:-1])]
        return pa.table({"batch": table["batch"], "bucket": table["bucket"], "n": table["n"], "totals": pa.array(blobs, pa.binary())})

    def finish(key, table, answers):
        blobs = {}
        for n, b, blob in zip(answers["n"].to_pylist(), answers["bucket"].to_pylist(), answers["totals"], strict=True):
            blobs.setdefault(n, {})[b] = blob
        known = []
        for n, (values, _) in enumerate(distinct_grams(table["text"], order), 1):
            mine = blobs.pop(n, {})
            told = [unpack_planes(mine[b].as_py(), np.uint64) for b in sorted(mine)]
            known.append((values, np.concatenate(told).astype(np.int64) if told else np.zeros(0, np.int64)))
        m = len(table)
        n_words_in, totals = np.zeros(m, np.int64), {"log_score": np.zeros(m), "rest_score": np.zeros(m)}
        for a, b, row, by_n in slab_grams(table["text"], order):
            words_in = np.bincount(row, minlength=b - a).astype(np.int64)
            counts, rest, inside = [], [], []
            for n, (g, at) in enumerate(by_n, 1):
                c, own, has = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), bool)
                values, told = known[n - 1]
                if len(g):
                    c[at], own[at] = counted(row[at], g, values, told)
                    has[at] = True
                floor = least if n > 1 else 1
                counts.append(np.where(c >= floor, c, 0))
                rest.append(np.where(c - own >= floor, c - own, 0))
                inside.append(has)
            n_words_in[a:b] = words_in
            for name, some, every in (("log_score", counts, np.full(len(row), n_words)), ("rest_score", rest, n_words - words_in[row])):
                totals[name][a:b] = np.bincount(row, weights=log_scores(some, inside, every, backoff), minlength=b - a)
        per = {name: pa.array(x / np.maximum(n_words_in, 1), mask=n_words_in == 0) for name, x in totals.items()}
        return pa.table({"doc_id": table["doc_id"], "n_words": n_words_in, "log_score": totals["log_score"], "per_word": per["log_score"], "rest_score": totals["rest_score"], "rest_per_word": per["rest_score"]})

    sent = "batch long, bucket int, n int, grams binary, counts binary"
    back = "batch long, bucket int, n int, totals binary"
    answers = dealt.groupBy("batch").applyInArrow(tidy(send), sent).groupBy("bucket").applyInArrow(tidy(add), back)
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(tidy(finish), "doc_id long, n_words long, log_score double, per_word double, rest_score double, rest_per_word double")
