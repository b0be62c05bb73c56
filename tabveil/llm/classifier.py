"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.llm.blobs import docs_of, tidy
from tabveil.llm.text import LOWER, U64, WHITE, buffers, grams, mix, prefix, slabs, span_hash, words

BITS = 18
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[48:58] = 48
SHAPE[65:91] = 65
SHAPE[97:123] = 97
SHAPE[128:] = 97


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: runs of small letters, capitals, digits and equal marks count as one."""
    s = SHAPE[data]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | WHITE[data[:-1]]
    keep[start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return span_hash(prefix(s[keep]), at[start], at[end])


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of every word, word pair, shape and shape pair, in the order of rows within each kind."""
    start, end, row = words(data, offs)
    h = span_hash(prefix(LOWER[data]), start, end)
    s = shapes(data, start, end)
    out, rows = [], []
    for k, (x, n) in enumerate(((h, 1), (h, 2), (s, 1), (s, 2))):
        g, at = grams(x, row, n)
        out.append(mix(g + U64(k)) >> U64(64 - BITS))
        rows.append(row[at])
    return np.concatenate(rows), np.concatenate(out).astype(np.int64)


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias after passes over (features, values, label) in a fixed order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            at, x, y = examples[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(float(w @ x), -35, 35)))
            g = (p - y) * x
            more = np.sqrt(n[at] + g * g)
            z[at] += g - (more - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


SCALE = 30.0  # a row's features sum to this


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 6_000, epochs: int = 4) -> tuple[np.ndarray, float] | None:
    """Weights and bias from about `train_docs` labelled documents that aren't held out; None without any.

    The sample is drawn by a hash of doc_id at a rate of `train_docs` over the number of such labels, so it covers all
    of the table and is bounded whatever its size; one task trains on it.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("y").alias("y"))
    n = known.count()
    if not n:
        return None
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(8)), 11).cast("double") / float(1 << 53)  # a share of 1, however low the rate
    known = known.where(place < min(1.0, train_docs / n)).orderBy(place, "doc_id").limit(2 * train_docs)
    some = docs_of(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")

    def learn(table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        data, offs = buffers(table["text"])
        y = table["y"].to_numpy()
        examples = []
        for a, b in slabs(offs):
            rows, f = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            by = np.argsort(rows, kind="stable")
            f, cut = f[by], np.searchsorted(rows[by], np.arange(b - a + 1))
            for k in range(b - a):
                at, c = np.unique(f[cut[k] : cut[k + 1]], return_counts=True)
                x = c * (SCALE / max(1, c.sum()))
                examples.append((np.append(at, 1 << BITS), np.append(x, 1.0).astype(np.float32), float(y[a + k] >= 0.5)))
        w, bias = train_ftrl(examples, epochs)
        return pa.table({"w": [w.astype(np.float32).tobytes()], "bias": [bias]})

    got = some.groupBy(F.lit(0).alias("g")).applyInArrow(tidy(learn), "w binary, bias double").first()
    return (np.frombuffer(bytes(got["w"]), np.float32), got["bias"]) if got else None


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_docs: int = 6_000, keep_columns: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; with keep_columns the input's rows of predicted = 1.

    The score is the model's probability of label 1 from the text alone; predicted is 1 from `threshold` on. A row's
    features add up to a fixed sum, so long and short texts compare. Null and empty texts get the bias alone. Without any
    label every score is 0.5. Labels that contradict each other are averaged; a label or id that is null is unused.
    Equal texts get equal scores. An empty table gives none.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, train_docs))  # 2**18 weights: 1 MB

    def scores(column) -> np.ndarray:
        data, offs = buffers(column)
        out = np.full(len(offs) - 1, 0.5)
        if model.value is None:
            return out
        w, bias = model.value
        for a, b in slabs(offs):
            rows, f = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            total = np.bincount(rows, weights=w[f], minlength=b - a)
            out[a:b] = 1 / (1 + np.exp(-np.clip(bias + SCALE * total / np.maximum(1, np.bincount(rows, minlength=b - a)), -35, 35)))
        return out

    if keep_columns:

        def keep(batches):
            for batch in batches:
                yield batch.filter(pa.array(scores(batch["text"]) >= threshold))

        return docs.mapInArrow(tidy(keep), docs.schema)

    def report(batches):
        for batch in batches:
            s = scores(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs_of(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return rows.select("doc_id", "held_out", "text").mapInArrow(tidy(report), "doc_id long, held_out boolean, score double, predicted int")
