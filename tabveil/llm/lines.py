"""Removal of lines that many documents share, with two Bloom filters before lines are shuffled.

Documents form batches. A batch sends short hashes of its lines, packed, to the filters of their hash range; each range
has two filters, of what was seen once or more and twice or more, sized by the hashes that come. Only lines whose hash the
second one holds are shuffled, to count their documents exactly and to choose the one that keeps them. Ranges grow in
number with the input, so filters go on filtering at any size; a false alarm only lets a line through to the exact count.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabveil.llm.blobs import Steps, docs_of, pack, pack_planes, tidy, unpack, unpack_planes
from tabveil.llm.text import BASE, LOWER, U64, WHITE, buffers, mix, powers, prefix, slabs, span_hash

HASH = U64(16)  # bits of a line's hash that aren't sent
PROBES = 3
BITS = 16  # of a filter for each hash
SENT = 500_000  # keys that many documents hold, broadcast at most
OTHER = 0xA24BAED4963EE407  # a second base for hashes


class Lines(NamedTuple):
    """All lines of a batch: row, first and last byte (exclusive); which are long, their keys' bytes and hashes."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    long: np.ndarray
    first: np.ndarray
    last: np.ndarray
    high: np.ndarray


def lines_of(data: np.ndarray, offs: np.ndarray, least: int) -> Lines:
    """Lines of each row, and the hashes of keys of `least` code points or more; every row has a line."""
    rows = len(offs) - 1
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(offs, breaks, "right") - 1
    count = 1 + np.bincount(of, minlength=rows)
    head = np.cumsum(count) - count  # each row's first line
    row = np.repeat(np.arange(rows), count)
    start, end = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    begun = np.arange(len(breaks)) + of + 1  # the line that a break begins
    start[head], start[begun] = offs[:-1], breaks + 1
    end[head + count - 1], end[begun - 1] = offs[1:], breaks
    # keys: from the first to the last byte that isn't blank; shorter lines than a key are left out at once
    some = np.flatnonzero(end - start >= least)
    solid = ~WHITE[data]
    first, last = start[some], end[some]
    for edge, step in ((first, 1), (last, -1)):
        todo = np.arange(len(some))
        while len(todo):
            todo = todo[(first[todo] < last[todo])]
            todo = todo[~solid[edge[todo] - (step < 0)]]
            edge[todo] += step
    more = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that begin no code point
    use = last - first - (np.searchsorted(more, last) - np.searchsorted(more, first)) >= least
    long, first, last = some[use], first[use], last[use]
    high = np.zeros(len(long), U64)
    for a, b in slabs(offs):
        x, y = np.searchsorted(row[long], [a, b])
        if x < y:
            high[x:y] = span_hash(prefix(LOWER[data[offs[a] : offs[b]]]), first[x:y] - offs[a], last[x:y] - offs[a])
    return Lines(row, start, end, long, first, last, high)


def low_half(data: np.ndarray, lines: Lines, which: np.ndarray) -> np.ndarray:
    """A second hash, with a base of its own, of the keys of some long lines."""
    size = lines.last[which] - lines.first[which]
    ends = np.cumsum(size)
    part = LOWER[data[np.repeat(lines.first[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]]
    start, out = ends - size, np.zeros(len(which), U64)
    for a, b in slabs(np.concatenate([[0], ends])):
        lo = start[a]
        sums = np.zeros(ends[b - 1] - lo + 1, U64)
        np.cumsum((part[lo : ends[b - 1]].astype(U64) + U64(7)) * powers(OTHER, len(sums) - 1), out=sums[1:])
        out[a:b] = mix((sums[ends[a:b] - lo] - sums[start[a:b] - lo]) * powers(pow(OTHER, -1, 1 << 64), len(sums))[start[a:b] - lo] + size[a:b].astype(U64) * U64(BASE))
    return out


def per_document(lines: Lines, ids: np.ndarray) -> np.ndarray:
    """Places among the long lines of the first of each document and hash."""
    owner = ids[lines.row[lines.long]]
    by = np.lexsort((lines.high, owner))
    new = np.ones(len(by), bool)
    new[1:] = (owner[by][1:] != owner[by][:-1]) | (lines.high[by][1:] != lines.high[by][:-1])
    return np.sort(by[new])


def ranges(total: int) -> U64:
    """Hashes of one range, for so many ranges."""
    return U64((1 << (64 - int(HASH))) // total + 1)


def ask(lines: Lines, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct short hashes of a batch's long lines, their ranges' bounds, and which several of its documents have."""
    u, times = np.unique(lines.high[per_document(lines, ids)] >> HASH, return_counts=True)
    return u, np.searchsorted(u // ranges(buckets), np.arange(buckets + 1)), times > 1


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash."""
    a = mix(h + U64(1))
    b = mix(a) | U64(1)
    return np.stack([((a + U64(k) * b) >> U64(64 - bits)).astype(np.int64) for k in range(PROBES)], 1)


def tell(asked: list[bytes], flags: list[bytes]) -> list[bytes]:
    """For each batch, which of its hashes in one range two documents or more may have: the two filters of the range."""
    keys = [np.cumsum(unpack_planes(x, U64), dtype=U64) for x in asked]
    own = [np.unpackbits(np.frombuffer(unpack(f), np.uint8), count=len(k)) > 0 for f, k in zip(flags, keys, strict=True)]
    bits = max(10, int(BITS * sum(map(len, keys))).bit_length())
    once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
    for k, o in zip(keys, own, strict=True):
        at = places(k, bits)
        again = once[at].all(1) | o
        twice[at[again].ravel()] = True
        once[at.ravel()] = True
    return [pack(np.packbits(twice[places(k, bits)].all(1)).tobytes()) for k in keys]


ASK = "batch long, bucket int, blob binary, flags binary"
TOLD = "batch long, bucket int, blob binary"


def dedup_lines(docs: DataFrame, least: int = 40, copies: int = 5, keep_columns: bool = False, batch_mb: float = 8, bucket_mb: float = 64) -> DataFrame:
    """Drop lines whose key at least `copies` documents hold, except in the largest doc_id that holds it.

    A key is a line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased; keys under `least` code points always
    stay. Returns doc_id, n_lines (before), n_dropped and text (what stays, joined by \\n), or with keep_columns the
    input's columns with the new text. Null and empty texts are one empty line; with keep_columns a null text stays
    null. A null doc_id counts as the smallest, and rows of one doc_id as one document. Keys are told apart by 128-bit
    hashes. An empty table gives none.

    Texts are shuffled once, by batch; lines that only one document holds, but for false alarms, never are. Up to SENT
    common keys are broadcast, with the doc_id that keeps each; more go to the batches that lose them, with a second shuffle of texts.
    """
    if copies < 2:
        raise ValueError("copies must be 2 or more")
    lowest = -(1 << 63)
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    batches, buckets = int(total // (batch_mb * (1 << 20))) + 1, int(total // (bucket_mb * (1 << 20))) + 1
    names = ("__tabveil_id", "__tabveil_text", "__tabveil_batch")
    text = F.col("text").cast("string")
    given = docs if keep_columns else docs_of(docs, "doc_id", "text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest).cast("long"))
    dealt = given.withColumns({names[0]: key, names[2]: F.pmod(F.xxhash64(key, F.xxhash64(text)), F.lit(batches))})
    if keep_columns:
        dealt = dealt.withColumn(names[1], text).drop("text") if dict(docs.dtypes)["text"] != "string" else dealt.withColumnRenamed("text", names[1])
    else:
        dealt = dealt.select(names[0], F.col("doc_id"), F.col("text").alias(names[1]), names[2])

    def opened(table):
        data, offs = buffers(table[names[1]])
        return data, offs, lines_of(data, offs, least), table[names[0]].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[names[0]].to_numpy()

    def first(batch, table):
        _, _, lines, ids = opened(table)
        u, cuts, several = ask(lines, ids, buckets)
        some = np.flatnonzero(np.diff(cuts))
        part = [slice(cuts[b], cuts[b + 1]) for b in some]
        return pa.table({"batch": pa.array([batch[0].as_py()] * len(some), pa.int64()), "bucket": pa.array(some, pa.int32()), "blob": pa.array([pack_planes(np.diff(u[p], prepend=U64(0))) for p in part], pa.binary()), "flags": pa.array([pack(np.packbits(several[p]).tobytes()) for p in part], pa.binary())})

    def second(bucket, table):
        return pa.table({"batch": table["batch"], "bucket": table["bucket"], "blob": pa.array(tell(table["blob"].to_pylist(), table["flags"].to_pylist()), pa.binary())})

    def suspects(batch, table, told):
        data, _, lines, ids = opened(table)
        u, cuts, _ = ask(lines, ids, buckets)
        masks = dict(zip(told["bucket"].to_pylist(), told["blob"].to_pylist(), strict=True))
        parts = [np.unpackbits(np.frombuffer(unpack(masks[b]), np.uint8), count=cuts[b + 1] - cuts[b]) for b in np.flatnonzero(np.diff(cuts))]
        flagged = u[np.concatenate(parts) > 0] if parts else u
        one = np.flatnonzero(np.isin(lines.high >> HASH, flagged))
        found = np.unique(whole(np.stack([ids[lines.row[lines.long[one]]], lines.high[one].view(np.int64), low_half(data, lines, one).view(np.int64)], 1)))
        found = found.view(np.int64).reshape(-1, 3)
        return pa.table({"batch": pa.array([batch[0].as_py()] * len(found), pa.int64()), "id": found[:, 0], "high": found[:, 1], "low": found[:, 2]})

    steps = Steps(docs.sparkSession)
    by_batch = dealt.select(names[0], names[1], names[2]).groupBy(names[2])
    told = by_batch.applyInArrow(tidy(first), ASK).groupBy("bucket").applyInArrow(tidy(second), TOLD)
    held = steps.keep(by_batch.cogroup(told.groupBy("batch")).applyInArrow(tidy(suspects), "batch long, id long, high long, low long"))
    # rows of one doc_id may lie in several batches
    common = held.select("high", "low", "id").distinct().groupBy("high", "low").agg(F.count("*").alias("c"), F.max("id").alias("keeper")).where(F.col("c") >= copies)
    common = steps.keep(common.select("high", "low", "keeper"))
    schema = StructType(list(docs.schema)) if keep_columns else None
    out = schema if keep_columns else "doc_id long, n_lines long, n_dropped long, text string"
    columns = [names[1] if c == "text" else c for c in docs.columns] if keep_columns else ["doc_id"]

    def cut(table, loses):
        """A table's rows without the lines that loses(ids, high, low) names."""
        data, offs, lines, ids = opened(table)
        near = np.flatnonzero(loses.some(lines.high.view(np.int64)))
        gone = np.zeros(len(lines.row), bool)
        if len(near):
            gone[lines.long[near]] = loses.all(ids[lines.row[lines.long[near]]], lines.high[near].view(np.int64), low_half(data, lines, near).view(np.int64))
        texts = without(data, offs, lines, gone)
        if keep_columns:
            texts = pc.if_else(pc.is_null(table[names[1]]), pa.scalar(None, pa.string()), texts)
            return [texts if c == names[1] else table[c] for c in columns], docs_names
        n_dropped = np.bincount(lines.row, weights=gone, minlength=len(ids)).astype(np.int64)
        return [table["doc_id"], pa.array(np.bincount(lines.row, minlength=len(ids)).astype(np.int64)), pa.array(n_dropped), texts], ["doc_id", "n_lines", "n_dropped", "text"]

    docs_names = list(docs.columns)
    if common.count() <= SENT:  # three numbers a key
        rows = common.toArrow()
        known = docs.sparkSession.sparkContext.broadcast(Common(*(rows[c].to_numpy() for c in ("high", "low", "keeper"))))

        def in_place(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part, named = cut(batch.slice(lo, 2000), known.value)
                    yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in part], names=named)

        return dealt.drop(names[2]).mapInArrow(tidy(in_place), out)

    lose = held.join(common, ["high", "low"]).where("id <> keeper").select("batch", "id", "high", "low")

    def finish(batch, table, drop):
        part, named = cut(table, Listed(*(drop[c].to_numpy() for c in ("id", "high", "low"))))
        return pa.table(part, names=named)

    return dealt.groupBy(names[2]).cogroup(lose.groupBy("batch")).applyInArrow(tidy(finish), out)


class Common(NamedTuple):
    """Keys that many documents hold, and the doc_id that keeps each."""

    high: np.ndarray
    low: np.ndarray
    keeper: np.ndarray

    def some(self, high: np.ndarray) -> np.ndarray:
        return np.isin(high, self.high)

    def all(self, ids: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        by = np.lexsort((self.low, self.high))
        keys, keeper = whole(np.stack([self.high[by], self.low[by]], 1)), self.keeper[by]
        mine, place = np.unique(whole(np.stack([high, low], 1)), return_inverse=True)
        both, at, of = np.intersect1d(keys, mine, assume_unique=True, return_indices=True)
        kept = np.zeros(len(mine), np.int64)
        held = np.zeros(len(mine), bool)
        kept[of], held[of] = keeper[at], True
        return held[place] & (kept[place] != ids)


class Listed(NamedTuple):
    """Lines that documents of one batch lose."""

    ids: np.ndarray
    high: np.ndarray
    low: np.ndarray

    def some(self, high: np.ndarray) -> np.ndarray:
        return np.isin(high, self.high)

    def all(self, ids: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.isin(whole(np.stack([ids, high, low], 1)), whole(np.stack(self, 1)))


def whole(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as single values that can be compared."""
    return np.ascontiguousarray(rows).view([("", rows.dtype)] * rows.shape[1]).ravel()


def without(data: np.ndarray, offs: np.ndarray, lines: Lines, gone: np.ndarray) -> pa.Array:
    """Each row's lines that stay, joined by line breaks."""
    change = np.zeros(len(data) + 1, np.int8)
    # a line goes with the break before it; the first line that stays in a row comes without one
    stays = np.flatnonzero(~gone)
    first = np.ones(len(stays), bool)
    first[1:] = lines.row[stays[1:]] != lines.row[stays[:-1]]
    lead = lines.start[stays] - ~first
    some = lines.end[stays] > lead  # an empty line alone has no bytes; others never begin or end together
    lead, end = lead[some], lines.end[stays[some]]
    np.add.at(change, lead, 1)
    np.add.at(change, end, -1)
    mask = np.cumsum(change[:-1], dtype=np.int8) > 0
    sizes = np.zeros(len(offs), np.int64)
    np.cumsum(np.bincount(lines.row[stays[some]], weights=end - lead, minlength=len(offs) - 1).astype(np.int64), out=sizes[1:])
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(sizes.tobytes()), pa.py_buffer(data[mask].tobytes())).cast(pa.string())
