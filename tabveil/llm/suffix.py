"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Every string of LENGTH bytes has one anchor: the leftmost of its 16-byte parts whose hash is least. Equal strings have
equal anchors, so only suffixes around anchors that recur can match, and an anchor's hash deals them out over buckets.
Documents form batches in the order of doc_id. Each batch first asks which of its anchors other documents have too, by
packed hashes, and sends the bytes around those. A bucket takes the batches in turn: the suffixes of a new batch are
sorted by their first LENGTH bytes, merge-scanned against the levels that hold all earlier ones, and added as a level;
levels of like size merge, so there are about log2(n) of them. What a level holds always comes from smaller doc_ids.
An Index keeps its levels as a table by bucket and level, so that further batches can be added.

A batch sends a passage that it has many times once, so a passage in a third of all documents costs
one entry for each batch, and answers go back to batches in the same form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.llm.blobs import Steps, docs_of, pack, pack_planes, tidy, unpack, unpack_planes
from tabveil.llm.text import U64, buffers, mix, prefix, slabs, span_hash, window_hash

PART = 16  # bytes of an anchor
PIECE = 1 << 19  # bytes whose anchors are sought at once
PLACE = U64((1 << 20) - 1)  # room for a place in a piece
HASH = U64(8)  # bits of an anchor's hash that are dropped
SUBS = 1 << 20  # batches that one doc_id may fill


def argmin_windows(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes, the position of the leftmost least one, by their upper 44 bits."""
    value, size = (g & ~PLACE) | np.arange(len(g), dtype=U64), 1
    while size * 2 <= width:
        value = np.minimum(value[size:], value[:-size])
        size *= 2
    if rest := width - size:
        value = np.minimum(value[rest:], value[:-rest])
    return (value & PLACE).astype(np.int32)


def contexts(data: np.ndarray, offs: np.ndarray, length: int):
    """First window, windows, row, anchor's hash and anchor's offset, of each anchor's run of windows."""
    out = []
    spans = []
    for lo, hi in slabs(offs, PIECE):
        a, b = int(offs[lo]), int(offs[hi])
        # a single long row is cut into pieces that overlap by length - 1 bytes: no window is lost or seen twice
        spans += [(at, min(b, at + PIECE + length - 1)) for at in range(a, max(a + 1, b - length + 1), PIECE)] if hi - lo == 1 and b - a > PIECE else [(a, b)]
    for a, b in spans:
        if b - a < length:
            continue
        g = window_hash(prefix(data[a:b]), PART)
        at = argmin_windows(g, length - PART + 1)
        n = len(at)
        lo, hi = int(np.searchsorted(offs, a, "right")) - 1, int(np.searchsorted(offs, b, "left"))
        times = np.diff(np.clip(offs[lo : hi + 1], a, b))
        rows = np.repeat(np.arange(lo, hi, dtype=np.int32), times)[:n]
        valid = np.arange(a + length, a + length + n) <= np.repeat(offs[lo + 1 : hi + 1], times)[:n]
        start = valid.copy()
        start[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        end = valid.copy()
        end[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
        s, e = np.flatnonzero(start), np.flatnonzero(end)
        out.append((s + a, (e - s + 1).astype(np.uint8), rows[s], mix(g[at[s]]) >> HASH, (at[s] - s).astype(np.uint8)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint8, np.int32, U64, np.uint8))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def step_of(buckets: int) -> U64:
    """Anchors' hashes of one bucket."""
    return U64((1 << (64 - int(HASH))) // buckets + 1)


def opened(table: pa.Table, length: int):
    """A batch's bytes and offsets, and its contexts with the place of their document in the order of doc_id."""
    ids = table["doc_id"].to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int32)
    ordered = ids[order]
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))[: len(ids)]
    data, offs = buffers(table["text"])
    start, n, row, anchor, shift = contexts(data, offs, length)
    return data, offs, start, n, rank[row], anchor, shift


def ask(table: pa.Table, length: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Per bucket the batch's distinct anchors, and which of them several of its documents have."""
    _, _, _, _, rank, anchor, _ = opened(table, length)
    u, place = np.unique(anchor, return_inverse=True)
    low, high = np.full(len(u), np.iinfo(np.int32).max, np.int32), np.full(len(u), -1, np.int32)
    np.minimum.at(low, place, rank)
    np.maximum.at(high, place, rank)
    cuts = np.searchsorted(u // step_of(buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[b], cuts[b + 1])
        yield int(b), pack_planes(np.diff(u[s], prepend=U64(0))), pack(np.packbits(high[s] > low[s]).tobytes())


def tell(asked: list[bytes], flags: list[bytes]) -> list[bytes]:
    """For each batch, which of its anchors in one bucket several documents have."""
    keys = [np.cumsum(unpack_planes(x, U64), dtype=U64) for x in asked]
    own = [np.unpackbits(np.frombuffer(unpack(f), np.uint8), count=len(k)) for f, k in zip(flags, keys, strict=True)]
    _, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    many = times > 1
    many[place[np.concatenate(own) > 0]] = True
    return [pack(np.packbits(m).tobytes()) for m in np.split(many[place], np.cumsum([len(k) for k in keys])[:-1])]


def batch_index(table: pa.Table, told: dict[int, bytes] | None, length: int, buckets: int):
    """A batch's contexts whose anchors recur (all, if nothing is told), dealt to buckets and without repeats: the same for building and for reading answers."""
    data, offs, start, n, rank, anchor, shift = opened(table, length)
    if told is not None:
        u, place = np.unique(anchor, return_inverse=True)
        sizes = np.bincount((u // step_of(buckets)).astype(np.int64), minlength=buckets)
        parts = [np.unpackbits(np.frombuffer(unpack(told[b]), np.uint8), count=sizes[b]) for b in np.flatnonzero(sizes)]
        use = np.flatnonzero(np.concatenate(parts)[place]) if parts else np.zeros(0, np.int64)
        start, n, rank, anchor, shift = start[use], n[use], rank[use], anchor[use], shift[use]
    bucket = (anchor // step_of(buckets)).astype(np.int32)
    key = hashes(data, start, n.astype(np.int64) + length - 1) ^ shift.astype(U64)
    by = np.lexsort((key, bucket))
    same = np.zeros(len(by), bool)
    same[1:] = (key[by][1:] == key[by][:-1]) & (bucket[by][1:] == bucket[by][:-1])
    first = np.flatnonzero(~same)
    # what is sent goes by least rank in its bucket, so that ranks pack to almost nothing
    low = np.minimum.reduceat(rank[by], first) if len(by) else rank
    turn = np.lexsort((low, bucket[by[first]]))
    return data, offs, start, n, shift, rank, bucket, by, first, turn


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each span of a batch, in pieces of bounded size; starts ascend."""
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + PIECE)))
        lo, hi = int(start[at]), int((start[at:to] + size[at:to]).max())
        out[at:to] = span_hash(prefix(data[lo:hi]), start[at:to] - lo, start[at:to] + size[at:to] - lo)
        at = to
    return out


def build(table: pa.Table, told: dict[int, bytes] | None, length: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    data, _, start, n, shift, rank, bucket, by, first, turn = batch_index(table, told, length, buckets)
    if not len(by):
        return
    low, high = np.minimum.reduceat(rank[by], first)[turn], np.maximum.reduceat(rank[by], first)[turn]
    head = by[first][turn]
    cuts = np.searchsorted(bucket[head], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        one = head[cuts[b] : cuts[b + 1]]
        size = n[one].astype(np.int64) + length - 1
        raw = gather(data, start[one], size)
        # as planes of bytes: the upper bytes of the steps, and the difference of a string that occurs once, pack to almost nothing
        ranks = np.stack([np.diff(low[cuts[b] : cuts[b + 1]], prepend=0), (high - low)[cuts[b] : cuts[b + 1]]]).astype(np.uint32)
        yield int(b), closed(ranks, n[one], shift[one], raw)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def closed(ranks: np.ndarray, n: np.ndarray, shift: np.ndarray, raw: np.ndarray) -> bytes:
    """Contexts as a blob, from steps of ranks, windows, offsets of anchors, and bytes."""
    planes = np.ascontiguousarray(ranks.view(np.uint8).reshape(2 * len(n), 4).T)
    return pack(np.uint32(len(n)).tobytes() + planes.tobytes() + n.astype(np.uint8).tobytes() + shift.astype(np.uint8).tobytes() + raw.tobytes())


def read(blob: bytes):
    """Least and largest rank, windows and anchor's offset of each context of a blob, and the contexts' bytes."""
    raw = unpack(blob)
    m = int(np.frombuffer(raw, np.uint32, 1)[0])
    planes = np.frombuffer(raw, np.uint8, 8 * m, 4).reshape(4, 2 * m)
    step, more = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint32).reshape(2, m).astype(np.int64)
    low = np.cumsum(step)
    n, shift = np.frombuffer(raw, np.uint8, 2 * m, 4 + 8 * m).reshape(2, m)
    return low, low + more, n.astype(np.int64), shift.astype(np.int64), np.frombuffer(raw, np.uint8, offset=4 + 10 * m)


def begins(n: np.ndarray, length: int) -> np.ndarray:
    size = n + length - 1
    return np.cumsum(size) - size


def meeting(blobs: list, length: int) -> list[np.ndarray]:
    """For each blob, the places of the contexts that several documents have, or whose anchor another context has too."""
    keys = []
    for _, _, n, shift, raw in blobs:
        x = raw[(begins(n, length) + shift)[:, None] + np.arange(PART)].view(U64).reshape(-1, 2)
        keys.append(mix(x[:, 0]) + x[:, 1])
    sizes = [len(k) for k in keys]
    keys = np.concatenate(keys)
    by = np.argsort(keys, kind="stable")
    same = keys[by][1:] == keys[by][:-1]
    shared = np.zeros(len(keys), bool)
    shared[by[1:][same]] = True
    shared[by[:-1][same]] = True
    shared |= np.concatenate([high > low for low, high, *_ in blobs])
    return [np.flatnonzero(x) for x in np.split(shared, np.cumsum(sizes)[:-1])]


def suffixes(raw: np.ndarray, w: np.ndarray, length: int) -> np.ndarray:
    """The first `length` bytes of the suffixes at w, as strings that compare byte by byte."""
    if not len(w):
        return np.zeros(0, f"S{length}")
    return np.ndarray(len(raw) - length + 1, f"S{length}", np.ascontiguousarray(raw), strides=(1,))[w]


def alike(raw: np.ndarray, w: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix starts one for each distinct string, and for each start which of those it equals.

    Starts are grouped by hash; every group's bytes are compared, and only if some differ all strings are sorted instead.
    """
    h = span_hash(prefix(raw), w, w + length)
    by = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
    group = np.empty(len(w), np.int64)
    group[by] = np.cumsum(new) - 1
    head = w[by[new]]
    for lo in range(0, len(w), PIECE):
        mine, other = suffixes(raw, w[lo : lo + PIECE], length), suffixes(raw, head[group[lo : lo + PIECE]], length)
        if not (mine == other).all():
            _, first, group = np.unique(suffixes(raw, w, length), return_index=True, return_inverse=True)
            return w[first], group
    return head, group


def scan(steps: list[int], blobs: list[bytes], length: int, group: int = 400_000) -> Iterator[tuple[int, bytes]]:
    """One bucket: batches in the order of doc_id against the levels; (batch's number, which windows were seen before).

    Batches of one step hold a single doc_id, and don't see each other.
    """
    levels: list[np.ndarray] = []  # each the sorted suffixes of earlier batches, by their first `length` bytes
    held = [read(x) for x in blobs]
    meet = meeting(held, length) if held else []
    at = 0
    while at < len(steps):
        took, size = [], 0
        while at < len(steps) and (size < group or steps[at] == steps[at - 1]):
            low, high, n, _, raw = held[at]
            m = meet[at]
            if len(m):
                took.append((at, m, low[m], high[m], n[m], gather(raw, begins(n, length)[m], n[m] + length - 1)))
                size += int(n[m].sum())
            held[at] = None
            at += 1
        if not took:
            continue
        n = np.concatenate([x[4] for x in took])
        batch = np.repeat(np.arange(len(took)), [len(x[1]) for x in took])
        turn = np.unique([steps[x[0]] for x in took], return_inverse=True)[1]
        part = turn[batch]
        low, high = (np.concatenate([x[k] for x in took]) + (part << 32) for k in (2, 3))
        raw, place = np.concatenate([x[5] for x in took]), np.concatenate([x[1] for x in took])
        of = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        head, same = alike(raw, begins(n, length)[of] + off, length)
        best = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(best, same, low[of])
        # the new suffix array, and its merge-scan: a string with an equal neighbour in a level was seen before
        strings = suffixes(raw, head, length)
        order = np.argsort(strings, kind="stable")
        strings = strings[order]
        for level in levels:  # everything in a level comes from a smaller doc_id
            i = np.searchsorted(level, strings)
            i[i == len(level)] = 0
            best[order[level[i] == strings]] = -1
        least = best[same]
        hit = np.flatnonzero(least < high[of])
        if len(hit):
            c = of[hit]
            mine = np.maximum(least[hit] - (part[c] << 32), -1)  # any earlier batch counts as -1
            o = np.lexsort((mine, c))
            c, mine, bit = c[o], mine[o], U64(1) << off[hit][o].astype(U64)
            cut = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (mine[1:] != mine[:-1])]))
            c, mine, mask = c[cut], mine[cut], np.bitwise_or.reduceat(bit, cut)
            bounds = np.searchsorted(batch[c], np.arange(len(took) + 1))
            for k in np.flatnonzero(np.diff(bounds)):
                s = slice(bounds[k], bounds[k + 1])
                yield took[k][0], pack(place[c[s]].astype(np.int32).tobytes() + mine[s].astype(np.int32).tobytes() + mask[s].tobytes())
        while levels and len(levels[-1]) <= 2 * len(strings):
            strings = merged(levels.pop(), strings)
        levels.append(strings)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted levels as one, each string once; sorting two runs is a merge."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])]


def apply(table: pa.Table, told: dict[int, bytes] | None, answers: list[tuple[int, bytes]], length: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a batch, its offsets, and which bytes go."""
    data, offs, start, _, _, rank, bucket, by, first, turn = batch_index(table, told, length, buckets)
    hit = np.zeros(len(data) + 1, np.int8)
    cuts = np.searchsorted(bucket[by[first]] if len(by) else [], np.arange(buckets + 1))
    ends = np.append(first, len(by))
    for b, blob in answers:
        raw = unpack(blob)
        m = len(raw) // 16
        c, mine = np.frombuffer(raw, np.int32, 2 * m).reshape(2, m)
        mask = np.frombuffer(raw, U64, m, 8 * m)
        u = turn[cuts[b] + c]
        times = ends[u + 1] - ends[u]
        rec = np.repeat(np.arange(m), times)
        places = by[np.repeat(ends[u] - (np.cumsum(times) - times), times) + np.arange(len(rec))]
        keep = rank[places] > mine[rec]
        places, rec = start[places[keep]], rec[keep]
        bits = mask[rec]
        for off in range(length - PART + 1):
            hit[places[(bits >> U64(off)) & U64(1) == 1] + off] = 1
    total = np.cumsum(hit[: len(data)], dtype=np.int32)
    total[length:] -= total[:-length].copy()
    return data, offs, total > 0


def level_of(blobs: list[bytes], length: int) -> tuple[int, bytes]:
    """The contexts of several blobs as one level: distinct, in the order of the suffixes that begin at their anchors."""
    held = [read(x) for x in blobs]
    n, shift = (np.concatenate([x[k] for x in held]) for k in (2, 3))
    raw = np.concatenate([x[4] for x in held])
    begin, size = begins(n, length), n + length - 1
    text = raw.tobytes()
    spans = [(text[b + s : b + z], text[b : b + s][::-1], k) for k, (b, s, z) in enumerate(zip(begin.tolist(), shift.tolist(), size.tolist(), strict=True))]
    spans.sort()
    order = np.array([k for j, (r, l, k) in enumerate(spans) if not j or (r, l) != spans[j - 1][:2]], np.int64)
    return len(order), closed(np.zeros((2, len(order)), np.uint32), n[order], shift[order], gather(raw, begin[order], size[order]))


BLOBS = "batch long, bucket int, blob binary"


class Index:
    """The levels of all batches so far as a table (bucket, size, blob), in the folder that all machines share.

    Batches must come in the order of doc_id: what is in the index counts as earlier than a new batch.
    """

    def __init__(self, spark: SparkSession, length: int = 50, buckets: int = 16) -> None:
        self.steps, self.length, self.buckets, self.levels = Steps(spark), length, buckets, None

    def add(self, docs: DataFrame, batch_mb: float = 16) -> DataFrame:
        """The batch without what earlier documents have, as `dedup` returns it; its suffixes join the index."""
        out, sent, old = _dedup(docs, self.length, batch_mb, self.buckets, self)
        length = self.length

        def merge(key, new, levels):
            bucket = key[0].as_py()
            have = sorted(zip(levels["size"].to_pylist(), levels["blob"].to_pylist(), strict=True), reverse=True)
            if len(new):
                size, blob = level_of(new["blob"].to_pylist(), length)
                while have and have[-1][0] <= 2 * size:
                    size, blob = level_of([have.pop()[1], blob], length)
                have.append((size, blob))
            return pa.table({"bucket": pa.array([bucket] * len(have), pa.int32()), "size": pa.array([s for s, _ in have], pa.int64()), "blob": pa.array([b for _, b in have], pa.binary())})

        out = self.steps.keep(out)
        self.levels = self.steps.keep(sent.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(tidy(merge), "bucket int, size long, blob binary"))
        return out


def dedup(docs: DataFrame, length: int = 50, batch_mb: float = 16, bucket_mb: float = 4) -> DataFrame:
    """Remove each byte that a `length`-byte string covers which also starts in a document of smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes).
    Null and empty texts give empty results. Strings are judged on the input. Rows of equal doc_id never
    remove each other's bytes, however many they are; a null doc_id counts as larger than all others, and all null ones as
    equal. An empty table gives none. `length` must lie between 32 and 79: an anchor's windows are the bits of one 64-bit mask.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return _dedup(docs, length, batch_mb, int(total // (bucket_mb * (1 << 20))) + 1, None, total)[0]


def _dedup(docs: DataFrame, length: int, batch_mb: float, buckets: int, index: Index | None, total: int | None = None):
    if not 32 <= length <= PART + 63:
        raise ValueError("length must lie between 32 and 79")
    spark = docs.sparkSession
    docs = docs_of(docs, "doc_id", "text").withColumn("null_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("text", F.coalesce("text", F.lit("")))
    size = int(batch_mb * (1 << 20))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0 if total is None else total
    n = int(total // size) + 1
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else []
    # an id with more text than a batch has a step of its own, of several batches: at most one in so many batches
    full = {r["doc_id"]: r["size"] for r in docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size")).where(F.col("size") > 2 * size).collect()} if n > 1 else {}
    edges = np.unique(np.array([*(cuts or []), *full, *(i - 1 for i in full if i > -(1 << 63))], np.int64))
    subs = np.ones(len(edges) + 1, np.int64)
    for i, s in full.items():
        subs[np.searchsorted(edges, i, "left")] = min(SUBS, s // size + 1)
    dealing = spark.sparkContext.broadcast((edges, subs))  # 16 bytes for each batch of text

    @F.pandas_udf("long")
    def batch_of(ids, keys):
        import pandas as pd

        edges, subs = dealing.value
        step = np.searchsorted(edges, ids.to_numpy(), "left")
        return pd.Series(step * SUBS + keys.to_numpy() % subs[step])

    dealt = docs.withColumn("batch", batch_of("doc_id", F.xxhash64("text")))
    told, fresh = None, index is None
    if fresh:

        def first(key, table):
            rows = list(ask(table, length, buckets))
            return pa.table({"batch": pa.array([key[0].as_py()] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary()), "flags": pa.array([r[2] for r in rows], pa.binary())})

        def second(key, table):
            blobs = tell(table["blob"].to_pylist(), table["flags"].to_pylist())
            return pa.table({"batch": table["batch"], "bucket": table["bucket"], "blob": pa.array(blobs, pa.binary())})

        told = dealt.groupBy("batch").applyInArrow(tidy(first), f"{BLOBS}, flags binary").groupBy("bucket").applyInArrow(tidy(second), BLOBS)

    def blobs_of(table) -> dict[int, bytes]:
        return dict(zip(table["bucket"].to_pylist(), table["blob"].to_pylist(), strict=True))

    def sending(batch: int, table, masks):
        rows = list(build(table, masks, length, buckets))
        return pa.table({"batch": pa.array([batch] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    def send_some(key, table, masks):
        return sending(key[0].as_py(), table, blobs_of(masks))

    def send_all(key, table):
        return sending(key[0].as_py(), table, None)

    def answer(bucket: int, batches: list[int], blobs: list[bytes], old: list[bytes]):
        """The index counts as a batch before all others."""
        by = sorted(range(len(batches)), key=batches.__getitem__)
        numbers = [-1] * len(old) + [batches[k] for k in by]
        rows = [(numbers[k], blob) for k, blob in scan([x // SUBS for x in numbers], old + [blobs[k] for k in by], length) if numbers[k] >= 0]
        return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    def seek(key, table):
        return answer(key[0].as_py(), table["batch"].to_pylist(), table["blob"].to_pylist(), [])

    def seek_in(key, table, levels):
        return answer(key[0].as_py(), table["batch"].to_pylist(), table["blob"].to_pylist(), levels["blob"].to_pylist())

    def finish(key, table, back):
        kinds = np.array(back["told"].to_pylist(), bool)
        rows = list(zip(back["bucket"].to_pylist(), back["blob"].to_pylist(), strict=True))
        masks = {b: x for (b, x), k in zip(rows, kinds, strict=True) if k} if fresh else None
        data, offs, gone = apply(table, masks, [r for r, k in zip(rows, kinds, strict=True) if not k], length, buckets)
        n_removed, n_spans, kept = [], [], []
        for a, b in zip(offs[:-1], offs[1:], strict=True):
            g = gone[a:b]
            n_removed.append(int(g.sum()))
            n_spans.append(int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()))
            kept.append(data[a:b][~g].tobytes() if n_removed[-1] else data[a:b].tobytes())
        ids = pa.array(table["doc_id"].to_numpy(zero_copy_only=False), pa.int64(), mask=table["null_id"].to_numpy(zero_copy_only=False))
        return pa.table({"doc_id": ids, "n_bytes": pa.array(np.diff(offs), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.large_binary()).cast(pa.binary())})

    by_batch = dealt.groupBy("batch")
    sent, old = None, None
    if fresh:
        answers = by_batch.cogroup(told.groupBy("batch")).applyInArrow(tidy(send_some), BLOBS).groupBy("bucket").applyInArrow(tidy(seek), BLOBS)
        answers = answers.withColumn("told", F.lit(False)).union(told.withColumn("told", F.lit(True)))
    else:
        sent = index.steps.keep(by_batch.applyInArrow(tidy(send_all), BLOBS))
        old = index.levels if index.levels is not None else spark.createDataFrame([], "bucket int, size long, blob binary")
        answers = sent.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(tidy(seek_in), BLOBS).withColumn("told", F.lit(False))
    return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(tidy(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"), sent, old
