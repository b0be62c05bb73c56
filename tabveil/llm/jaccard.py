"""Exact Jaccard join of word shingles with adaptive multi-match prefixes.

A document's shingles are put in one global order: rarest first, by a count sketch of fixed size that is
summed over the whole corpus, then by hash. Two documents that are similar enough share at least l shingles
among the first n - ceil(t * n) + l of each. Each document picks its own l: it lengthens its prefix as long
as the estimated cost of the candidates falls. Candidates are verified only if they share as many prefix shingles as
the two prefixes and the two sizes demand.

Documents with equal sets form a class, and only classes take part. A class that shares enough prefix shingles with
the least class that holds them, its hub, belongs to that hub's cluster; others are clusters of one. Where a prefix shingle is
held in several clusters, a class that may be linked with a member of another cluster becomes its guest (of two clusters the
one of greater number sends the guests), and one row stands for all of that cluster's members: a group of m near copies
makes no row for each pair. Every set also has a bitmap in which each shingle flips one bit; two bitmaps differ in no
more bits than the sets in shingles, so most classes that can't be linked never meet.

Members and guests of a cluster are then compared with its members in blocks of like sizes, by multiplying matrices of whole
sets: m * m / (classes of a block) sets are sent. A block tells how many rows each class is linked with there, and which
classes hang together; components join those.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.blobs import Steps, bits_for, docs_of, filters, holds, pack_planes, tidy, unpack_planes
from tabveil.llm.components import components
from tabveil.llm.text import LOWER, U64, buffers, combine, grams, mix, prefix, slabs, span_hash, words

SKETCH = 20  # log2 of the counters of the sketch: 4 MB, whatever the corpus
MOST_L = 8
PAIRS = 200_000  # pairs whose bitmaps a task compares at a time
VERIFY = 40.0  # cost of verifying a candidate, in postings read
FLIPS = 8  # 64-bit words of a bitmap
HOLDERS = 20_000  # holders of one shingle that a task compares with as many others
BLOCK = 250_000  # shingles of a block's sets
MEMBERS = 512  # classes of a block
COLUMNS = 2048  # shingles of a block that are multiplied at a time
SENT = 500_000  # rows of a few numbers that are broadcast at most


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, in the order of row and hash."""
    low = LOWER[data]
    start, end, row = words(low, offs)
    h = span_hash(prefix(low), start, end)
    g, at = grams(h, row, n)
    rows = row[at]
    count = np.bincount(row, minlength=len(offs) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(row, short)
        one = h[first]
        for j in range(1, n):
            more = np.flatnonzero(count[short] > j)
            one[more] = combine(one[more], h[first[more] + j])
        g, rows = np.concatenate([g, mix(one + count[short].astype(U64))]), np.concatenate([rows, short])
    by = np.lexsort((g, rows))
    g, rows = g[by], rows[by]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], g[new]


def classes(rows: np.ndarray, g: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and fingerprint of each row's set; 0 for an empty one."""
    n = np.bincount(rows, minlength=m)
    key = np.zeros(m, U64)
    if len(g):
        has = np.flatnonzero(n)
        key[has] = mix(np.add.reduceat(mix(g ^ U64(0x5851F42D4C957F2D)), np.searchsorted(rows, has)) + n[has].astype(U64))
    return n, key.view(np.int64)


def parities(rows: np.ndarray, g: np.ndarray, m: int) -> np.ndarray:
    """Each row's bitmap, FLIPS words a row."""
    bits = 64 * FLIPS
    odd = np.bincount(rows * bits + (mix(g + U64(FLIPS)) % U64(bits)).astype(np.int64), minlength=m * bits) & 1
    return np.packbits(odd.astype(bool).reshape(m, bits), axis=1).view(np.int64)


def prefixes(rows: np.ndarray, g: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int):
    """Each row's chosen l, and its prefix as (row, hash)."""
    seen = sketch[(g >> U64(64 - SKETCH)).astype(np.int64)]
    by = np.lexsort((g, seen, rows))
    g, extra = g[by], np.maximum(seen[by] - sketch.mean(), 0) + 1.0
    cost = np.concatenate([[0.0], np.cumsum(extra)])
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    need = -(-percent * n // 100)
    best, chosen = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for l in range(1, MOST_L + 1):
        can = (n > 0) & (l <= need)
        size = np.where(can, n - need + l, 0)
        read = cost[first + size] - cost[first]
        total = read + VERIFY * read / l**2
        better = can & (total < best)
        best[better], chosen[better] = total[better], l
    size = np.where(n > 0, n - need + chosen, 0)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return chosen, size, g[at]


def similar(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Classes of documents linked by 100 * intersection >= percent * union of n-word shingle sets.

    Words are maximal runs other than space and 0x09-0x0D, with A-Z lower-cased; fewer than n words make one
    shingle of the whole sequence. Returns doc_id, n_shingles, component_id, the smallest doc_id reachable by
    links, and n_links, the number of other rows that a row is linked with. Null and empty texts have no shingles
    and stand alone, and so does a component of null doc_ids only (its component_id is null). Rows that repeat a
    doc_id each count. An empty table gives no rows.
    """
    steps = Steps(docs.sparkSession)
    rows, near, links = linked(docs_of(docs, "doc_id", "text"), n, percent, steps)
    by_class = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("held"))
    by_class = by_class.join(near.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    roots = by_class.groupBy("component").agg(F.min("least").alias("component_id"))
    told = by_class.join(links, "cls", "left").join(roots, "component").select("cls", "component_id", (F.col("held") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(told, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def linked(docs: DataFrame, n: int, percent: int, steps: Steps) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (doc_id, text): (doc_id, key, n, cls) of each row, (node, component) of each class that has a link, (cls, links)."""
    docs = docs.withColumn("key", F.xxhash64("text"))
    chosen = steps.keep(choose(docs, n, percent))
    rows = steps.keep(chosen.select("doc_id", "key", "n", "cls"))
    shared, meta = meetings(chosen, steps)
    steps.drop(chosen)
    meta = steps.keep(clusters(shared, meta, percent))
    guests = visits(shared, meta, percent, steps)
    steps.drop(shared)
    found = compared(docs, rows, meta, guests, n, percent, steps)
    steps.drop(meta, guests)
    near = components(found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")), steps)
    return rows, near, found.groupBy("cls").agg(F.sum("links").alias("links"))


def choose(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, key, n, cls, l and the shingles after the prefix of each row; a task's first row of a class has the prefix and the bitmap."""
    spark = docs.sparkSession
    width, slices = 1 << 14, 1 << (SKETCH - 14)

    def count(batches):
        total = np.zeros(1 << SKETCH, np.int32)
        for batch in batches:
            data, offs = buffers(batch["text"])
            for a, b in slabs(offs):
                rows, g = shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n)
                total += np.bincount((g >> U64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH).astype(np.int32)
        for k in range(slices):
            if (part := total[k * width : (k + 1) * width]).any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "counts": [pack_planes(part)]})

    def add(table):
        total = np.zeros(width, np.float64)
        for blob in table["counts"]:
            total += unpack_planes(blob.as_py(), np.int32)
        return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "counts": [total.tobytes()]})

    sketch = np.zeros(1 << SKETCH)
    for row in docs.select("text").mapInArrow(tidy(count), "slice int, counts binary").groupBy("slice").applyInArrow(tidy(add), "slice int, counts binary").toLocalIterator():
        sketch[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(bytes(row["counts"]))
    order = spark.sparkContext.broadcast(sketch)

    def pick(batches):
        seen: set[int] = set()
        for batch in batches:
            data, offs = buffers(batch["text"])
            for a, b in slabs(offs):
                rows, g = shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n)
                size, key = classes(rows, g, b - a)
                l, took, tokens = prefixes(rows, g, size, order.value, percent)
                new = np.array([s > 0 and not (k in seen or seen.add(k)) for s, k in zip(size, key.tolist(), strict=True)], bool)
                tokens = tokens[np.repeat(new, took)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(new, took, 0))]), pa.int32()), pa.array(tokens.view(np.int64)))
                flips = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(new, FLIPS, 0))]), pa.int32()), pa.array(parities(rows, g, b - a)[new].ravel()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["key"].slice(a, b - a), pa.array(size, pa.int64()), pa.array(key), pa.array(l, pa.int32()), pa.array(size - took, pa.int32()), lists, flips], names=["doc_id", "key", "n", "cls", "l", "rest", "tokens", "flips"])

    return docs.select("doc_id", "key", "text").mapInArrow(tidy(pick), "doc_id long, key long, n long, cls long, l int, rest int, tokens array<long>, flips array<long>")


def meetings(chosen: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """(token, cls, n, l, rest, hub) of the prefix shingles that several classes hold, and (cls, n, l, flips) of those classes.

    Shingles are counted with a combine before the shuffle; those of one class stop at a filter of 16 MB at most.
    """
    spark = chosen.sparkSession
    one = chosen.where("size(flips) > 0")
    held = one.select("cls", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("cls").alias("hub"), F.max("cls").alias("most")).where("hub <> most").select("token", "hub")
    held = steps.keep(held)
    bits = bits_for(held.count())
    shift = U64(64 - bits)

    def at(batch):
        return (batch["token"].to_numpy(zero_copy_only=False).view(U64) >> shift).astype(np.int64)[:, None]

    wanted = spark.sparkContext.broadcast(filters(held.select("token"), bits, at)[0])

    def pass_on(batches):
        for batch in batches:
            lists = batch["tokens"]
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            ok = np.flatnonzero(holds(wanted.value, (tokens.view(U64) >> shift).astype(np.int64)))
            row = np.repeat(np.arange(len(size)), size)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[ok]), *(batch[c].take(pa.array(row)) for c in ("cls", "n", "l", "rest"))], names=["token", "cls", "n", "l", "rest"])

    some = one.select("tokens", "cls", "n", "l", "rest").mapInArrow(tidy(pass_on), "token long, cls long, n long, l int, rest int")
    shared = steps.keep(some.join(held, "token").dropDuplicates(["token", "cls"]))
    meta = one.select("cls", "n", "l", "flips").join(shared.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
    steps.drop(held)
    return shared, steps.keep(meta)


def clusters(shared: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """meta with each class's cluster: the hub of most of its prefix shingles, if it may be half alike, else itself."""
    stars = shared.where("cls <> hub").groupBy("cls", "hub").agg(F.count("*").alias("c"))
    hub = meta.select(F.col("cls").alias("hub"), F.col("n").alias("n2"), F.col("l").alias("l2"), F.col("flips").alias("f2"))
    stars = stars.join(meta.select("cls", "n", "l", "flips"), "cls").join(hub, "hub").where("c >= least(l, l2)")
    apart = F.expr("aggregate(zip_with(flips, f2, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    stars = stars.where(50 * (F.col("n") + F.col("n2")) >= 150 * apart)
    best = stars.groupBy("cls").agg(F.max(F.struct("c", "hub")).alias("best")).select("cls", F.col("best.hub").alias("cluster"))
    return meta.join(best, "cls", "left").withColumn("cluster", F.coalesce("cluster", "cls"))


def visits(shared: DataFrame, meta: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """(cls, cluster) of each guest: a class that may be linked with a member of another cluster, of smaller number."""
    label = steps.keep(shared.drop("hub").join(meta.select("cls", "cluster"), "cls"))
    mixed = label.groupBy("token").agg(F.min("cluster").alias("p"), F.max("cluster").alias("q"), F.count("*").alias("c")).where("p <> q")
    mixed = mixed.select("token", F.ceil(F.col("c") / HOLDERS).cast("int").alias("chunks"))
    # a shingle of very many holders is dealt over cells: each chunk of holders meets each other one once
    cells = label.join(mixed, "token").withColumn("chunk", F.expr("cast(pmod(xxhash64(cls), chunks) as int)"))
    cells = cells.select("*", F.explode(F.expr("transform(sequence(0, chunks - 1), k -> named_struct('i', least(chunk, k), 'j', greatest(chunk, k)))")).alias("cell"))
    cells = cells.select("token", "cell.i", "cell.j", "cluster", "chunk", "cls", "n", "l", "rest").join(meta.select("cls", "flips"), "cls")
    key = ["token", "i", "j"]
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(parts, *key).sortWithinPartitions(*key, "cluster")
    names = [*key, "cluster", "chunk", "cls", "n", "l", "rest"]

    def opened(batch) -> dict[str, np.ndarray]:
        t = {c: batch[c].to_numpy(zero_copy_only=False) for c in names}
        return t | {"flips": batch["flips"].flatten().to_numpy(zero_copy_only=False).reshape(-1, FLIPS)}

    def meet(batches):
        for t, starts, ends in by_key(batches, opened, key):
            done = int(ends[-1])
            step = np.flatnonzero(np.concatenate([t["cluster"][1:done] != t["cluster"][: done - 1], [True]])) + 1
            step = np.union1d(step, ends)
            group = np.repeat(starts, ends - starts)  # each row meets the rows of earlier clusters
            times = np.concatenate([[0], step])[np.searchsorted(step, np.arange(done), "right")] - group
            upto = np.cumsum(times)
            at = 0
            while at < done:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                k = times[at:to]
                j = np.repeat(np.arange(at, to), k)
                i = np.repeat(group[at:to] - (np.cumsum(k) - k), k) + np.arange(len(j))
                at = to
                ok = (100 * np.minimum(t["n"][i], t["n"][j]) >= percent * np.maximum(t["n"][i], t["n"][j])) & ((t["i"][i] == t["j"][i]) | (t["chunk"][i] != t["chunk"][j]))
                i, j = i[ok], j[ok]
                both = t["n"][i] + t["n"][j]
                ok = (100 - percent) * both >= (100 + percent) * np.bitwise_count((t["flips"][i] ^ t["flips"][j]).view(U64)).sum(1, dtype=np.int64)
                i, j, both = i[ok], j[ok], both[ok]
                if not len(i):
                    continue
                # the overlap is at most the shared prefix shingles plus the longer rest; the threshold asks for `percent` of the union
                asked = np.maximum(np.minimum(t["l"][i], t["l"][j]), -(-percent * both // (100 + percent)) - np.maximum(t["rest"][i], t["rest"][j]))
                by = np.lexsort((asked, t["cluster"][i], j))
                i, j, asked = i[by], j[by], asked[by]
                new = np.concatenate([[True], (j[1:] != j[:-1]) | (t["cluster"][i][1:] != t["cluster"][i][:-1])])
                yield pa.RecordBatch.from_pydict({"cls": t["cls"][j[new]], "cluster": t["cluster"][i[new]], "asked": asked[new].astype(np.int64)})

    met = cells.select(*names, "flips").mapInArrow(tidy(meet), "cls long, cluster long, asked long")
    # a shingle dealt over several cells may count more than once, which only lets more guests pass
    met = met.groupBy("cls", "cluster").agg(F.count("*").alias("c"), F.min("asked").alias("asked"))
    met = steps.keep(met.where("c >= asked").select("cls", "cluster"))
    steps.drop(label)
    return met


def by_key(batches, opened, key: list[str]):
    """(columns, starts, ends) of whole groups of rows with equal keys, from sorted batches; a group may span batches."""
    held = None
    for batch in chain(batches, [None]):
        t = held
        if batch is not None:
            new = opened(batch)
            t = new if t is None else {c: np.concatenate([t[c], x]) for c, x in new.items()}
        m = 0 if t is None else len(t[key[0]])
        if not m:
            continue
        differ = np.zeros(m - 1, bool)
        for c in key:
            differ |= t[c][1:] != t[c][:-1]
        starts = np.concatenate([[0], np.flatnonzero(differ) + 1])
        ends = np.append(starts[1:], m)
        if batch is not None:
            held = {c: x[starts[-1] :] for c, x in t.items()}
            starts, ends = starts[:-1], ends[:-1]
        if len(starts):
            yield t, starts, ends


def compared(docs: DataFrame, rows: DataFrame, meta: DataFrame, guests: DataFrame, n: int, percent: int, steps: Steps) -> DataFrame:
    """(cls, links, root): of the classes of one cell, how many rows of others each is linked with, and the least class it hangs with.

    Classes lie in bands by the logarithm of their size, so that linked ones are in the same band or in neighbouring ones,
    and a cluster's band is dealt by hash to blocks of about BLOCK shingles and MEMBERS classes at most. Every two blocks of one band or two neighbouring
    ones meet in one cell. Guests aren't compared with guests.
    """
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent * (1 + 1e-9)))) if percent < 100 else F.col("n")
    own = meta.select("cls", "cluster", "n", F.lit(False).alias("guest")).union(guests.join(meta.select("cls", "n"), "cls").select("cls", "cluster", "n", F.lit(True)))
    own = whole = steps.keep(own.withColumn("band", band.cast("long")))
    bands = own.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / MEMBERS)).alias("blocks"), F.count("*").alias("c")).groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands"), F.sum("c").alias("c"))
    own = own.join(bands.where("c > 1").drop("c"), "cluster").withColumn("block", F.expr("pmod(xxhash64(cls), bands[band])"))
    # (left block's band and number, right block's, whether this class is of the right block)
    cell = "named_struct('p', {}, 'i', {}, 'q', {}, 'j', {}, 'right', {})"
    same = f"transform(sequence(0L, bands[band] - 1), k -> {cell.format('band', 'least(block, k)', 'band', 'greatest(block, k)', 'k < block')})"
    up = f"if(bands[band + 1] is null, array(), transform(sequence(0L, bands[band + 1] - 1), k -> {cell.format('band', 'block', 'band + 1', 'k', 'false')}))"
    down = f"if(bands[band - 1] is null, array(), transform(sequence(0L, bands[band - 1] - 1), k -> {cell.format('band - 1', 'k', 'band', 'block', 'true')}))"
    met = dealt = steps.keep(own.select("cls", "cluster", "guest", F.explode(F.expr(f"concat({same}, {up}, {down})")).alias("cell")).select("cls", "cluster", "guest", "cell.*"))
    key = ["cluster", "p", "i", "q", "j"]
    one = "p = q and i = j"
    some = met.groupBy(*key).agg(F.count("*").alias("c"), F.count_if("right").alias("d"), F.count_if(~F.col("guest")).alias("m"))
    met = met.join(some.where(f"m > 0 and if({one}, c > 1, d > 0 and d < c)").select(*key), key, "left_semi")
    sized = rows.where("n > 0").groupBy("cls").agg(F.min("key").alias("key"), F.count("*").alias("held"))
    need = met.groupBy("cls").agg(F.collect_list(F.struct(*key, "right", "guest")).alias("cells")).join(sized, "cls")
    need = steps.keep(need)
    cells_sent = need.agg(F.sum(F.size("cells"))).first()[0] or 0  # rows of seven numbers
    texts = docs.select("key", "text")
    texts = texts.join(F.broadcast(need), "key") if cells_sent <= SENT else only(texts, need.select("key")).join(need, "key")
    columns = [*key, "right", "guest", "cls", "held"]
    schema = "cluster long, p long, i long, q long, j long, right boolean, guest boolean, cls long, held long, shingles binary"

    def sets(batches):
        """The whole set of each class, for each cell that it is in; a task sends a class once."""
        done: set[int] = set()
        for batch in batches:
            first = [k for k, c in enumerate(batch["cls"].to_pylist()) if not (c in done or done.add(c))]
            batch = batch.take(pa.array(first, pa.int64()))
            data, offs = buffers(batch["text"])
            for a, b in slabs(offs):
                row, g = shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n)
                at = np.searchsorted(row, np.arange(b - a + 1))
                part = batch.slice(a, b - a)
                lists = part["cells"]
                times = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                of = np.repeat(np.arange(b - a), times)
                for lo, hi in slabs(np.concatenate([[0], np.cumsum(8 * (at[of + 1] - at[of]))]), 8 << 20):  # a set goes along with each of its cells
                    k = of[lo:hi]
                    where = [flat.field(c).slice(lo, hi - lo) for c in (*key, "right", "guest")]
                    yield pa.RecordBatch.from_arrays([*where, part["cls"].take(pa.array(k)), part["held"].take(pa.array(k)), pa.array([g[at[x] : at[x + 1]].tobytes() for x in k], pa.binary())], names=[*columns, "shingles"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = texts.select("text", "cls", "held", "cells").mapInArrow(tidy(sets), schema).repartition(parts, *key).sortWithinPartitions(*key, "cls")

    def opened(batch) -> dict[str, np.ndarray]:
        return {c: batch[c].to_numpy(zero_copy_only=False) for c in (*columns, "shingles")}

    def degrees(t: dict[str, np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, rows of other classes that it is linked with, and least class that it hangs with, in one cell."""
        at = a + np.flatnonzero(np.concatenate([[True], t["cls"][a + 1 : b] != t["cls"][a : b - 1]]))  # several tasks may send a class
        m = len(at)
        sets = [np.frombuffer(x, U64) for x in t["shingles"][at]]
        size = np.array([len(x) for x in sets])
        cls, right, guest, weight = t["cls"][at], t["right"][at].astype(bool), t["guest"][at].astype(bool), t["held"][at]
        alone = t["p"][a] == t["q"][a] and t["i"][a] == t["j"][a]  # one block with itself
        x = np.arange(m) if alone else np.flatnonzero(~right)
        y = x if alone else np.flatnonzero(right)
        if not len(x) or not len(y):
            return cls[:0], weight[:0], cls[:0]
        values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), size)
        twice = np.cumsum(times > 1) - 1  # shingles of one class add nothing
        use = times[place] > 1
        place, row = twice[place[use]], row[use]
        by = np.argsort(place, kind="stable")
        place, row = place[by], row[by]
        common = np.zeros((len(x), len(y)))
        for lo in range(0, int((times > 1).sum()), COLUMNS):
            f, g = np.searchsorted(place, [lo, lo + COLUMNS])
            has = np.zeros((m, COLUMNS), np.float32)
            has[row[f:g], place[f:g] - lo] = 1
            common += has @ has.T if alone else has[x] @ has[y].T
        link = (100 * common >= percent * (size[x][:, None] + size[y][None, :] - common)) & ~(guest[x][:, None] & guest[y][None, :])
        links, label = np.zeros(m, np.int64), np.arange(m)
        if alone:
            np.fill_diagonal(link, False)
            links[x] = link @ weight
        else:
            links[x], links[y] = link @ weight[y], weight[x] @ link
        while True:  # the least place that links reach
            before = label.copy()
            label[x] = np.minimum(label[x], np.where(link, label[y][None, :], m).min(1))
            label[y] = np.minimum(label[y], np.where(link, label[x][:, None], m).min(0))
            if (label == before).all():
                break
        some = np.flatnonzero(links)
        return cls[some], links[some], cls[label[some]]

    def count(batches):
        for t, starts, ends in by_key(batches, opened, key):
            cls, links, root = (np.concatenate(c) for c in zip(*(degrees(t, a, b) for a, b in zip(starts, ends, strict=True)), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(links), pa.array(root)], names=["cls", "links", "root"])

    found = steps.keep(met.mapInArrow(tidy(count), "cls long, links long, root long"))
    steps.drop(whole, dealt, need)
    return found


def only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key a filter of all keys holds; 16 MB at most, a fuller one only lets more rows pass."""
    bits = bits_for(keys.count())
    shift = U64(64 - bits)

    def at(batch):
        return (batch["key"].to_numpy(zero_copy_only=False).view(U64) >> shift).astype(np.int64)[:, None]

    wanted = texts.sparkSession.sparkContext.broadcast(filters(keys, bits, at)[0])

    def pass_on(batches):
        for batch in batches:
            yield batch.filter(pa.array(holds(wanted.value, at(batch)[:, 0])))

    return texts.mapInArrow(tidy(pass_on), texts.schema)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Documents without near copies: of each component one row stays, texts without words all stay.

    It is the row of smallest doc_id (null ids last, then by a hash of the text); of rows that repeat both doc_id and text
    one stays. The columns of the input come back as they were.
    """
    steps = Steps(docs.sparkSession)
    rows, near, _ = linked(docs_of(docs, "doc_id", "text"), n, percent, steps)
    rows = rows.where("n > 0").withColumn("at", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    least = rows.groupBy("cls").agg(F.min("at").alias("at")).join(near.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = least.groupBy("component").agg(F.min("at").alias("first")).join(least.select("cls", "component"), "component").select("cls", "first")
    lost = steps.keep(rows.join(first, "cls").where("at <> first").select(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).distinct())
    again = steps.keep(rows.groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("__d"), F.col("key").alias("__k")))

    def named(df: DataFrame, some: DataFrame, how: str) -> DataFrame:
        same = df["doc_id"].cast("long").eqNullSafe(some["__d"]) & (F.xxhash64(df["text"].cast("string")) == some["__k"])
        return df.join(F.broadcast(some) if some.count() <= SENT else some, same, how)

    out = named(docs, lost, "left_anti")
    if again.isEmpty():
        return out
    turn = "__tabveil_copy"
    many = named(out, again, "left_semi").withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", F.xxhash64(F.col("text").cast("string"))).orderBy(F.lit(0))))
    return named(out, again, "left_anti").union(many.where(F.col(turn) == 1).drop(turn))
