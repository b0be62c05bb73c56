"""Bounded bit filters, packed arrays and small helpers for multi-stage jobs."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from functools import lru_cache
from inspect import isgeneratorfunction, signature

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import zstandard
except ImportError:  # an optional codec; zlib does the same job
    zstandard = None

BATCH_ROWS = 2000  # of an Arrow batch: texts may be long
SLICE = 1 << 20  # bits of a filter that are merged together


def pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw) if zstandard else zlib.compress(raw, 1)


def unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob) if zstandard else zlib.decompress(blob)


def pack_planes(x: np.ndarray) -> bytes:
    """Pack integers plane by plane, so that bytes which seldom vary cost almost nothing."""
    return pack(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())


def unpack_planes(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(unpack(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all machines of a cluster share; it goes when the driver ends.

    Without that setting a local session (one machine) gets a folder of its own, a cluster an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        root = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    made = f"{root.rstrip('/')}/tabveil-{uuid.uuid4().hex}"
    files, path = folder(spark, made)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return made


def folder(spark: SparkSession, name: str):
    """The file system of a folder, and its path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class Steps:
    """Tables written between the stages of one operator; each is read back with its lineage cut."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n, self.paths = spark, scratch(spark), 0, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Delete kept tables that nothing reads any more."""
        for df in kept:
            files, path = folder(self.spark, self.paths.pop(id(df))[1])
            files.delete(path, True)


def bits_for(n: int, least: int = 20, most: int = 27) -> int:
    """Log2 of a filter's size: about 16 bits a key, but never over 2**most bits (16 MB)."""
    return min(most, max(least, int(max(n, 1) * 16 - 1).bit_length()))


def filters(df: DataFrame, bits: int, positions) -> tuple[np.ndarray, np.ndarray]:
    """Bit arrays of what was seen once or more, and twice or more, over all partitions.

    positions(batch) gives, for each key of an Arrow batch, the rows of a matrix of bit positions.
    The result has 2**bits bits at most, whatever the input; executors merge it slice by slice.
    """
    size, width = 1 << bits, min(SLICE, 1 << bits)

    def part(batches):
        once, twice = np.zeros(size, bool), np.zeros(size, bool)
        for batch in batches:
            rows = positions(batch)
            for column in rows.T if rows.size else ():
                values, counts = np.unique(column, return_counts=True)
                twice[values[once[values] | (counts > 1)]] = True
                once[values] = True
        for k in range(size // width):
            o, t = once[k * width : (k + 1) * width], twice[k * width : (k + 1) * width]
            if o.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "once": [pack(np.packbits(o).tobytes())], "twice": [pack(np.packbits(t).tobytes())]})

    def merge(table):
        once, twice = np.zeros(width // 8, np.uint8), np.zeros(width // 8, np.uint8)
        for o, t in zip(table["once"], table["twice"], strict=True):
            o, t = (np.frombuffer(unpack(x.as_py()), np.uint8) for x in (o, t))
            twice |= t | (once & o)
            once |= o
        return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "once": [pack(once.tobytes())], "twice": [pack(twice.tobytes())]})

    schema = "slice int, once binary, twice binary"
    merged = df.mapInArrow(tidy(part), schema).groupBy("slice").applyInArrow(tidy(merge), schema)
    out = [np.zeros(size // 8, np.uint8) for _ in range(2)]
    for row in merged.toLocalIterator():
        for a, blob in zip(out, (row["once"], row["twice"]), strict=True):
            a[row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] = np.frombuffer(unpack(bytes(blob)), np.uint8)
    return out[0], out[1]


def holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each bit position is set."""
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


@lru_cache
def libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def release() -> None:
    """Give memory that was freed back to the system: Python workers live on between tasks, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    if libc() is not None:
        libc().malloc_trim(0)


def tidy(f):
    """A task's function that leaves no freed memory behind in its worker."""
    if isgeneratorfunction(f):

        def batches_of(batches):
            try:
                yield from f(batches)
            finally:
                release()

        return batches_of

    def one(a):
        try:
            return f(a)
        finally:
            release()

    def two(a, b):
        try:
            return f(a, b)
        finally:
            release()

    def three(a, b, c):
        try:
            return f(a, b, c)
        finally:
            release()

    return (one, two, three)[len(signature(f).parameters) - 1]


def docs_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator needs, in fixed types; whatever else a table has is left out.

    The session's Arrow batches are held to BATCH_ROWS rows, so that those of long texts fit in a worker.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(rows)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(rows, str(BATCH_ROWS))
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string"}
    return docs.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in names))
