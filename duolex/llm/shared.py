"""What the operators of this subpackage share: written tables, word tables in numpy, input checks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = (9, 10, 11, 12, 13, 32)
#: One word of `[^\x20\x09-\x0D]+`, as Spark's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- written tables
def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset, a single machine (tests) gets one of its own; executors elsewhere
    couldn't see it, so a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_duolex_dir", None) or tempfile.mkdtemp(prefix="duolex-")
        spark._duolex_dir = base
    path = f"{base.rstrip('/')}/duolex-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


class Tables:
    """Written tables of one call. Writing cuts the lineage, so a lost executor costs one stage at most."""

    def __init__(self, spark: SparkSession):
        self.spark, self.dir, self.n = spark, shared_dir(spark), 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.dir}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._duolex_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more, and lets Spark clean the shuffle files behind them."""
        for t in tables:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(t._duolex_path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.sweep()

    def clear(self) -> None:
        """Deletes all tables, once nothing reads them any more."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.dir)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.sweep()

    def sweep(self) -> None:
        """Shuffle files stay until the driver collects its garbage; this asks for it between stages."""
        gc.collect()
        self.spark._jvm.System.gc()


def lean(run):
    """The same function of Arrow batches, whose worker gives freed memory back to the system at the end of its task. Workers are used
    again and again, and what one stage had needed would count against the next."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# ---------------------------------------------------------------- words in numpy
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [(1 << 64) - 1], dtype=np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)


def byte_class(separators, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """What each byte becomes, and whether the byte it becomes ends a word."""
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[65:91] += 32
    gap = np.zeros(256, dtype=bool)
    gap[list(separators)] = True
    return to, gap[to]


PLAIN = byte_class(SPACES, lower=False)
LOWER = byte_class(SPACES, lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S32)
    h = h * _C1
    h = h ^ (h >> _S29)
    h = h * _C2
    return h ^ (h >> _S32)


class Words:
    """The words of a block of texts: byte ranges in `data` and, from `row[i]` to `row[i + 1]`, those of text i."""

    def __init__(self, texts: pa.Array, classes=PLAIN):
        at = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)
        at = at[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        to, gap = classes
        self.data = np.zeros(len(raw) + 8, np.uint8)
        np.take(to, raw, out=self.data[: len(raw)], mode="clip")
        self.at = at
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~gap[raw]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        edge = at[:-1][at[:-1] < len(raw)]
        first[edge] = inside[1:-1][edge]
        edge = at[1:][at[1:] > 0] - 1
        last[edge] = inside[1:-1][edge]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.start, at)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, from its bytes eight at a time."""
        lanes = np.ndarray((max(len(self.data) - 7, 0),), "<u8", self.data, 0, (1,))
        size = self.end - self.start
        h = size.astype(np.uint64) * _C2
        if not len(h):
            return h
        h = mix(h ^ (lanes[self.start] & _MASK[np.minimum(size, 8)]))
        left = np.flatnonzero(size > 8)
        k = 8
        while len(left):
            part = lanes[self.start[left] + k] & _MASK[np.minimum(size[left] - k, 8)]
            h[left] = mix(h[left] * _C1 ^ part)
            k += 8
            left = left[size[left] > k]
        return h

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by single spaces."""
        d, s, e = self.data, self.start, self.end
        return b" ".join(d[s[k] : e[k]].tobytes() for k in range(i, j))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """For each position the hash of the n hashes from there on (shorter by n - 1); by doubling."""
    if len(h) < n:
        return h[:0]
    power = lambda e: np.uint64(pow(int(_C1), e, 1 << 64))
    out, have, block, size = None, 0, h, 1
    k = n
    while k:
        if k & 1:
            out = block if out is None else out[: len(block) - have] * power(size) + block[have:] if len(block) > have else h[:0]
            have += size
        k >>= 1
        if k:
            block = block[: len(block) - size] * power(size) + block[size:]
            size *= 2
    return mix(out[: len(h) - n + 1])


def blocks(batch: pa.RecordBatch, column: int, most: int = 4_000_000, empty: str | bytes = ""):
    """Pieces of a batch whose texts have up to `most` bytes, one row at least; nulls as `empty`."""
    texts = batch.column(column)
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        piece = batch.slice(i, j - i)
        yield piece, piece.column(column).fill_null(empty)
        i = j
