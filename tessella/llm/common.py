"""What the operators of this subpackage share: column picking, written tables and byte-level word hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 21
ROW_OVERHEAD = 64
LONG_SPAN = 128
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_written: list[str] = []


@lru_cache(maxsize=1)
def _frugal() -> None:
    """Give freed memory back: workers live on between tasks, and arrays of a block would stay in the allocator. In workers only."""
    if TaskContext.get() is None:
        return
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc
        for option in (-1, -3):  # trim and mmap thresholds: fixed, as they would grow to 32 MB
            libc.mallopt(option, 1 << 20)
    pa.set_memory_pool(pa.system_memory_pool())


def _small_batches(spark: SparkSession) -> None:
    """Texts are long: at Spark's 10,000 rows or 64 MB an Arrow batch would take much memory. Settings that someone made stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under new names, whatever else the table holds.

    Columns are found by exact name and taken by position, so that extra columns whose names clash with
    these or with an operator's own (in whatever case) cannot make a reference ambiguous.
    """
    _small_batches(df.sparkSession)
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{names.index(old)}").alias(new) for new, old in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode one is made where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that written() made; call it when the results that read them are no longer needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        try:
            release(spark)
        except Exception:  # the JVM may have gone already
            _written.clear()


def broadcast_if_small(df: DataFrame, row_limit: int) -> DataFrame:
    """Broadcast hint if df has at most row_limit rows (it reads no more to know); else Spark's shuffled joins do the work."""
    return F.broadcast(df) if df.limit(row_limit + 1).count() <= row_limit else df


def broadcast_if_light(df: DataFrame, row_bytes: Column, limit: int) -> DataFrame:
    """Broadcast hint if the rows, at row_bytes each beside ROW_OVERHEAD, are at most limit bytes; else shuffled joins."""
    total = df.agg(F.sum(row_bytes.cast("long") + ROW_OVERHEAD)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


# ---- word hashing over UTF-8 bytes ------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: everything but space and \x09-\x0D; and letters, digits and all of non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        _pow, _inv = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        _pow[0] = _inv[0] = 1
        _pow, _inv = np.multiply.accumulate(_pow), np.multiply.accumulate(_inv)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """p with p[i] = sum of codes[j] * base^j for j < i; (p[e] - p[s]) * inverse^s hashes codes[s:e]."""
    up, _ = powers(len(codes) + 1)
    p = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(p))
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts, lengths) for runs of rows of about limit bytes; null counts as empty."""
    _frugal()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        base = offsets[first]
        yield first, data[base : offsets[last]], (offsets[first:last] - base), np.diff(offsets[first : last + 1])
        first = last


def word_spans(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, first word of each document with the total at the end); words end with their document."""
    inside = is_word[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside
    ends[1:n] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    return s, e, np.append(np.searchsorted(s, starts), len(s))


def word_hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word after lower-casing A-Z, first word of each document with the total at the end)."""
    s, e, first = word_spans(buf, starts, lens, is_word)
    low = LOWER[buf]
    return strong(low, s, e, span_hash(prefix_hash(BYTE_CODE[low]), s, e)), first


def strong(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of another kind for long spans: a polynomial modulo 2^64 is blind to some of them, whatever its base.

    Words of the Thue-Morse sequence and their complements are of that kind, from 1,024 letters on.
    """
    long = np.flatnonzero(ends - starts >= LONG_SPAN)
    if len(long):
        hashes[long] = [xxhash.xxh3_64_intdigest(values[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return hashes


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each document, and where each document's begin (with the total at the end).

    A document of fewer words, but not none, has one shingle of all of them if whole_if_short.
    """
    counts = np.diff(first)
    grams = np.maximum(counts - n + 1, 0)
    short = (counts < n) & (counts > 0) & whole_if_short
    grams = grams + short
    begin = np.append(0, np.cumsum(grams))
    doc = np.repeat(np.arange(len(counts)), grams)
    at = first[:-1][doc] + (np.arange(begin[-1]) - begin[:-1][doc])
    end = at + np.where(short[doc], counts[doc], n)
    return strong(words, at, end, span_hash(prefix_hash(words), at, end)), begin


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")
