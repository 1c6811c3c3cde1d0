"""Shared helpers: table access, scratch tables in the cluster's shared folder, text kernels."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch: texts are long, and both ends of a Python worker's pipe hold whole batches.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is unset, below the session's warehouse (shared as well)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written copy (cuts lineage, survives lost executors)."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables made by ``materialise`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tidemark/" in root:
                path = spark._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


# --- numpy text kernels ------------------------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_pow = _ipow = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = (n + (1 << 18) - 1) >> 18 << 18
        step = np.full(size, _MULT)
        step[0] = 1
        _pow = np.cumprod(step, dtype=np.uint64)
        step[1:] = _INV
        _ipow = np.cumprod(step, dtype=np.uint64)
    return _pow, _ipow


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over a uint64 array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and the words per text."""
    words, counts = zip(*[_word_hashes(texts[part]) for part in chunked(texts)] or [_word_hashes([])])
    return np.concatenate(words), np.concatenate(counts)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    inside = np.concatenate(([False], ~space, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    low = buf + np.where((buf >= 65) & (buf <= 90), np.uint8(32), np.uint8(0))
    pow_, ipow = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * pow_[: len(buf)], dtype=np.uint64)))
        words = mix((total[end] - total[start]) * ipow[start] + (end - start).astype(np.uint64) * _MULT)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    upto = np.searchsorted(start, ends)
    return words, np.diff(np.concatenate(([0], upto)))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles; fewer words make one, none make none."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    with np.errstate(over="ignore"):
        full = None
        if len(words) >= k:
            full = words[: len(words) - k + 1].copy()
            for j in range(1, k):
                full = mix(full) + words[j : len(words) - k + 1 + j] * np.uint64(2 * j + 1)
            full = mix(full)
        for n in counts:
            if n == 0:
                out.append(np.empty(0, np.int64))
            elif n < k:
                h = words[at]
                for j in range(1, n):
                    h = mix(np.array([h]))[0] + words[at + j] * np.uint64(2 * j + 1)
                out.append(mix(np.array([h ^ np.uint64(n)])).view(np.int64))
            else:
                out.append(np.unique(full[at : at + n - k + 1]).view(np.int64))
            at += n
    return [np.sort(x) for x in out]


#: Bytes of text that a hash kernel takes at once: it holds about a dozen arrays with 8 bytes a byte, and a worker keeps what
#: it once took from the system.
CHUNK = 1 << 18


def chunked(texts: list[bytes], limit: int = CHUNK):
    """Slices of a list of texts with about ``limit`` bytes each (one long text makes a slice of its own)."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def slices(batches, rows: int = 2000):
    """Arrow batches in pieces of so many rows, so that a task holds few texts at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null is the empty text."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
