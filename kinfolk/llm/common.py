"""What the text operators share: word rules, tables of a data folder, and vectorised byte hashing."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def without_spaces(text: Column) -> Column:
    return F.translate(text, SPACE_CHARS, "")


# ---------------------------------------------------------------- bytes of Arrow columns

_U = np.uint64
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
#: Tables of powers come in multiples of this, so that blocks of like size share one.
STEP = 1 << 20


def byte_values(seed: int) -> np.ndarray:
    """256 fixed random odd 64-bit values, one for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


@lru_cache(maxsize=1)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n (at least)."""
    return _powers(max(1, -(-n // STEP)) * STEP, base)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(32)
    return h


def prefix_hash(buf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """S[i]: polynomial hash of the first i bytes; that of bytes [a, b) is (S[b] - S[a]) * base**-a."""
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * powers(len(buf))[0][: len(buf)], out=s[1:])
    return s


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end and the n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def blocks(buf: np.ndarray, offs: np.ndarray, most: int = 1_000_000):
    """Runs of whole texts of about ``most`` bytes: (first, last, bytes, offsets). A longer text stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the texts in ``buf``, and the n + 1 word offsets of the texts."""
    inside = _IS_WORD[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(buf))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def stretches(col: pa.Array, most: int):
    """Parts of a string column of about ``most`` bytes, as (first, column without nulls) with 64-bit offsets.

    Rows are taken, not sliced: a cast of a slice keeps its first offset, which string functions then misread.
    """
    _, offs = text_bytes(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1))
        yield i, col.take(pa.array(range(i, j))).fill_null("").cast(pa.large_string())
        i = j


#: Spark's setting for the bytes of rows that go to a Python worker at once, and what ``small_batches`` sets it to.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on a Python worker gets at most some ``BATCH_BYTES`` of rows at once; a smaller setting stays.

    Spark's own limit is 64 MB, and an executor's allocator keeps most of what such batches took, outside its heap. Plans
    read the setting when they run, so it stays for the session. It changes no rows: a row above it is a batch of its own.
    """
    bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if bytes_of(spark.conf.get(BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library can
        pass
