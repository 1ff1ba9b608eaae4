"""Helpers of the corpus operators: stored steps, column names that cannot clash, and Arrow text as byte arrays."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurelens.session import fresh_folder

#: The white space that parts words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"
BLOCK_BYTES = 1 << 20
#: Rows of texts that a task hands to Python at a time. Spark's 10,000 are tens of MB, which both sides hold outside the heap.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the cluster's shared folder and read it back: later steps never compute it again, also not
    when executors are lost. The folder belongs to the cluster, which clears it."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def limit_batches(spark: SparkSession) -> None:
    """From now on the session hands at most ``BATCH_ROWS`` rows to Python at a time; a smaller limit that is set stays."""
    if not 0 < int(spark.conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """``limit_batches`` for steps that are stored inside; then the session has its own limit again."""
    own = spark.conf.get(_BATCH_KEY)
    limit_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, own)


def named(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_columns(df: DataFrame, taken: tuple[str, ...]) -> list[str]:
    """Columns of the input that an operator can hand on: all but those whose names its own columns take."""
    own = {name.lower() for name in taken}
    return [name for name in df.columns if name.lower() not in own]


def token(df: DataFrame, text: str = "text") -> Column:
    """Words parted by white space, as an array; none for null. A text of white space alone has none."""
    stripped = F.regexp_replace(F.coalesce(named(text), F.lit("")), f"^{SPACES}|{SPACES}$", "")
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, SPACES))


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text or binary column into runs of rows ``(first, end, bytes, offsets)`` of about ``block_bytes`` each; one
    longer row is a block of its own. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.large_string()).cast(wide) if pa.types.is_string(column.type) else column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first]: offsets[end]], offsets[first: end + 1] - offsets[first]
        first = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random 64-bit value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64; the powers of the longest block so far are kept."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK_BYTES), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 4 * BLOCK_BYTES:
            _POWERS[int(base)] = known
    return known[:n]


class Rolling:
    """Polynomial hashes of any substrings of one byte array: ``of(starts, ends)``."""

    def __init__(self, data: np.ndarray) -> None:
        terms = BYTE_VALUES[data] * powers(_BASE, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.back = powers(_BASE_INVERSE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes with ``in_word[byte]``) that never cross rows, and the row's first word:
    the words of row ``i`` are ``bounds[i]:bounds[i + 1]``."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = in_word[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | fresh))
    ends = np.flatnonzero(before & (~inside | fresh))
    return starts, ends, np.searchsorted(starts, offsets)
