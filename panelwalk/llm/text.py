"""Shared helpers: UTF-8 batches as numpy arrays, word hashes, tables kept between steps.

Words are maximal runs of characters other than U+0020 and U+0009..U+000D. In UTF-8 those
separators are single bytes which never occur inside another character, so words are cut on bytes.
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text handled at once inside a task; a longer text is handled alone.
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Upper-case A-Z to lower case, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


#: Longest word, in bytes, whose hash is mixed eight bytes at a time together with others; a longer one gets BLAKE2b.
SHORT_WORD = 64
#: Ranges of words are sums modulo this prime.
PRIME = np.uint64((1 << 61) - 1)
_WORD_BASE = 0x14C9F0E2B6D7A853 % int(PRIME)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public murmur3 constants): every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that no piece has more than `most` bytes of text, single rows aside."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n + 1 word offsets of the documents."""
    inside = ~SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends[lasts] = inside[lasts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each word. Eight bytes of all words are mixed into their hashes at once, each
    time after the hash so far was mixed, so that no sum of bytes and places can cancel out."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    eight = eights(data)
    short = lengths <= SHORT_WORD
    todo = np.flatnonzero(short & (lengths > 0))
    done = 0
    while len(todo):
        left = lengths[todo] - done
        spare = (8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8)
        block = eight[starts[todo] + done] << spare
        out[todo] = mix((out[todo] ^ block) * np.uint64(0x9FB21C651E98DF25))
        todo, done = todo[left > 8], done + 8
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def eights(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))


def same_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, others: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
    """Whether data[start : start + size] and other[its start : its start + size] are equal, for many ranges.
    there: eights(other), if that is at hand."""
    out = np.ones(len(starts), bool)
    here, there = eights(data), eights(other) if there is None else there
    todo, done = np.flatnonzero(sizes <= SHORT_WORD), 0
    todo = todo[sizes[todo] > 0]
    while len(todo):
        left = sizes[todo] - done
        spare = (8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8)
        out[todo] &= here[starts[todo] + done] << spare == there[others[todo] + done] << spare
        todo, done = todo[(left > 8) & out[todo]], done + 8
    for i in np.flatnonzero(sizes > SHORT_WORD).tolist():
        out[i] = np.array_equal(data[starts[i] : starts[i] + sizes[i]], other[others[i] : others[i] + sizes[i]])
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, of numbers below it."""
    low31, low30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low31, b >> np.uint64(31), b & low31
    middle = a0 * b1 + a1 * b0
    raw = a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & low30) << np.uint64(31)) + a0 * b0
    return _reduced(raw)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(61)) + (x & PRIME)
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), doubled in each step."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = times(out[:more], np.uint64(pow(base, have, int(PRIME))))
        have += more
    return out[:n]


@functools.lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_WORD_BASE, n), _powers(pow(_WORD_BASE, -1, int(PRIME)), n)


class Ranges:
    """Hashes of ranges of words from prefix sums modulo 2^61 - 1: equal word sequences, equal hashes. A word counts
    as its hash modulo the prime, times a power of a base by place: a polynomial, so that two different sequences
    of n words agree for n bases of 2^61 at most."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        powers, undo = _tables(1 << max(16, int(n).bit_length()))
        terms = times(_reduced(hashes), powers[:n])
        # Halves are summed apart, as sums of whole terms would pass 64 bits.
        self.sums = np.zeros(n + 1, np.uint64)
        low, high = np.cumsum(terms & np.uint64(0xFFFFFFFF)), np.cumsum(terms >> np.uint64(32))
        self.sums[1:] = _reduced(_reduced(low) + times(_reduced(high), np.uint64(1 << 32)))
        self.undo = undo

    def of(self, start: np.ndarray, length) -> np.ndarray:
        raw = times(_reduced(self.sums[start + length] + PRIME - self.sums[start]), self.undo[start])
        return mix(raw + np.asarray(length).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def all_of(self, length: int) -> np.ndarray:
        """The hash of `length` words from each start; the last starts come without one."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = times(_reduced(self.sums[length:] + PRIME - self.sums[:n]), self.undo[:n])
        return mix(raw + np.uint64(length * 0x2545F4914F6CDD1D % (1 << 64)))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder in the warehouse only where that is unset and Spark runs in one process."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_steps"


#: Steps that this process has written.
_STEPS: list[str] = []
#: Those of them that were written since passing() began.
_PASSING: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)
#: Whether Spark removes the shuffle files of a query as soon as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def drop_steps(spark: SparkSession, steps: list[str] | None = None) -> None:
    """Removes the steps that this process has written, or those that are given. Results that read them have to be written by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for step in list(_STEPS if steps is None else steps):
        path = jvm.org.apache.hadoop.fs.Path(step)
        path.getFileSystem(conf).delete(path, True)
        if step in _STEPS:
            _STEPS.remove(step)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the steps that are written inside when it ends, but for those taken out of the list: nothing may read them later."""
    mine: list[str] = []
    token = _PASSING.set(mine)
    try:
        yield mine
    finally:
        _PASSING.reset(token)
    drop_steps(spark, mine)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that make() gives as a step; the steps on the way to it are removed."""
    with passing(spark) as mine:
        out = kept(make(), name)
        last = mine.pop()
    if (outer := _PASSING.get()) is not None:
        outer.append(last)
    return out


def kept(df: DataFrame, name: str, options: dict | None = None, by: str | None = None) -> DataFrame:
    """Writes a step as a table in the shared folder, in folders by the last column if that is named, and reads it
    back: lineage ends there. What the step has shuffled goes at once, as nothing else reads it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STEPS.append(path)
    if (mine := _PASSING.get()) is not None:
        mine.append(path)
    writer = df.write.options(**({"compression": "zstd"} | (options or {})))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def without(df: DataFrame, name: str) -> DataFrame:
    """The table without the columns of that name, in any case of its letters."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text. Rows that repeat have the same key, and the same result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
