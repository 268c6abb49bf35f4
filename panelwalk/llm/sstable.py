"""Token-ID output as sorted-string-table shards.

A shard holds documents by ascending identifier in compressed blocks; within a block a key is stored
as the length it shares with the key before it and the rest. After the blocks come a sparse index (first
and last key, place and length of each block), a Bloom filter over all keys and a footer of fixed length.
get() asks the filter, then finds the block by binary search.

Key: eight bytes, big-endian, sign bit turned, so that bytes sort as numbers; null is the empty key and
sorts first. Value: place of the document's first id within the shard, then the ids, of two bytes each
where the vocabulary allows, else of four.

Defined results: a null or empty text is written as the end id alone; rows that repeat are all written, in
order of their texts, equal ones in any; a long text is one value, whatever its length; columns besides doc_id and
text are not looked at; an empty table writes no shard and gives no row.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .text import kept, shared_folder, slices, utf8

MAGIC = b"PWSST001"
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 16 << 20  # of raw values; the shard is smaller
BLOOM_BITS = 10  # for each key
BLOOM_HASHES = 7
FOOTER = struct.Struct("<QQQQQQB8s")  # index, its length, filter, its length, documents, ids, bytes of an id, magic
WROTE = "shard string, part int, number int, n_docs long, n_ids long, n_bytes long"
READ = "shard string, doc_id long, place long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Builds one shard; keys come in ascending order."""

    def __init__(self, width: int):
        self.width, self.body, self.block, self.index, self.keys = width, bytearray(), bytearray(), [], []
        self.first = self.last = None
        self.n_ids = self.raw = 0
        self.press = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(self.last, key, strict=False)) if x != y), min(len(self.last), len(key)))
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += struct.pack("<BBQI", shared, len(key) - shared, self.n_ids, len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids)
        self.raw += len(value)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.first is not None:
            packed = self.press.compress(bytes(self.block))
            self.index.append((self.first, self.last, len(self.body), len(packed)))
            self.body += packed
            self.block, self.first = bytearray(), None

    def close(self) -> bytes:
        self.flush()
        index = b"".join(struct.pack("<BB", len(a), len(b)) + a + b + struct.pack("<QI", at, n) for a, b, at, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        bloom[[p for k in self.keys for p in _bloom_places(k, bits)]] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        at = len(self.body)
        return bytes(self.body) + index + packed + FOOTER.pack(at, len(index), at + len(index), len(packed), len(self.keys), self.n_ids, self.width, MAGIC)


class Shard:
    """A shard that is read by ranges: footer, index and filter at first, then a block where one is asked for.
    get(doc_id) looks one up, items() gives all. read(place, n) gives n bytes of the shard."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        at, length, bloom, bloom_length, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw = read(bloom, bloom_length)
        self.bits, self.bloom = struct.unpack_from("<Q", raw)[0], raw[8:]
        raw, at, self.index = read(at, length), 0, []
        while at < length:
            a, b = raw[at], raw[at + 1]
            first, last = raw[at + 2 : at + 2 + a], raw[at + 2 + a : at + 2 + a + b]
            self.index.append((first, last, *struct.unpack_from("<QI", raw, at + 2 + a + b)))
            at += 14 + a + b
        self.lasts = [x[1] for x in self.index]

    @classmethod
    def of(cls, raw: bytes) -> Shard:
        """A shard whose bytes are at hand."""
        return cls(lambda at, n: raw[at : at + n], len(raw))

    @classmethod
    def opened(cls, uri: str) -> Shard:
        """A shard in a file: each read is a ranged one."""
        store, path = _store(uri)
        file = store.open_input_file(path)

        def read(at: int, n: int) -> bytes:
            file.seek(at)
            return file.read(n)

        return cls(read, file.size())

    def block(self, number: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        _, _, at, size = self.index[number]
        data = zstandard.ZstdDecompressor().decompress(self.read(at, size))
        at, key = 0, b""
        while at < len(data):
            shared, rest, place, size = struct.unpack_from("<BBQI", data, at)
            at += 14
            key = key[:shared] + data[at : at + rest]
            yield key, place, np.frombuffer(data, f"<u{self.width}", size // self.width, at + rest)
            at += rest + size

    def items(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for number in range(len(self.index)):
            for key, place, ids in self.block(number):
                yield id_of(key), place, ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents of that identifier."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] & 0x80 >> (p & 7) for p in _bloom_places(key, self.bits)):
            return []
        out, number = [], bisect.bisect_left(self.lasts, key)
        while number < len(self.index) and self.index[number][0] <= key:
            out += [ids for k, _, ids in self.block(number) if k == key]
            number += 1
        return out


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI. Where Spark knows a store by another scheme than Arrow (s3a, abfss through
    Hadoop), Arrow's name for it is used."""
    uri = "s3" + uri[3:] if uri.startswith(("s3a:", "s3n:")) else uri
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = 2) -> DataFrame:
    """Writes shards into `folder`, which all executors share; returns one row for each, part and number being the
    order of their documents. A task that is run again writes the same files under the same names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        encoder = bpe.encoder(tokenizer, bpe.merge_in_step)
        width = 2 if max(len(encoder.v.strings), end + 1) <= 1 << 16 else 4
        part, number, out, writer = TaskContext.get().partitionId(), 0, [], Writer(width)

        def close() -> None:
            nonlocal number, writer
            name, raw = f"part-{part:06d}-{number:06d}.sst", writer.close()
            own = f"{path}/_{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(raw)
            store.move(own, f"{path}/{name}")
            out.append((name, part, number, len(writer.keys), writer.n_ids, len(raw)))
            number, writer = number + 1, Writer(width)

        for batch in slices(batches):
            ids, stops = encoder.encode(*utf8(batch.column(1)))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), stops.tolist(), stops[1:].tolist(), strict=False):
                writer.add(key_of(doc_id), np.append(ids[a:b], end))
                if writer.raw >= SHARD_BYTES:
                    close()
        if writer.keys:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in WROTE.split(", ")])

    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows of one doc_id can go to several tasks by the beginning of their texts, in the order of the texts.
    ordered = ordered.repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    return kept(ordered.mapInArrow(work, WROTE), "wrote")


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    # Ids before each task's shards by a sum over one row a task, then within the task.
    tasks = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("skip", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    before = shards.withColumn("within", within).join(tasks, "part").select("shard", (F.col("skip") + F.col("within")).alias("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = [(i, place, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, place, ids in Shard.of(raw.as_py()).items()]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], [x.split()[0] for x in READ.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.sst").load(folder)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").mapInArrow(work, READ)
    return found.join(before, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    return read(spark, folder, write(docs, tokenizer, folder, end))
