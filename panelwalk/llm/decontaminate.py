"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words are lower-cased (A-Z). For an item of L words the windows are all runs of L words of a document, or the
whole of a shorter one. A window of similarity 0.8 has four fifths of an item's shingles of five words, so only
windows with that many shingles of the benchmark, whichever, get a 64-bit SimHash of their shingles, each with
its count as weight. The multi-index says which items such a window may be: fingerprints within RADIUS bits
agree up to RADIUS // BLOCKS bits in at least one of BLOCKS equal parts, so of each part's value the items with
a value that near are looked up, and their union holds every item within the radius. Candidates within the
radius are verified by the exact weighted similarity of the shingle counts, sum of minima over sum of maxima.

Shingles that differ in a share of 1/9 turn each SimHash bit with probability 0.15; RADIUS lies five deviations
beyond the mean of 9.7 bits, so a window of similarity 0.8 falls outside about once in a million.

The benchmark is a query set: it is read in blocks of BLOCK_ITEMS items, each of them sent to all tasks, and
documents are read once for each block.

Defined results: null and empty texts and items match nothing; a text or item of fewer than five words is
one shingle; rows that repeat are reported again, equal items each; of windows that are equally similar to an
item the first is reported; a null doc_id or item_id is kept; long texts are searched whole; empty tables give
no rows; extra columns are ignored by find() and kept by clean().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, Ranges, slices, utf8, word_bounds, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCKS = 8
BLOCK_ITEMS = 4096
FOUND = "doc_id long, item_id long, first_word long, n_words long, similarity double"

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def simhash(rows: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes, as eight bytes each."""
    bits = np.unpackbits(rows.view(np.uint8).reshape(*rows.shape, 8), axis=-1)
    return np.packbits(2 * bits.sum(1, dtype=np.int32) > rows.shape[1], axis=-1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[Ranges, np.ndarray]:
    starts, ends, at = word_bounds(data, offsets)
    return Ranges(word_hashes(LOWER[data], starts, ends)), at


class Index:
    """Items by length, the shingles of all of them, and the items near each value of each block."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        ranges, at = shingles(*utf8(pa.array(texts, pa.string())))
        self.ids, self.words = pa.array(ids, pa.int64()), np.diff(at)
        sizes = np.minimum(self.words, SHINGLE)
        grams = [ranges.of(np.arange(a, b - s + 1), np.full(b - a - s + 1, s)) if b > a else np.zeros(0, np.uint64) for a, b, s in zip(at.tolist(), at[1:].tolist(), sizes.tolist(), strict=False)]
        self.counts = [Counter(g.tolist()) for g in grams]
        self.prints = np.concatenate([simhash(g[None]) if len(g) else np.zeros((1, 8), np.uint8) for g in grams]) if ids else np.zeros((0, 8), np.uint8)
        #: Of each shingle size the sorted hashes; of each length the items.
        self.grams = {s: np.unique(np.concatenate([g for g, x in zip(grams, sizes, strict=True) if x == s])) for s in np.unique(sizes[sizes > 0]).tolist()}
        self.items = {n: np.flatnonzero(self.words == n) for n in np.unique(self.words[self.words > 0]).tolist()}
        # near[block, value, item]: the multi-index, from a block's value to the items within its share of the radius.
        self.near = _ONES[np.arange(256, dtype=np.uint8)[None, :, None] ^ self.prints.T[:, None, :]] <= RADIUS // BLOCKS

    def windows(self, ranges: Ranges, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of items and of windows: the length of the items, first words, and sizes of the windows
        that hold enough shingles of the benchmark, and their texts."""
        for s, known in self.grams.items():
            here = ranges.all_of(s)
            hit = known[np.minimum(np.searchsorted(known, here), len(known) - 1)] == here
            text = np.searchsorted(at, np.flatnonzero(hit), "right") - 1
            inside = np.flatnonzero(hit) + s <= at[text + 1]
            hit[np.flatnonzero(hit)[~inside]] = False
            held = np.bincount(text[inside], minlength=len(at) - 1)
            sums = np.cumsum(np.r_[0, hit])
            lengths = np.diff(at)
            for words in self.items:
                if min(words, SHINGLE) != s:
                    continue
                texts = np.flatnonzero((held >= least_common(words - s + 1)) & (lengths >= s))
                size = np.minimum(words, lengths[texts])
                starts = lengths[texts] - size + 1
                first = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(at[texts], starts)
                size, of = np.repeat(size, starts), np.repeat(texts, starts)
                enough = sums[first + size - s + 1] - sums[first] >= least_common(words - s + 1)
                yield words, first[enough], size[enough], of[enough]

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity) of the best window of each text and item."""
        ranges, at = shingles(data, offsets)
        best: dict[tuple[int, int], tuple] = {}
        for words, first, size, text in self.windows(ranges, at):
            s, items = min(words, SHINGLE), self.items[words]
            for n in np.unique(size).tolist():
                mine = np.flatnonzero(size == n)
                for part in np.array_split(mine, -(-len(mine) // 2048)):
                    rows = ranges.of((first[part, None] + np.arange(n - s + 1)).ravel(), np.full(len(part) * (n - s + 1), s)).reshape(len(part), -1)
                    prints = simhash(rows)
                    window, item = np.nonzero(self.near[np.arange(BLOCKS)[:, None, None], prints.T[:, :, None], items].any(0))
                    close = _ONES[prints[window] ^ self.prints[items[item]]].sum(1) <= RADIUS
                    for w, i in zip(window[close].tolist(), items[item[close]].tolist(), strict=True):
                        there, have = self.counts[i], Counter(rows[w].tolist())
                        common = (there & have).total()
                        alike = common / (there.total() + have.total() - common)
                        t = int(text[part[w]])
                        start = int(first[part[w]] - at[t])
                        if alike >= SIMILARITY and ((t, i) not in best or (-alike, start) < best[t, i][:2]):
                            best[t, i] = (-alike, start, n)
        return [(t, i, start, n, -alike) for (t, i), (alike, start, n) in sorted(best.items())]


def least_common(grams: int) -> int:
    """Shingles that a window must share with an item of so many to reach the similarity."""
    return int(np.ceil(SIMILARITY * grams - 1e-9))


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of bounded size."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = -(-items.count() // BLOCK_ITEMS)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        if rows:
            yield Index([r.item_id for r in rows], [r.text for r in rows])


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds, with its best window."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], FOUND)

    def search(shared) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches):
                found = index.matches(*utf8(batch.column(1)))
                text, item, start, n, alike = zip(*found, strict=True) if found else [()] * 5
                ids = index.ids.take(pa.array(item, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text, pa.int64())), ids, pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(alike, pa.float64())], [x.split()[0] for x in FOUND.split(", ")])

        return own.mapInArrow(work, FOUND)

    for index in indexes(benchmark):
        out = out.unionByName(search(spark.sparkContext.broadcast(index)))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    place = docs.columns.index("text")

    def keep(part: DataFrame, shared) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                stay = np.ones(batch.num_rows, bool)
                stay[[m[0] for m in shared.value.matches(*utf8(batch.column(place)))]] = False
                yield batch.filter(pa.array(stay))

        return part.mapInArrow(work, fields)

    for index in indexes(benchmark):
        docs = keep(docs, docs.sparkSession.sparkContext.broadcast(index))
    return docs
