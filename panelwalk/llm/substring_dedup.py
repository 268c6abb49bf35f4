"""Substring dedup: removes word windows that occur more than once, by De Bruijn compaction.

The graph's edges are all windows of WINDOW consecutive words. They are not shuffled one by one:

1. Each window belongs to the anchor of least hash among the runs of ANCHOR words in it (the leftmost if
   several are equal), which depends on its words alone. Edges in a row that share an anchor form a path.
   Only paths travel: anchor, hash of all their words, document, first word, number of edges.
2. Anchors that occur once hold no repeated edge, as no two edges of one path are equal; they go.
3. Paths of an anchor with one content are nonbranching: all their edges repeat as often as the path. Where
   contents differ, the path branches, and a join takes one copy of each content back to its source
   coordinates, where its edges are hashed from the words; edges that come up again, counted with the
   number of copies, are the repeated ones.
4. A join by anchor and content brings the repeated edges of each path to all its places; in each document
   they join into long spans, whose words are removed.

A place is known by (anchor, content) or (anchor, window), 128 bits of hash in all. Frequent passages
collapse to one row for each content before they meet; nothing gathers the places of one passage.

Defined results: a null text counts as empty: no words, digest of the empty text; a text of fewer than
WINDOW words loses nothing; rows that repeat count as different places; rows with equal doc_id and text get
equal results, rows with equal doc_id and other texts are told apart; a null doc_id is kept; an empty table
gives no rows; a text of any length is one row whose places are counted in longs within a task and in an int
in tables (2^31 words); of several equal anchors in a window the leftmost is taken, in every copy alike; extra
columns, whatever their names, are ignored by report() and kept by removed().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Ranges, identified, kept, settled, signed, slices, spare, utf8, word_bounds, word_hashes

WINDOW = 35
ANCHOR = 8
#: Edges that one anchor place can have; they fit the bits of a long.
REACH = WINDOW - ANCHOR + 1
_PLACE = np.uint64((1 << 24) - 1)
#: Edges whose anchors are found together; with REACH they are fewer than the places that _PLACE can tell.
BLOCK = 1 << 23
PATHS = "doc_id long, text_key long, anchor long, content long, span long"
EDGES = "anchor long, content long, copies long, whole boolean, nth int, edge long"


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` keys in a row from each place, by doubling."""
    have, out = 1, keys
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _leftmost(anchors: np.ndarray) -> np.ndarray:
    """For each edge the place of its anchor. A key holds the high bits of the hash and the place, counted anew
    every BLOCK places, so that texts of any length keep the order."""
    out = [np.zeros(0, np.int64)]
    for a in range(0, len(anchors) - REACH + 1, BLOCK):
        part = anchors[a : a + BLOCK + REACH - 1]
        least = _least(part & ~_PLACE | np.arange(len(part), dtype=np.uint64), REACH)
        out.append((least & _PLACE).astype(np.int64) + a)
    return np.concatenate(out)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = utf8(batch.column(2))
        starts, ends, at = word_bounds(data, offsets)
        if len(starts) < WINDOW:
            continue
        ranges = Ranges(word_hashes(data, starts, ends))
        anchors = ranges.all_of(ANCHOR)
        low_place = _leftmost(anchors)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(low_place)]
        edge = np.flatnonzero(np.arange(len(low_place)) + WINDOW <= at[text + 1])
        if not len(edge):
            continue
        low = low_place[edge]
        new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (np.diff(edge) > 1)])
        first, count = edge[new], np.diff(np.r_[new, len(edge)])
        which = text[first]
        doc = batch.column(0).take(pa.array(which))
        key = batch.column(1).take(pa.array(which))
        columns = [doc, key, pa.array(signed(anchors[low[new]])), pa.array(signed(ranges.of(first, count + WINDOW - 1))), pa.array((first - at[which]) * 32 + count)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "anchor", "content", "span"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = utf8(batch.column(0))
        starts, ends, at = word_bounds(data, offsets)
        ranges = Ranges(word_hashes(data, starts, ends))
        paths = batch.column(1).flatten()
        anchor, content, copies, whole, first, edges = (paths.field(i).to_numpy(zero_copy_only=False) for i in range(6))
        text = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
        begin = at[text] + first
        each = np.repeat(np.arange(len(edges)), edges)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(edges) - edges, edges)
        windows = ranges.of(begin[each] + nth, np.full(len(each), WINDOW))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[each], content[each], copies[each], whole[each], nth.astype(np.int32), signed(windows))], ["anchor", "content", "copies", "whole", "nth", "edge"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and spans: array of (first, mask), a bit for each repeated edge from `first` on.

    docs: doc_id, text_key, text. The spans are a step, so that paths and what they shuffle are gone when texts meet spans."""
    return settled(docs.sparkSession, lambda: _spans(docs), "spans")


def _spans(docs: DataFrame) -> DataFrame:
    paths = kept(docs.mapInArrow(_paths, PATHS).alias("p").join(
        docs.mapInArrow(_paths, PATHS).groupBy("anchor").count().where("count > 1").select("anchor"), "anchor", "left_semi"), "paths")
    # A span is the path's first word and its edges, of which there are REACH at most; one number travels lighter.
    paths = paths.select("doc_id", "text_key", "anchor", "content", F.expr("cast(shiftright(span, 5) AS int)").alias("first"), F.expr("cast(span & 31 AS int)").alias("edges"))
    contents = paths.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key", "first", "edges")).alias("at"))
    branching = contents.groupBy("anchor").agg((F.count("*") > 1).alias("branches"))
    contents = contents.join(branching, "anchor")
    every = F.lit((1 << REACH) - 1)
    apart = contents.where("branches").select("at.doc_id", "at.text_key", F.struct("anchor", "content", "copies", (F.col("copies") > 1).alias("whole"), "at.first", "at.edges").alias("path"))
    listed = apart.groupBy("doc_id", "text_key").agg(F.collect_list("path").alias("paths"))
    edges = _with_text(docs, listed, "inner").select("text", "paths").mapInArrow(_edges, EDGES)
    again = edges.groupBy("anchor", "edge").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "edge")
    partly = edges.where("not whole").join(again, ["anchor", "edge"]).groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, nth)")).alias("mask"))
    verdict = contents.where("copies > 1").select("anchor", "content", every.cast("long").alias("mask")).unionByName(partly)
    return paths.join(verdict, ["anchor", "content"]).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", F.col("mask").bitwiseAND(F.expr("shiftleft(1L, edges) - 1")).alias("mask"))).alias("spans"))


def _with_text(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """Joins by identity; a null doc_id is one too. The same two columns for every join of the texts."""
    left = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "text_key", "doc_id", "text")
    right = listed.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "text_key", *[c for c in listed.columns if c not in ("doc_id", "text_key")])
    return left.join(right, ["k", "text_key"], how)


def kept_words(text: str, spans: list | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the rest joined by blanks."""
    words = text.encode().split()
    if not spans:
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for first, mask in spans:
        for nth in range(mask.bit_length()):
            if mask >> nth & 1:
                change[first + nth] += 1
                change[first + nth + WINDOW] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    text, spans = batch.schema.get_field_index("text"), batch.schema.get_field_index("spans")
    for t, s in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True):
        yield kept_words(t, s and [(x["first"], x["mask"]) for x in s])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, gone, rest = zip(*_rows(batch), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in rest])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = identified(docs)
    return _with_text(own, repeated_spans(own), "left").select("doc_id", "text", "spans").mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def removed(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeated windows taken out of `text` and `n_chars` (where there is one) set
    anew. A text that loses nothing stays as it is; else its kept words are joined by blanks."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns
    place, sized = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    spans = repeated_spans(identified(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            for i, s in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if s:
                    texts[i] = kept_words(texts[i], [(x["first"], x["mask"]) for x in s])[2].decode()
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            if sized is not None:
                columns[sized] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    i, key, found = (spare(docs, x) for x in ("id", "key", "spans"))
    left = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), key: F.xxhash64("text")})
    right = spans.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(i), F.col("text_key").alias(key), F.col("spans").alias(found))
    return left.join(right, [i, key], "left").select(*[F.col(f"`{c}`") for c in names], found).mapInArrow(work, fields)
