"""Toxicity: a character n-gram linear classifier with naive Bayes features.

A text's features are the n-grams of its characters (code points, A-Z lower-cased) that occur in it, each
weighted with its log-count ratio between toxic and other labelled texts; a logistic regression on them gives
the score. Of all n-grams, hashed to BUCKETS, the FEATURES with the largest ratios by support are kept.

All labelled documents of the training part are learnt; scoring covers all rows and whole texts. Tasks make
the features and keep the chosen columns as bits; the fit passes over these, and the driver gets a count of each
bucket by class and, in each pass, a loss and its slope from each task. Texts are worked on in pieces of PIECE
bytes that overlap by the longest n-gram, so a very long text takes little more memory than a short one.

Defined results: a null or empty text gets the score of no feature; rows that repeat get equal scores; of
n-grams with equal support the least bucket is kept; without labels of both classes every score is 0.5; labels
of unknown documents and null labels are ignored; rows that repeat with equal doc_id and text are learnt
once, several texts under one doc_id each; an empty table gives no rows; other columns are kept by
score() under their names, but one that has the name asked for the score is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, kept, mix, passing, slices, utf8, without

SIZES = (4, 5, 6, 7)
BUCKETS = 1 << 20
FEATURES = 2048
#: Labelled documents whose bits are put together at once, and those of them whose columns are multiplied at once.
SAMPLE, AT_ONCE = 6000, 512
#: Passes of the fit at most, the steps before that it goes by, and the slope at which it ends.
PASSES, MEMORY, FLAT = 80, 10, 1e-5
PENALTY = 0.002
#: Bytes of text handled at once: sorting all its n-grams takes many times as much.
PIECE = 1 << 18
THRESHOLD = 0.5


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """All rows (doc_id, label, text) of the training part, one for each doc_id and text. They are kept in the shared
    folder and stay off the driver."""
    learnt = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = labels.where(F.col(label).isin(0, 1) & learnt).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    texts = docs.where(learnt).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(known.hint("shuffle_hash"), "doc_id").groupBy("doc_id", F.xxhash64("text").alias("key")).agg(F.min("label").alias("label"), F.min("text").alias("text"))
    return kept(rows.select("doc_id", "label", "text"), "labelled")


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order. Sorting takes a small part of the time of np.unique, which hashes integers."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def least(slope: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray) -> np.ndarray:
    """Where a smooth convex function is least, by limited-memory BFGS. slope: its value and gradient, a pass each."""
    value, gradient = slope(at)
    moves, passes, noise = [], 1, 1e-7  # products are in single precision
    while passes < PASSES and np.abs(gradient).max() > FLAT:
        way, used = -gradient, []
        for move, change in reversed(moves):
            used.append(move @ way / (move @ change))
            way = way - used[-1] * change
        way = way * (moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.linalg.norm(gradient)))
        for (move, change), share in zip(moves, reversed(used), strict=True):
            way = way + (share - change @ way / (move @ change)) * move
        length, fall = 1.0, gradient @ way
        while True:
            new_value, new_gradient = slope(at + length * way)
            passes += 1
            if new_value <= value + 1e-4 * length * fall + noise * abs(value) or passes >= PASSES:
                break
            length /= 2
        if new_value > value + noise * abs(value):
            break
        move, change = length * way, new_gradient - gradient
        if move @ change > 0:
            moves = [*moves, (move, change)][-MEMORY:]
        at, value, gradient = at + move, new_value, new_gradient
    return at


def fit_logistic(rows: DataFrame, n: int, scale: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on all n rows (label, held), whose columns are bits times scale. Each pass is
    a job whose tasks sum loss and slope over their rows."""
    width = len(scale)

    def slope(at: np.ndarray) -> tuple[float, np.ndarray]:
        w, bias = (at[:-1] * scale).astype(np.float32), at[-1]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, sums = 0.0, np.zeros(width + 1)
            for batch in batches:
                for start in range(0, batch.num_rows, SAMPLE):
                    part = batch.slice(start, SAMPLE)
                    bits = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    labels = part.column(0).to_numpy()
                    for a in range(0, len(bits), AT_ONCE):
                        x, y = np.unpackbits(bits[a : a + AT_ONCE], axis=1, count=width).astype(np.float32), labels[a : a + AT_ONCE]
                        z = (x @ w).astype(float) + bias
                        loss += float(np.logaddexp(0, np.where(y == 1, -z, z)).sum())
                        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
                        sums[:-1] += error.astype(np.float32) @ x
                        sums[-1] += error.sum()
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([sums.tobytes()], pa.binary())], ["loss", "sums"])

        got = rows.select("label", "held").mapInArrow(work, "loss double, sums binary").toArrow()
        gradient = sum(np.frombuffer(x) for x in got["sums"].to_pylist()) / n
        gradient[:-1] = gradient[:-1] * scale + penalty * at[:-1]
        return sum(got["loss"].to_pylist()) / n + penalty / 2 * float(at[:-1] @ at[:-1]), gradient

    at = least(slope, np.zeros(width + 1))
    return at[:-1], float(at[-1])


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and bucket of all n-grams, a piece of the bytes and a size at a time."""
    low, longest = LOWER[data], max(SIZES)

    def boundary(at: int) -> int:
        """The first place from `at` on where a character begins, or the end."""
        while at < len(low) and low[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(low))

    for start in range(0, len(low), PIECE):
        a, b = boundary(start), boundary(start + PIECE)
        part = low[a : boundary(b + 4 * longest)]
        codes = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        places = np.flatnonzero(part & 0xC0 != 0x80)
        text = (np.searchsorted(offsets, a + places, "right") - 1).astype(np.int32)
        own = int(np.searchsorted(places, b - a))
        h, n = np.zeros(len(codes), np.uint64), 0
        for size in sorted(SIZES):
            while n < size:
                h = h[: max(0, len(codes) - n)] * np.uint64(0xD1342543DE82EF95) + codes[n:] * np.uint64(0x9E3779B97F4A7C15)
                n += 1
            first = h[:own]
            within = text[: len(first)] == text[size - 1 :][: len(first)] if len(first) else np.zeros(0, bool)
            yield text[: len(first)][within], (mix(first[within]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """text number * BUCKETS + bucket of the n-grams of all texts, each once and in order; of the buckets in
    `use` only, where it is given."""
    found, size = [np.zeros(0, np.int64)], 0
    for text, bucket in _pieces(data, offsets):
        if use is not None:
            hit = use[bucket]
            text, bucket = text[hit], bucket[hit]
        found.append(distinct(text.astype(np.int64) * BUCKETS + bucket))
        size += len(found[-1])
        if size > 4 * BUCKETS:
            found = [distinct(np.concatenate(found))]
            size = 0
    return distinct(np.concatenate(found))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class hold each bucket."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in slices(batches, most=PIECE):
        pairs = features(*utf8(batch.column(2)))
        toxic = batch.column(1).to_numpy()[pairs // BUCKETS]
        for label in (0, 1):
            counts[label] += np.bincount(pairs[toxic == label] % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[1, used]), pa.array(counts[0, used])], ["bucket", "toxic", "other"])


def _chosen_columns(rows: DataFrame, column: np.ndarray) -> DataFrame:
    """doc_id, label and a bit for each chosen bucket: of fixed size whatever the text."""
    shared, width = rows.sparkSession.sparkContext.broadcast(column.astype(np.int32)), int(column.max()) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PIECE):
            pairs = features(*utf8(batch.column(2)), shared.value >= 0)
            held = np.zeros((batch.num_rows, width), bool)
            held[pairs // BUCKETS, shared.value[pairs % BUCKETS]] = True
            bits = [r.tobytes() for r in np.packbits(held, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["doc_id", "label", "held"])

    return rows.mapInArrow(work, "doc_id long, label int, held binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[np.ndarray, float]:
    """A weight for each bucket, and the bias."""
    with passing(docs.sparkSession):
        return _fit(docs, labels, label)


def _fit(docs: DataFrame, labels: DataFrame, label: str) -> tuple[np.ndarray, float]:
    rows = labelled(docs, labels, label)
    toxic, other = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    weights = np.zeros(BUCKETS, np.float32)
    if not toxic or not other:
        return weights, 0.0
    found = rows.mapInArrow(_bucket_counts, "bucket int, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = found.toArrow()  # at most a row for each bucket
    bucket = counts["bucket"].to_numpy()
    order = np.argsort(bucket)
    bucket = bucket[order]
    p, q = (counts["toxic"].to_numpy()[order] + 0.5) / (toxic + 1), (counts["other"].to_numpy()[order] + 0.5) / (other + 1)
    ratio = np.log(p / q)
    # Large ratios on few texts are chance: a signed root of the divergence between both shares.
    support = np.abs(p - q) * np.abs(ratio)
    best = np.argsort(-support, kind="stable")[:FEATURES]
    chosen, ratio = bucket[best], ratio[best]
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    w, bias = fit_logistic(kept(_chosen_columns(rows, column), "columns"), toxic + other, ratio)
    weights[chosen] = w * ratio
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """The rows of docs with a score between 0 and 1."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size
    docs = without(docs, column)
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        use = w != 0
        for batch in slices(batches, "text"):
            pairs = features(*utf8(batch.column(place)), use)
            sums = np.bincount(pairs // BUCKETS, w[pairs % BUCKETS], batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-sums)))], [*batch.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, `{column}` double")
