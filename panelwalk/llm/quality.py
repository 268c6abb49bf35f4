"""Quality: Bradley-Terry ranking learnt from preference pairs.

Each pair holds a document labelled 1 and one labelled 0; the model is a linear score of surface features
(shares of characters by kind, word lengths, repetition) for which the logistic loss of the scores'
difference is least. The threshold is the quantile of the training part's scores at the share of label 0, and the
score is shifted so that this quantile reads 0.3.

All labelled documents of the training part are learnt. They are dealt by hash to parts of about SAMPLE; within a
part each document of label 0 is paired with PARTNERS of label 1, or with as many more as it takes to pair every one.
Where a label is rare, its documents go to several parts, so that no part lacks it. The fit is Newton's method, a pass
over all pairs for each step. Scoring covers all rows and whole texts.

Defined results: a null or empty text gets the score of all-zero features; rows that repeat get equal
scores; a long text counts whole; a score at the threshold counts as label 1; without labels of both classes
every score is 0.5; rows that repeat with equal doc_id and text are learnt once; an empty table gives no rows; other columns are kept by score() under their names, but one
that has the name asked for the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import kept, slices, utf8, without, word_bounds, word_hashes
from .toxicity import labelled

#: Labelled documents of a part, and how many of the rarer label a part has at least, about.
SAMPLE, LEAST = 6000, 50
PARTNERS = 24
#: Documents of label 0 whose pairs are made at once.
AT_ONCE = 256
BINS = 4096
#: Steps of the fit at most, and the slope at which it ends.
STEPS, FLAT = 40, 1e-7
PENALTY = 1e-4
THRESHOLD = 0.3

#: Class of each byte: every ASCII mark has its own, then lower, upper, digit, space, newline, other.
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_KIND = np.full(256, len(_MARKS) + 5, np.int64)
_KIND[_MARKS] = np.arange(len(_MARKS))
_KIND[ord("a") : ord("z") + 1] = len(_MARKS)
_KIND[ord("A") : ord("Z") + 1] = len(_MARKS) + 1
_KIND[ord("0") : ord("9") + 1] = len(_MARKS) + 2
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = len(_MARKS) + 3
_KIND[0x0A] = len(_MARKS) + 4
_KINDS = len(_MARKS) + 6


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(text * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    starts, ends, at = word_bounds(data, offsets)
    words = np.maximum(np.diff(at), 1)
    of = np.repeat(np.arange(n), np.diff(at))
    lengths = ends - starts
    mean = np.bincount(of, lengths, n) / words
    spread = np.sqrt(np.maximum(np.bincount(of, lengths.astype(float) ** 2, n) / words - mean**2, 0))
    hashes = word_hashes(data, starts, ends)
    order = np.lexsort((hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    distinct = np.bincount(of[order[new]], minlength=n) / words
    plain = np.sqrt(kinds / np.maximum(np.diff(offsets), 1)[:, None])
    size = np.log1p(np.diff(at))
    return np.column_stack([plain, np.log1p(mean), np.log1p(spread), distinct, size, distinct * size, size**2 / 10, np.log1p(kinds[:, -2]), np.diff(at) > 0])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label and features of labelled texts: of fixed size whatever the text."""
    for batch in slices(batches):
        x = [r.tobytes() for r in features(*utf8(batch.column(2))).astype(float)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["doc_id", "label", "x"])


def _parts(rows: DataFrame, ones: int, zeros: int) -> DataFrame:
    """A row for each part: the feature rows of its documents of label 1 and of label 0, in order of doc_id."""
    parts = -(-(ones + zeros) // SAMPLE)
    copies = min(parts, -(-LEAST * parts // min(ones, zeros)))
    turns = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == int(ones < zeros), copies - 1).otherwise(0)))
    dealt = rows.select("*", turns.alias("turn")).select("doc_id", "label", "x", F.pmod(F.pmod(F.xxhash64("doc_id", "x"), F.lit(parts)) + F.col("turn"), F.lit(parts)).alias("part"))

    def stacked(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("x", "ascending")])
        y = part["label"].to_numpy()
        x = [b"".join(part["x"].filter(pa.array(y == k)).to_pylist()) for k in (1, 0)]
        return pa.table({"good": pa.array(x[:1], pa.binary()), "bad": pa.array(x[1:], pa.binary())})

    return dealt.groupBy("part").applyInArrow(stacked, "good binary, bad binary")


def _pairs(good: np.ndarray, bad: np.ndarray) -> Iterator[np.ndarray]:
    """Feature differences of the pairs of a part: every document is in one at least, if the part has both labels."""
    if not len(good) or not len(bad):
        return
    partners = max(PARTNERS, -(-len(good) // len(bad)))
    for start in range(0, len(bad), AT_ONCE):
        some = bad[start : start + AT_ONCE]
        pick = ((start + np.arange(len(some)))[:, None] * partners + np.arange(partners)) % len(good)
        yield (good[pick] - some[:, None]).reshape(-1, good.shape[1])


def _fitted(parts: DataFrame, scale: np.ndarray) -> np.ndarray:
    """Weights of the features, divided by scale, for which the pairs' logistic loss with its penalty is least."""
    width = len(scale)

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + width + width * width)  # pairs, loss, slope, curvature
            for batch in batches:
                for good, bad in zip(batch.column(0), batch.column(1), strict=True):
                    for x in _pairs(*[np.frombuffer(b.as_py()).reshape(-1, width) / scale for b in (good, bad)]):
                        z = x @ w
                        wrong = 1 / (1 + np.exp(np.clip(z, -500, 500)))
                        total += np.r_[len(z), np.logaddexp(0, -z).sum(), -(wrong @ x), ((x.T * (wrong * (1 - wrong))) @ x).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        total = sum(np.frombuffer(x) for x in parts.mapInArrow(work, "total binary").toArrow()["total"].to_pylist())
        n, loss, slope, curve = total[0], total[1], total[2 : 2 + width], total[2 + width :].reshape(width, width)
        return loss / n + PENALTY / 2 * float(w @ w), slope / n + PENALTY * w, curve / n + PENALTY * np.eye(width)

    w = np.zeros(width)
    value, slope, curve = sums(w)
    for _ in range(STEPS):
        if np.abs(slope).max() <= FLAT:
            break
        step, length = np.linalg.solve(curve, slope), 1.0
        while (new := sums(w - length * step))[0] > value and length > 1e-3:
            length /= 2
        if new[0] > value:
            break
        w, (value, slope, curve) = w - length * step, new
    return w


def _of_rank(scores: DataFrame, rank: int) -> float:
    """The score z of that rank, from 0: the range that holds it is counted by bins until one value is left."""
    low, high = scores.agg(F.min("z"), F.max("z")).first()
    below = 0
    while low < high:
        bins = scores.where(F.col("z").between(low, high)).groupBy(F.least(F.floor((F.col("z") - low) / (high - low) * BINS), F.lit(BINS - 1)).alias("bin"))
        for r in sorted(bins.agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).collect()):  # BINS rows at most
            low, high = r.low, r.high
            if below + r.n > rank:
                break
            below += r.n
    return low


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Mean and scale of the features, weights, and the score at the threshold's quantile."""
    rows = kept(labelled(docs, labels, label).mapInArrow(_feature_rows, "doc_id long, label int, x binary"), "features")
    ones, zeros = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not ones or not zeros:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([x.mean(0).tobytes()], pa.binary()), pa.array([((x - x.mean(0)) ** 2).sum(0).tobytes()], pa.binary())], ["n", "mean", "squares"])

    found = rows.select("x").mapInArrow(moments, "n long, mean binary, squares binary").toArrow()
    n = found["n"].to_numpy()[:, None]
    means, squares = (np.array([np.frombuffer(x) for x in found[c].to_pylist()]) for c in ("mean", "squares"))
    mean = (n * means).sum(0) / n.sum()
    deviation = np.sqrt((squares + n * (means - mean) ** 2).sum(0) / n.sum())
    scale = np.where(deviation > 1e-9, deviation, np.inf)
    w = _fitted(kept(_parts(rows, ones, zeros), "parts"), scale)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array((x - mean) / scale @ w)], ["z"])

    scores = kept(rows.select("x").mapInArrow(ranked, "z double"), "scores")
    return mean, scale, w, _of_rank(scores, zeros * (ones + zeros - 1) // (ones + zeros))


def score(docs: DataFrame, model, column: str = "score") -> DataFrame:
    """The rows of docs with a score between 0 and 1."""
    docs = without(docs, column)
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            z = np.zeros(batch.num_rows)
            if model:
                mean, scale, w, middle = model
                z = (features(*utf8(batch.column(place))) - mean) / scale @ w - middle + np.log(THRESHOLD / (1 - THRESHOLD))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*batch.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, `{column}` double")
