"""BPE encoding and decoding (segment tree over adjacent pair ranks).

The leaves of a word's tree hold its adjacent pairs' ranks; the root is the leftmost pair of lowest rank.
A merge updates at most three leaves, each in a logarithmic number of steps, until the root has no
mergeable pair. Trees of one width are worked on together as rows of arrays.

Defined results: a null text counts as empty: no ids, empty decoded text; rows that repeat give repeated
rows; of equal pairs the leftmost is merged first; an empty table gives none; long texts are encoded whole,
whatever the number of their different units; other columns are kept by encode() and
decode() and ignored by round_trip().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .text import slices, utf8

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(text: Column, tokenizer: str) -> Column:
    """The ids of a text column: array<int>."""

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        encoder = bpe.encoder(tokenizer, bpe.merge_by_trees)
        out: list[np.ndarray] = []
        for part in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])]):
            ids, stops = encoder.encode(*utf8(part.column(0)))
            out += np.split(ids, stops[1:-1])
        return pd.Series(out, dtype=object)

    return ids_of(text)


def decode(ids: Column, tokenizer: str) -> Column:
    """The text that a column of ids stands for; null ids give null."""

    @F.pandas_udf("string")
    def text_of(rows: pd.Series) -> pd.Series:
        v = bpe.vocabulary(tokenizer)
        return pd.Series([None if r is None else v.decode(r) for r in rows], dtype=object)

    return text_of(ids)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(tokenizer, bpe.merge_by_trees)
        for batch in slices(batches):
            ids, stops = encoder.encode(*utf8(batch.column(1)))
            raw, every = memoryview(ids.astype("<u4").tobytes()), ids.tolist()
            bounds = list(zip(stops.tolist(), stops[1:].tolist(), strict=False))
            digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in bounds]
            decoded = [hashlib.sha256(encoder.v.decode(every[a:b]).encode()).hexdigest() for a, b in bounds]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(stops)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)
