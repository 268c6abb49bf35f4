"""Token counts (rank-synchronous array merging).

Texts are cut into pre-tokens, kept as ragged numpy arrays of symbols. In each round every sequence
applies its lowest-ranked pair at all its places at once; what survives is counted. The ids of a unit between
blanks are remembered by the worker, so that a unit that comes again isn't merged again.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows that repeat give repeated rows; of equal
pairs the leftmost is merged first; an empty table gives none; long texts count whole, whatever the number of
their different units; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .text import slices, utf8

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; tokenizer: place of a .json file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(tokenizer, bpe.merge_in_step)
        for batch in slices(batches):
            data, offsets = utf8(batch.column(1))
            tokens = encoder.counts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)
