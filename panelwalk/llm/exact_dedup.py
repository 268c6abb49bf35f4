"""Exact dedup by digest, frequent digests apart.

    tagged     each row gets the SHA-256 of its text, white space runs made one space
    summaries  each task keeps a Misra-Gries summary of its digests: `counters` digests with counts; whenever there
               are more, the count of the first one too many is taken off all and those at zero go
    candidates summaries are summed by digest and cut to `counters` in the same way. A digest of more than
               rows / (counters + 1) rows is always among them
    winners    candidates are counted exactly, in the tasks first; those that are that frequent are the
               winners, each with its row that stays and its group's size. There are `counters` at most
    marked     winners are broadcast: their copies are settled where they lie, without a shuffle. The other digests
               are shuffled; no group of theirs has more than rows / (counters + 1) rows

Equality rests on SHA-256. Of equal texts the smallest doc_id stays; a null doc_id comes after all others, and of
rows with the same doc_id and text one stays (the result is the same whichever). Null text counts as
empty; empty texts are copies of each other. An empty table gives an empty one. A text of any length is hashed as a
whole. `deduplicated` keeps all columns, whatever their names; `groups` needs doc_id and text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import kept, spare

COUNTERS = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class MisraGries:
    """At most `counters` digests with counts; `taken` is the most that a count may be too small."""

    def __init__(self, counters: int):
        self.counters, self.taken = counters, 0
        self.digests, self.counts = pa.array([], pa.binary()), np.zeros(0, np.int64)

    def add(self, digests: pa.Array, counts: np.ndarray) -> None:
        both = pa.concat_arrays([self.digests, digests]).dictionary_encode()
        sums = np.zeros(len(both.dictionary), np.int64)
        np.add.at(sums, both.indices.to_numpy(), np.r_[self.counts, counts])
        if len(sums) > self.counters:
            off = int(np.partition(sums, -self.counters - 1)[-self.counters - 1])
            sums, self.taken = sums - off, self.taken + off
        there = sums > 0
        self.digests, self.counts = both.dictionary.filter(pa.array(there)), sums[there]


def summaries(digests: DataFrame, counters: int) -> DataFrame:
    """digest, n: the summaries of all tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(counters)
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            summary.add(found.field(0).cast(pa.binary()), found.field(1).to_numpy())
        yield pa.RecordBatch.from_arrays([summary.digests, pa.array(summary.counts)], ["digest", "n"])

    return digests.select("digest").mapInArrow(task, "digest binary, n long")


def candidates(digests: DataFrame, counters: int) -> DataFrame:
    """digest: every one with more than rows / (counters + 1) rows, `counters` at most."""
    summed = summaries(digests, counters).groupBy("digest").agg(F.sum("n").alias("n"))
    top = summed.orderBy(F.desc("n"), "digest").limit(counters + 1)
    beyond = F.max(F.when(F.col("place") > counters, F.col("n"))).over(Window.partitionBy())
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "digest")))
    return placed.withColumn("off", F.coalesce(beyond, F.lit(0))).where("n > off").select("digest")


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a number of its own for each row, kept."""
    digest = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    return kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")


def winners(tagged: DataFrame, counters: int) -> DataFrame:
    """digest, least, size of each digest with more than rows / (counters + 1) rows and at least two."""
    limit = tagged.count() // (counters + 1)
    found = F.broadcast(candidates(tagged, counters))  # `counters` digests of 32 bytes
    exact = tagged.join(found, "digest").groupBy("digest").agg(F.min(_order()).alias("least"), F.count("*").alias("size"))
    return exact.where(F.col("size") > max(1, limit))


def _marked(tagged: DataFrame, counters: int) -> DataFrame:
    won = kept(winners(tagged, counters), "winners")
    split = tagged.join(F.broadcast(won), "digest", "left")  # `counters` rows at most
    columns = ["doc_id", F.col("least.doc_id").alias("keep_id"), "size", (F.col("row") == F.col("least.row")).alias("kept"), "digest", "row"]
    frequent = split.where("size IS NOT NULL").select(*columns)
    group = Window.partitionBy("digest")
    others = split.where("size IS NULL").withColumns({"least": F.min(_order()).over(group), "size": F.count("*").over(group)}).select(*columns)
    return frequent.unionByName(others)


def groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    marked = _marked(_tagged(docs), counters)
    return marked.select("doc_id", "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with their columns."""
    row = spare(docs, "row")
    numbered = kept(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    digest = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    tagged = kept(numbered.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.col(row).alias("row")), "digests")
    stay = _marked(tagged, counters).where("kept").select(F.col("row").alias(row))
    return numbered.join(stay, row, "left_semi").drop(row)
