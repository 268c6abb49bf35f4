"""Corpus pipeline: toxicity, n-gram Jaccard join, substring dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of `documents`; the last returns each document's ids and what they decode to.

Defined results: a null or empty text isn't toxic, a copy, a repeat or an item of the benchmark: it stays and is
encoded as empty; a null doc_id stays, as nothing says of which group it is the least; rows that repeat with
equal doc_id and text are one document after the second stage; of a group of copies the least doc_id stays, of
several texts under it the one of the least hash; a document of score 0.5 is toxic; texts count whole whatever
their length; an empty table passes through all stages; further columns are kept under their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwalk.llm import bpe_codec, decontaminate, jaccard_join, substring_dedup, toxicity
from panelwalk.llm.queries import WORD_BPE
from panelwalk.llm.text import documents, kept, spare

#: Near copies share this percentage of their n-grams of so many words.
NEAR_WORDS, NEAR_SHARE = 5, 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches the threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    column = spare(docs, "toxicity")
    return toxicity.score(docs, model, column).where(F.col(column) < toxicity.THRESHOLD).drop(column)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of linked documents: near copies are those that share
    80 percent of their five-word n-grams (op8's query has a bound of its own)."""
    return jaccard_join.representatives(docs, n=NEAR_WORDS, share=NEAR_SHARE)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes word windows out that occur more than once."""
    return substring_dedup.removed(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each document's ids and of their decoded text."""
    return bpe_codec.round_trip(docs, WORD_BPE)


STAGES = [("toxicity", without_toxic), ("jaccard_join", one_of_each_group), ("substring_dedup", without_repeats), ("decontamination", without_benchmark), ("bpe_encoding", encoded)]

#: SQL cannot learn the classifier nor merge pairs by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
