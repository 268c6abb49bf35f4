"""The operators as queries with their production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, collocations, decontaminate, exact_dedup, jaccard_join, lm_score, mpeg_audio, prefix_trie, quality, sstable, substring_dedup, token_count, toxicity
from .text import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _held_out(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _held_out(quality.score(docs, quality.fit(docs, _labels(spark, sf_dir))), quality.THRESHOLD)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), BYTE_BPE)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir), BYTE_BPE)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.round_trip(documents(spark, sf_dir))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(documents(spark, sf_dir), WORD_BPE)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(documents(spark, sf_dir), n=3, share=90).select("doc_id", "n_shingles", "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _held_out(toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir))), toxicity.THRESHOLD)


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.write_and_read(documents(spark, sf_dir), BYTE_BPE)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality, op3_token_counts, op4_lm_score, op5_media_columns, op6_bpe_round_trip, op7_decontamination, op8_jaccard_join, op9_toxicity, op10_sstable, op11_exact_dedup, op12_prefix_trie, op13_collocations)}

#: DuckDB. Words are cut as the operators cut them; a document's words are a list.
_WORDS = r"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents"

ORACLES: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH words AS ({_WORDS}),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM windows JOIN again USING (h)),
gone AS (SELECT doc_id, list(j) AS js FROM covered GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string([w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(js, k)], ' ') END) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)""",
    "op8_jaccard_join": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 90 * (s.n + t.n - c)),
ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT doc_id AS x, doc_id AS least FROM documents UNION SELECT ways.y, reach.least FROM reach JOIN ways ON reach.x = ways.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x, min(least) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id""",
    "op11_exact_dedup": r"""
WITH digests AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS kept, h AS text_sha256
FROM digests WINDOW g AS (PARTITION BY h)""",
    "op12_prefix_trie": r"""
WITH turns AS (SELECT conv_id, sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
convs AS (SELECT s.conv_id, s.conv_id - s.conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s.conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
    list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 6 AS h FROM sizes s),
whole AS (SELECT c.conv_id, p AS d, k, chars FROM convs c JOIN turns t ON t.conv_id = c.base AND p <= h
  UNION ALL SELECT c.conv_id, p - h + least(h, coalesce(n, 0)), k, chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND p > h LEFT JOIN sizes b ON b.conv_id = c.base),
paths AS (SELECT c.conv_id, coalesce(list(k ORDER BY d) FILTER (d IS NOT NULL), []) AS ks, coalesce(list(chars ORDER BY d) FILTER (d IS NOT NULL), []) AS cs FROM convs c LEFT JOIN whole USING (conv_id) GROUP BY c.conv_id),
steps AS (SELECT conv_id, ks, cs, unnest(range(0, len(ks) + 1)) AS depth FROM paths),
visits AS (SELECT conv_id, depth, array_to_string(ks[1:depth], '') AS key, CASE WHEN depth > 0 THEN array_to_string(ks[1:depth - 1], '') END AS parent, CASE WHEN depth > 0 THEN cs[depth] ELSE 0 END AS chars, depth = len(ks) AS ends FROM steps),
nodes AS (SELECT key, parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM visits GROUP BY ALL),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
valued AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
sums AS (SELECT a.key, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved FROM valued a JOIN valued b ON starts_with(b.key, a.key) GROUP BY a.key)
SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(v.ids) AS ends_sha256
FROM valued v JOIN sums USING (key) LEFT JOIN valued o ON o.key = v.parent""",
    "op13_collocations": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
sizes AS (SELECT unnest(range(1, 5)) AS size),
starts AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size),
f AS MATERIALIZED (SELECT lang, w[i:i + size - 1] AS p, size, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, p, a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scored AS (SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
spans AS (SELECT lang, p, size, a, unnest(range(2, size)) AS inside FROM f WHERE size > 2),
inner_phrases AS (SELECT lang, p[j:j + inside - 1] AS p, max(a) AS longer FROM (SELECT *, unnest(range(1, size - inside + 2)) AS j FROM spans) GROUP BY ALL),
stay AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.p = b.p WHERE longer IS NULL OR 100 * longer < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
