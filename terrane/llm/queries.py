"""The thirteen queries over the corpus tables and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .fill_in_middle import transform_digest
from .lexical_search import rank
from .ngram_join import near_duplicates
from .packing import pack
from .personal_data import find_personal_data
from .quality import score_quality
from .secret_scan import ADDED, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, KINDS, scan_secrets
from .sentencepiece_codec import encode_digest
from .sharding import shard
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .vector_search import search


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=16)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_quality_classifier, op3_ngram_join, op4_sentencepiece, op5_secret_scan, op6_personal_data, op7_substring_dedup, op8_exact_dedup, op9_packing, op10_vector_search, op11_lexical_search, op12_token_counts, op13_fill_in_middle)}


def _op5_kind(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Candidates of one kind, with places from the lengths of matches and of what lies between them."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT doc_id, owner, repository, {order} AS ord, '{kind}' AS kind, ends[i] - length(m[i]) AS start, ends[i] AS stop, v[i] AS value
  FROM (SELECT *, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(m[1:i], lambda x: length(x))) + list_sum(list_transform(g[1:i], lambda x: length(x)))) AS ends
        FROM (SELECT doc_id, owner, repository, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g
              FROM texts WHERE regexp_matches(t, {p}))), unnest(range(1, len(m) + 1)) AS u(i)
  WHERE length(v[i]) >= {least}"""


OP5_KINDS = [_op5_kind(i, *k) for i, k in enumerate((*KINDS, ADDED))]
OP5_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(OP5_KINDS)}),
kept AS (SELECT * FROM found WHERE ord < 3 OR (regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]'))),
owned AS (SELECT value, owners, repositories, owners < {EXAMPLE_OWNERS} AND repositories < {EXAMPLE_REPOSITORIES} AS live
  FROM (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM kept GROUP BY value)),
spans AS (SELECT doc_id, ord, live, owners, repositories, start, concat(kind, ':', start::BIGINT, ':', stop::BIGINT) AS name FROM kept JOIN owned USING (value) WHERE ord < 3 OR live)
SELECT t.doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
       sha256(coalesce(string_agg(name, ',' ORDER BY start, ord) FILTER (WHERE ord < 3), '')) AS base_sha256,
       coalesce(string_agg(name, ',' ORDER BY start, ord), '') AS spans, count(*) FILTER (WHERE live) AS n_live, coalesce(max(owners), 0) AS most_owners, coalesce(max(repositories), 0) AS most_repositories
FROM texts t LEFT JOIN spans s ON t.doc_id = s.doc_id GROUP BY t.doc_id
"""

OP8_SQL = """
WITH normal AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, text_sha256
FROM normal
"""

OP10_SQL = """
WITH clean AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_cosine_similarity(q.v, r.v) AS score
  FROM clean q JOIN clean r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""


OP11_SQL = r"""
WITH found AS (
  SELECT i, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, doc_id, text FROM documents)),
sized AS (SELECT i, doc_id, count(*) AS n FROM found GROUP BY ALL),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sized),
wanted AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
counted AS (SELECT i, term, count(*) AS tf FROM found WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, corpus GROUP BY term, docs),
scored AS (
  SELECT item_id, wanted.text, doc_id, i, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // length)))))::BIGINT AS score
  FROM wanted JOIN counted USING (term) JOIN weighed USING (term) JOIN sized USING (i), corpus GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT doc_id, n, form, t, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_secret_scan": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op10_vector_search": OP10_SQL, "op11_lexical_search": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
