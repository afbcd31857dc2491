"""The registered queries of this subpackage, and the SQL that expresses some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, jaccard, langid, licenses, secrets, suffix, tokencount, topk, toxicity
from .runtime import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scans, op2_token_counts, op3_ngram_jaccard_join, op4_benchmark_decontamination, op5_bpe_encoding, op6_language_id, op7_suffix_array_dedup, op8_toxicity, op9_license_scans, op10_exact_topk)}


_WORDS = """list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda v: v <> '')"""

#: Runs of n words, n = 1 to 4 for short items, of documents; the shingles of items.
OP4_SQL = f"""
WITH d AS (SELECT doc_id AS id, row_number() OVER () AS row_no, {_WORDS} AS w FROM documents),
  b AS (SELECT item_id AS id, row_number() OVER () AS row_no, {_WORDS} AS w FROM benchmark),
  b_sh AS (SELECT DISTINCT id, row_no, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
           FROM (SELECT *, least(len(w), 5) AS n FROM b WHERE len(w) > 0)),
  d_sh AS (SELECT DISTINCT id, row_no, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
           FROM d, (SELECT DISTINCT n FROM b_sh) WHERE len(w) >= n),
  size AS (SELECT row_no, count(*) AS n_item FROM b_sh GROUP BY row_no),
  hit AS (SELECT d_sh.id AS doc_id, d_sh.row_no AS r, b_sh.id AS item_id, b_sh.row_no AS q, count(*) AS n_shared FROM d_sh JOIN b_sh USING (n, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM hit JOIN size ON size.row_no = hit.q WHERE n_shared >= 0.8 * n_item - 1e-9"""

#: All pairs that share a shingle, and the closure of those that reach the threshold.
OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
  k AS (SELECT doc_id, array_to_string(w, ' ') AS k, w FROM d),
  t AS (SELECT k, min(doc_id) AS rep, count(DISTINCT doc_id) AS n_copies, any_value(w) AS w FROM k WHERE k <> '' GROUP BY k),
  s AS (SELECT DISTINCT rep, unnest(CASE WHEN len(w) < 5 THEN [k || ' #'] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM t),
  n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
  shared AS (SELECT x.rep AS a, y.rep AS b, count(*) AS i FROM s x JOIN s y USING (s) WHERE x.rep <> y.rep GROUP BY ALL),
  link AS (SELECT a, b FROM shared JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE i >= 0.8 * (x.n + y.n - i) - 1e-9),
  reach AS (SELECT rep AS a, rep AS b FROM t UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
  class AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
  degree AS (SELECT a AS rep, count(*) AS n_links FROM link GROUP BY a)
SELECT k.doc_id, coalesce(class_id, k.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM k LEFT JOIN t USING (k) LEFT JOIN class USING (rep) LEFT JOIN degree USING (rep)"""

#: Windows of 50 words that several documents hold, united where they touch.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
  win AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS lo, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM d WHERE len(w) >= 50),
  rep AS (SELECT h FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
  hit AS (SELECT doc_id, lo, CASE WHEN lo > lag(lo) OVER (PARTITION BY doc_id ORDER BY lo) + 50 THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT doc_id, lo FROM win SEMI JOIN rep USING (h))),
  part AS (SELECT doc_id, lo, sum(new) OVER (PARTITION BY doc_id ORDER BY lo) AS g FROM hit),
  span AS (SELECT doc_id, min(lo) AS lo, max(lo) + 50 AS hi FROM part GROUP BY doc_id, g)
SELECT doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_words, string_agg(lo || ':' || hi, ',' ORDER BY lo) AS spans FROM span GROUP BY doc_id"""

OP10_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e, len(embedding) AS n FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
  s AS (SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND c.n = q.n),
  k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s)
SELECT query_id, "rank", vec_id, score FROM k WHERE "rank" <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL, "op7_suffix_array_dedup": OP7_SQL, "op10_exact_topk": OP10_SQL}
