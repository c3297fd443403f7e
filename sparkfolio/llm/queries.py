"""The corpus operators' queries, applied with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import leaks
from .language_id import identify_languages
from .line_dedup import drop_boilerplate
from .mixing import mix_sources
from .secret_markov import secret_report, trained_on
from .simhash_pigeonring import simhash_groups
from .substring_recompression import remove_repeated_words
from .suffix_bpr import remove_repeated_bytes
from .token_counts import token_counts
from .vp_tree import nearest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_substring_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(_table(spark, sf_dir, "documents"), keep=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_suffix_bpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"), keep=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), kept="kept")
    lines = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(c, "\n", -1))).cast("long")
    return kept.select("doc_id", lines("text").alias("n_lines"), F.length("kept").cast("long").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return secret_report(documents, trained_on(documents))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vp_tree": op1_vp_tree,
    "op2_substring_recompression": op2_substring_recompression,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_markov": op6_secret_markov,
    "op7_language_id": op7_language_id,
    "op8_simhash_pigeonring": op8_simhash_pigeonring,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_bpr": op10_suffix_bpr,
}
ORACLE_SQL: dict[str, str] = {
    "op2_substring_recompression": """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS v FROM documents),
windows AS (SELECT r, doc_id, p, md5(array_to_string(v[p:p + 49], ' ')) AS h FROM (SELECT r, doc_id, v, unnest(range(1, len(v) - 48)) AS p FROM docs WHERE len(v) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h),
hits AS (SELECT r, p FROM windows JOIN least USING (h) WHERE m < doc_id),
words AS (SELECT r, unnest(v) AS word, generate_subscripts(v, 1) AS i FROM docs),
marked AS (SELECT w.r, w.i, w.word, max(h.p) OVER (PARTITION BY w.r ORDER BY w.i ROWS UNBOUNDED PRECEDING) AS last FROM words w LEFT JOIN hits h ON h.r = w.r AND h.p = w.i),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM marked WHERE last IS NULL OR i - last > 49 GROUP BY r)
SELECT d.doc_id, len(d.v)::BIGINT AS n_words, (len(d.v) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM docs d LEFT JOIN kept k USING (r)""",
    "op10_suffix_bpr": """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT r, doc_id, p, hash(substr(x, 2 * p - 1, 100)) AS h FROM (SELECT r, doc_id, x, unnest(range(1, n - 48)) AS p FROM docs WHERE n >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h),
hits AS (SELECT r, p FROM windows JOIN least USING (h) WHERE m < doc_id),
islands AS (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 50 THEN 0 ELSE 1 END AS opens FROM hits)),
spans AS (SELECT r, g, min(p) AS a, max(p) + 49 AS b FROM islands GROUP BY r, g),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY g), 0) AS before FROM spans),
kept AS (SELECT r, sum(b - a + 1) AS removed, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY g) || substr(any_value(x), 2 * max(b) + 1) AS t FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(k.removed, 0)::BIGINT AS n_removed, coalesce(k.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.t, d.x))) AS kept_sha256 FROM docs d LEFT JOIN kept k USING (r)""",
    "op5_line_dedup": """
WITH lines AS (SELECT rowid AS r, source, unnest(string_split(text, chr(10))) AS line FROM (SELECT row_number() OVER () AS rowid, source, text FROM documents)),
per_page AS (SELECT DISTINCT r, source, rtrim(line, chr(32) || chr(9) || chr(13)) AS line FROM lines),
bad AS (
  SELECT c.source, c.line FROM (SELECT source, line, count(*) AS n FROM per_page WHERE line <> '' GROUP BY ALL) c
  JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY ALL) t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n >= 5 AND n > 0.02::DOUBLE * pages),
lists AS (SELECT source, list(line) AS lines FROM bad GROUP BY ALL),
kept AS (
  SELECT d.doc_id, d.text, CASE WHEN d.text IS NULL OR l.lines IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(l.lines, rtrim(x, chr(32) || chr(9) || chr(13)))), chr(10)) END AS kept
  FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
  length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256 FROM kept""",
}
