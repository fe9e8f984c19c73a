"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm import (
    alignment, direct_codes, hash_ring, line_chunks, lm_score, merkle, ngram_join, radix_dedup, spaced_seeds, suffix_dedup, token_counts, toxicity,
    word_table,
)
from cinderlog.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(job):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return job(prepare(spark), str(sf_dir).rstrip("/"))

        run.__name__, run.__doc__ = job.__name__, job.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return job

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query("op5_line_chunks")
def op5(spark, sf_dir):
    """Repeated multi-line passages of all documents; the digest is of the text that stays."""
    out = line_chunks.dedup_passages(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256")
    )


@_query("op6_radix_dedup", r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
""")
def op6(spark, sf_dir):
    return radix_dedup.exact_groups(documents(spark, sf_dir))


@_query("op7_spaced_seeds")
def op7(spark, sf_dir):
    """Every document against the whole benchmark."""
    return spaced_seeds.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query("op8_direct_codes")
def op8(spark, sf_dir):
    """Token file of all documents, read back."""
    out = direct_codes.write_and_read(documents(spark, sf_dir))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


@_query("op9_token_counts")
def op9(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir))


@_query("op3_lm_score")
def op3(spark, sf_dir):
    return lm_score.score(documents(spark, sf_dir))


@_query("op4_word_table")
def op4(spark, sf_dir):
    return word_table.encode_and_decode(documents(spark, sf_dir), digest=True)


@_query("op10_ngram_join")
def op10(spark, sf_dir):
    return ngram_join.link_documents(documents(spark, sf_dir))


@_query("op2_suffix_dedup")
def op2(spark, sf_dir):
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query("op11_hash_ring")
def op11(spark, sf_dir):
    """All documents over 24 shards, counts at most one apart."""
    out = hash_ring.shard_rows(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@_query("op12_merkle_manifest", r"""
WITH RECURSIVE
f AS (
  SELECT doc_id, lang,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(doc_id::varchar, ''), lambda c: ascii(c)::BIGINT)),
           lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)),
             lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS crc
  FROM documents),
l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered
  FROM f),
k AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM l),
p AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
  FROM k),
t AS (
  SELECT g, 0 AS level, pos, n, leaf AS digest FROM p
  UNION ALL
  SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM t WHERE n > 1 GROUP BY g, level, pos // 8, n),
u AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, g, digest FROM t WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, NULL, sha256(string_agg(digest, '' ORDER BY pos))
  FROM u WHERE n > 1 GROUP BY level, pos // 8, n),
every AS (
  SELECT g, level, pos, n, digest FROM t
  UNION ALL SELECT -1, level, pos, n, digest FROM u),
s AS (
  SELECT g, level, pos, n,
         coalesce(string_agg(digest, '') OVER (PARTITION BY g, level, pos // 8 ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (PARTITION BY g, level, pos // 8 ORDER BY pos
           ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM every),
w AS (
  SELECT row_number() OVER () AS id, g AS home, g, 0 AS level, pos, n, '' AS proof, coalesce(tampered, leaf) AS own FROM p
  UNION ALL
  SELECT w.id, w.home,
         CASE WHEN w.n > 1 THEN w.g ELSE -1 END,
         CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
         CASE WHEN w.n > 1 THEN w.pos // 8 ELSE w.home END,
         CASE WHEN w.n > 1 THEN (w.n + 7) // 8 ELSE (SELECT count(DISTINCT g) FROM p) END,
         CASE WHEN w.n > 1 THEN w.proof || s.l || s.r ELSE w.proof END,
         CASE WHEN w.n > 1 THEN sha256(s.l || w.own || s.r) ELSE w.own END
  FROM w JOIN s ON s.g = w.g AND s.level = w.level AND s.pos = w.pos
  WHERE w.n > 1 OR w.g >= 0),
e AS (SELECT id, proof, own FROM w WHERE n = 1 AND g = -1),
i AS (SELECT row_number() OVER () AS id, * FROM p)
SELECT i.doc_id, i.leaf, subs.digest AS subroot, top.digest AS root, sha256(e.proof) AS proof_sha256, e.own AS folded_root,
       e.own = top.digest AS verified
FROM i JOIN e USING (id) JOIN (SELECT g, digest FROM t WHERE n = 1) subs ON subs.g = i.g
CROSS JOIN (SELECT digest FROM u WHERE n = 1) top
""")
def op12(spark, sf_dir):
    """Digests, roots and proofs of all documents."""
    return merkle.manifest(documents(spark, sf_dir)).drop("lang")


@_query("op13_lockstep_alignment")
def op13(spark, sf_dir):
    """All documents by both vocabularies."""
    return alignment.align_documents(documents(spark, sf_dir))
