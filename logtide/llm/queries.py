"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logtide.llm import bpe, collocations, digest, divergence, exact_dedup, html_text, language, merge_bpe, mixing, near_dedup, pii, secrets, sharding
from logtide.llm.common import documents, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, kept=["doc_id"]))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(documents(spark, sf_dir)))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir))


def op5_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edit_likeness(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(documents(spark, sf_dir)))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.classify(docs, language.train(docs))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("times")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op12_merge_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = merge_bpe.share_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.digests(merge_bpe.round_trip(docs, vocabulary, kept=["doc_id"]))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), p AS (SELECT rid, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pid FROM d),
w AS (SELECT rid, lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
t AS (SELECT rid, lang, pid, unnest(words) AS w1, generate_subscripts(words, 1) AS pos FROM w),
g AS (SELECT lang, w1, lead(w1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM t WINDOW s AS (PARTITION BY rid, pid ORDER BY pos)),
totals AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, w1, w2, max(f) AS most
  FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
), cuts AS (
  SELECT x.lang, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 x JOIN f1 l ON l.lang = x.lang AND l.w1 = x.w1 JOIN f1 r ON r.lang = x.lang AND r.w1 = x.w2
  LEFT JOIN longer o ON o.lang = x.lang AND o.w1 = x.w1 AND o.w2 = x.w2
  WHERE x.f >= 10 AND (o.most IS NULL OR 100 * o.most < 50 * x.f)
  UNION ALL
  SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 1, l.f, r.f
  FROM f3 x JOIN f1 l ON l.lang = x.lang AND l.w1 = x.w1 JOIN f2 r ON r.lang = x.lang AND r.w1 = x.w2 AND r.w2 = x.w3
  UNION ALL
  SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 2, l.f, r.f
  FROM f3 x JOIN f2 l ON l.lang = x.lang AND l.w1 = x.w1 AND l.w2 = x.w2 JOIN f1 r ON r.lang = x.lang AND r.w1 = x.w3
), scored AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), chosen AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM chosen
)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n,
         (1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (sum(n) OVER w + 5)) // (sum(n) OVER l + 5 * count(*) OVER s))::BIGINT AS q
  FROM every
  WINDOW s AS (PARTITION BY lang, source), w AS (PARTITION BY lang, term), l AS (PARTITION BY lang)
), moved AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
  GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN moved m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_near_dedup": op4_near_dedup,
    "op5_quartile_digest": op5_quartile_digest,
    "op6_secret_scan": op6_secret_scan,
    "op7_html_text": op7_html_text,
    "op8_language_id": op8_language_id,
    "op9_hilbert_shards": op9_hilbert_shards,
    "op10_fair_mix": op10_fair_mix,
    "op11_collocations": op11_collocations,
    "op12_merge_bpe": op12_merge_bpe,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op11_collocations": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
