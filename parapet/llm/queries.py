"""Registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from parapet.llm import (
    byte_bpe, exact_dedup, html_text, language, lexical, licences, merkle, mixing, near_dedup, neighbours,
    packing, quality, toxicity,
)
from parapet.llm.shared import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels.where("quality = 1"))


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.with_score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@_query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_dedup.near_duplicates(docs, near_dedup.Rule(words=3, percent=85))


@_query
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("dice", F.round("dice", 9))


SQL["op5_licences"] = f"""
WITH t AS (SELECT * FROM (VALUES {", ".join("('%s', '%s')" % (a, b.replace("'", "''")) for a, b in licences.TEMPLATES)})
           AS v(licence, body)),
tw AS (SELECT row_number() OVER () AS k, licence, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM t),
tb AS (SELECT k, licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM tw),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(coalesce(text, ''), chr(10)),
                                     string_split_regex(coalesce(text, ''), '\\n\\s*\\n'))) AS unit FROM documents),
uw AS (SELECT doc_id, unit, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM u),
ub AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own
       FROM uw WHERE len(w) BETWEEN 2 AND 60),
m AS (SELECT doc_id, unit, licence, 2.0 * len(list_intersect(ub.own, tb.own)) / (len(ub.own) + len(tb.own)) AS dice
      FROM ub JOIN tb ON len(ub.own) <= 1.5 * len(tb.own) AND len(tb.own) <= 1.5 * len(ub.own))
SELECT doc_id, licence, round(max(dice), 9) AS dice, count(DISTINCT unit) AS units
FROM m WHERE dice >= {licences.THRESHOLD} GROUP BY doc_id, licence
"""


@_query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.search(vectors, F.col("vec_id") % 100 == 0)


@_query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_text.with_text(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(language.training_part(docs))
    told = language.with_language(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixing.mix(docs)
    rows = spark.createDataFrame(
        [(x["number"], x["source_size"], float(x["target"])) for x in plan.sources],
        "number int, source_size long, target double")
    return mixing.taken(plan).join(F.broadcast(rows), "number").select(
        "doc_id", "size", "source_size", "target", "taken", "source")


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL["op10_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


@_query
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lexical.search(lexical.build_index(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL["op11_lexical"] = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
norms AS (SELECT doc_id, 100 - 90 + ((90 * n * n_docs) // n_terms) AS m FROM lengths, total),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN norms USING (doc_id)
           GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""


@_query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = merkle.manifest(merkle.leaves(docs, tampered))
    root = F.lit(made.root).cast("string")
    return made.rows.select(
        "doc_id", "leaf", "subroot", root.alias("root"), merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
        merkle.fold(F.col("other"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# DuckDB has no crc32: its table is spelled out bit by bit
SQL["op12_manifest"] = """
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b::UBIGINT FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)
  FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
ids AS (SELECT doc_id, doc_id::VARCHAR AS s FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
sums(doc_id, s, c) AS (
  SELECT doc_id, s, 4294967295::UBIGINT FROM ids
  UNION ALL SELECT doc_id, substr(s, 2), xor(c >> 8, t[(xor(c, ord(substr(s, 1, 1))::UBIGINT) & 255)::INT + 1])
  FROM sums, crc WHERE s <> ''),
tampered AS (SELECT doc_id FROM sums WHERE s = '' AND xor(c, 4294967295::UBIGINT) % 3 = 0),
v AS (SELECT doc_id, lang, text,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
        coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
      FROM documents),
h AS (SELECT v.doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(text) || ':' || CASE WHEN tampered.doc_id IS NULL THEN text
               ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '-')) AS other
      FROM v LEFT JOIN tampered ON v.doc_id = tampered.doc_id),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
        count(*) OVER (PARTITION BY lang) AS n FROM h),
t(level, lang, i, n, d) AS (
  SELECT 0, lang, r, n, leaf FROM d
  UNION ALL SELECT level + 1, lang, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i))
  FROM t WHERE n > 1 GROUP BY level, lang, i // 8, n),
sub AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n
        FROM t WHERE n = 1),
u(level, i, n, d) AS (
  SELECT 0, r, n, subroot FROM sub
  UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i))
  FROM u WHERE n > 1 GROUP BY level, i // 8, n),
w AS (SELECT level, lang, i,
        coalesce(string_agg(d, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
        coalesce(string_agg(d, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
      FROM t WHERE n > 1 WINDOW run AS (PARTITION BY level, lang, i // 8 ORDER BY i)),
x AS (SELECT level, i,
        coalesce(string_agg(d, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
        coalesce(string_agg(d, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
      FROM u WHERE n > 1 WINDOW run AS (PARTITION BY level, i // 8 ORDER BY i)),
f(lang, r, level, i, own, proof) AS (
  SELECT lang, r, 0, r, other, '' FROM d
  UNION ALL SELECT f.lang, r, f.level + 1, f.i // 8, sha256(a || own || z), proof || a || z
  FROM f JOIN w ON f.lang IS NOT DISTINCT FROM w.lang AND f.level = w.level AND f.i = w.i),
g(lang, r, level, i, own, proof) AS (
  SELECT f.lang, f.r, 0, sub.r, arg_max(own, level), arg_max(proof, level)
  FROM f JOIN sub ON f.lang IS NOT DISTINCT FROM sub.lang GROUP BY f.lang, f.r, sub.r
  UNION ALL SELECT g.lang, r, g.level + 1, g.i // 8, sha256(a || own || z), proof || a || z
  FROM g JOIN x ON g.level = x.level AND g.i = x.i),
e AS (SELECT lang, r, arg_max(own, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256
      FROM g GROUP BY lang, r)
SELECT d.doc_id, leaf, subroot, (SELECT d FROM u WHERE n = 1) AS root, proof_sha256, folded_root,
       folded_root = (SELECT d FROM u WHERE n = 1) AS verified
FROM d JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang
JOIN e ON d.lang IS NOT DISTINCT FROM e.lang AND d.r = e.r
"""


@_query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocabulary = byte_bpe.public_vocabulary()
    ids = byte_bpe.encode(docs, vocabulary, packed=True)
    return byte_bpe.decode(ids, vocabulary).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
