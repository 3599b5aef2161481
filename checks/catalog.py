"""Every query with the SQL it is compared with.

A query reads the given tables as a whole.  Entries without SQL are compared by
their own tests instead (trained models, hashed vectors).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from checks import fragments as sql
from parapet import fixed_values as fv
from parapet.config import DEFAULT
from parapet.functions import decoding, repetition, text as tx
from parapet.functions.numbers import round_to
from parapet.functions.literals import matching_rules
from parapet.functions.pieces import frequent_pieces, truncate_pieces, vocabulary_from_table
from parapet.functions.rules import DEFAULT_RULES, rules_from_table
from parapet.operators import (
    corpus, drift, fusion, graph, metrics, prepare, reach, routing, rule_filter, selection, senders,
    text_model,
)
from parapet.operators.lineage import cut_lineage, shared_dir
from parapet.plans import evaluate
from parapet.plans.detect import ROUNDED, detect, score_texts
from parapet.plans.layers import (
    Layers, classifier_from_batches, classifier_from_column, classifier_from_model, constant_drift,
    drift_from_batches, drift_from_table, drift_from_text,
)
from parapet.schemas import AUDIT, DATASET_COLUMNS
from parapet.sources import files
from parapet.sources.tables import (
    conversation_messages, handoff_messages, plant, planted_conversations, planted_messages,
    table, texts as read_texts, trade_messages, turn_order,
)
from parapet.streaming.history import keyed_history, state_store
from parapet.streaming.screen import StreamScreening, start_screening, stream_score

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, compared_with: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if compared_with is not None:
            SQL[name] = compared_with
        return function

    return register


def run_folder(spark: SparkSession) -> str:
    """The name of a new folder for one run, under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


#: The test tables are one small file each; whoever runs the queries on them may deal
#: their rows out to so many tasks.  Larger tables come in many pieces anyway.
PIECES: int | None = None


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_texts(spark, sf, name, PIECES)


def planted(spark: SparkSession, sf: str) -> DataFrame:
    return planted_messages(texts(spark, sf, "documents"))


def planted_turns(spark: SparkSession, sf: str) -> DataFrame:
    return planted_conversations(texts(spark, sf, "conversations"))


def handoff(spark: SparkSession, sf: str) -> DataFrame:
    return handoff_messages(table(spark, sf, "events"))


def trade(spark: SparkSession, sf: str) -> DataFrame:
    return trade_messages(*[
        table(spark, sf, name) for name in ["lineitem", "orders", "customer", "supplier"]
    ])


def intent(spark: SparkSession, sf: str) -> list[float]:
    return drift.intent_from_vectors(table(spark, sf, "embeddings").where("label = 0"))


def document_layers(spark: SparkSession, sf: str) -> Layers:
    """Planted documents drift by the vector of the same number, where there is one."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return Layers(drift=drift_from_table(vectors, "doc_id", "embedding", intent(spark, sf)), drift_reads_text=False)


def detected(spark: SparkSession, sf: str, digits: int | None = 4) -> DataFrame:
    return detect(planted(spark, sf), document_layers(spark, sf), digits=digits)


def detected_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations, screened with a fixed drift; of the text previews are kept."""
    short = tx.preview(F.col("content"), fv.STEP_PREVIEW_CHARS).alias("step_preview")
    messages = planted_turns(spark, sf).select("*", short)
    return detect(messages, Layers(drift=constant_drift()), keep=_without_text(messages))


def _without_text(messages: DataFrame) -> list[str]:
    return [c for c in messages.columns if c != "content"]


# -- sources, sinks, preparation ----------------------------------------------

@query("read_messages", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    schema = StructType.fromDDL("conv_id bigint, turn bigint, role string, text string")
    return files.read_messages(spark, f"{sf}/conversations.parquet", schema=schema)


@query("normalise_labels", """
    SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 0 ELSE 1 END AS label
    FROM events""")
def _(spark, sf):
    raw = {"click": "benign", "view": "Safe", "purchase": "1", "signup": "0", "error": "INJECTION"}
    word = F.create_map(*[F.lit(x) for pair in raw.items() for x in pair])[F.col("event_type")]
    events = table(spark, sf, "events").withColumn("verdict", word)
    return prepare.normalise_labels(events, "verdict").select("event_id", "label")


_PAIRS = "[" + ", ".join(f"['{a}', '{b}']" for a, b in fv.SOURCE_AGENT_PAIRS) + "]"


def _source_sql(relation: str, row_id: str, text: str, source: str, kind: str, label: str) -> str:
    trimmed = f"trim({text}, {sql.quote(tx.WHITESPACE_CHARACTERS)})"
    pair = f"({_PAIRS})[{sql.pick_number('message_id', '42-pair', 5)} + 1]"
    return f"""
    SELECT message_id, content, {pair}[1] AS from_agent, {pair}[2] AS to_agent, label,
        CASE WHEN label = 1 THEN '{kind}' ELSE 'benign' END AS attack_type, '{source}' AS source
    FROM (SELECT '{source}:' || CAST({row_id} AS VARCHAR) AS message_id, {trimmed} AS content,
            CAST({label} AS INTEGER) AS label FROM {relation}) WHERE length(content) > 0"""


_DOCUMENTS_SQL = _source_sql(
    "documents JOIN labels USING (doc_id)", "doc_id", "text", "documents", fv.REAL_INJECTION, "toxic"
)


def _documents_source(spark, sf):
    labelled = texts(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return prepare.normalise_source(
        labelled.withColumn("label", F.col("toxic")), "text", "doc_id", "documents"
    )


@query("normalise_source", _DOCUMENTS_SQL)
def _(spark, sf):
    return _documents_source(spark, sf)


@query("union_sources", f"""
    SELECT source, count(*) AS n, count(*) FILTER (WHERE label = 1) AS injected,
        count(*) FILTER (WHERE label = 0) AS benign
    FROM ({_DOCUMENTS_SQL} UNION ALL
        {_source_sql("benchmark", "item_id", "text", "benchmark", fv.REAL_HARMFUL, "1")} UNION ALL
        {_source_sql("pages", "page_id", "html", "pages", fv.REAL_INJECTION, "0")})
    GROUP BY source""")
def _(spark, sf):
    def harmful():
        return prepare.normalise_source(
            table(spark, sf, "benchmark"), "text", "item_id", "benchmark", fv.REAL_HARMFUL
        )

    def pages():
        rows = table(spark, sf, "pages").withColumn("label", F.lit("ham"))
        return prepare.normalise_source(rows, "html", "page_id", "pages")

    def absent():
        return prepare.normalise_source(table(spark, sf, "no_such_table"), "text", "id", "absent")

    union = prepare.union_sources({
        "documents": lambda: _documents_source(spark, sf), "benchmark": harmful,
        "absent": absent, "pages": pages,
    })
    return union.rows.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("injected"),
        F.count_if(F.col("label") == 0).alias("benign"),
    )


@query("fill_missing_columns", """
    SELECT CAST(page_id AS VARCHAR) AS message_id, html AS content, 'unknown' AS from_agent,
        'unknown' AS to_agent, 1 AS label, 'unknown' AS attack_type
    FROM pages""")
def _(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("message_id"), F.col("html").alias("content")
    )
    return prepare.fill_missing_columns(pages, DATASET_COLUMNS)


@query("blend_sources", f"""
    WITH {sql.PLANTED_TURNS}, extra AS ({_DOCUMENTS_SQL}), drawn AS (
        SELECT * FROM extra ORDER BY {sql.hash_key("message_id", "42")}
        LIMIT (SELECT least(CAST(floor((SELECT count(*) FROM planted) * 0.25e0 / 0.75e0) AS BIGINT),
            (SELECT count(*) FROM extra)))
    ), blended AS (
        SELECT message_id, content, from_agent, to_agent, label, attack_type FROM planted
        UNION ALL SELECT message_id, content, from_agent, to_agent, label, attack_type FROM drawn
    )
    SELECT *, {sql.hash_key("message_id", "42-order")} AS shuffle_key FROM blended""")
def _(spark, sf):
    return selection.blend_sources(planted_turns(spark, sf), _documents_source(spark, sf))


@query("split_ratio", f"""
    WITH ranked AS (
        SELECT doc_id, row_number() OVER (ORDER BY {sql.hash_key("doc_id", "42")}) - 1 AS place,
            (SELECT count(*) FROM documents) AS n FROM documents
    ), sized AS (
        SELECT *, n - CAST(floor(n * 0.15e0) AS BIGINT) AS rest FROM ranked
    )
    SELECT doc_id, CASE WHEN place < floor(rest * 0.7e0) THEN 'train'
        WHEN place < floor(rest * 0.7e0) + floor(rest * 0.15e0) THEN 'validation'
        WHEN place < rest THEN 'unused' ELSE 'test' END AS split
    FROM sized""")
def _(spark, sf):
    return selection.split_ratio(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("split_hashed", f"""
    WITH placed AS (SELECT doc_id, CAST('0x' || substr({sql.hash_key("doc_id", "42")}, 1, 12) AS BIGINT)
        / 281474976710656e0 AS place FROM documents)
    SELECT doc_id, CASE WHEN place < 0.85e0 * 0.7e0 THEN 'train' WHEN place < 0.85e0 * (0.7e0 + 0.15e0) THEN 'validation'
        WHEN place < 0.85e0 THEN 'unused' ELSE 'test' END AS split FROM placed""")
def _(spark, sf):
    return selection.split_hashed(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("dataset_statistics", f"""
    WITH {sql.MESSAGES}, counted AS (
        SELECT 'total' AS kind, 'all' AS value, count(*) AS n FROM planted
        UNION ALL SELECT 'label', CAST(label AS VARCHAR), count(*) FROM planted GROUP BY 2
        UNION ALL SELECT 'attack_type', attack_type, count(*) FROM planted GROUP BY 2
        UNION ALL SELECT 'source', source, count(*) FROM planted GROUP BY 2
    )
    SELECT kind, value, n, {sql.rounded("n * 100e0 / (SELECT count(*) FROM planted)", 4)} AS percent,
        n * 30 // (SELECT count(*) FROM planted) AS bar FROM counted""")
def _(spark, sf):
    return prepare.dataset_statistics(planted(spark, sf)).withColumn(
        "percent", round_to(F.col("percent"), 4)
    )


@query("type_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return prepare.type_histogram(table(spark, sf, "events"), "event_type")


@query("write_dataset", f"""
    WITH {sql.PLANTED_TURNS}
    SELECT message_id, content, from_agent, to_agent, label, attack_type FROM planted""")
def _(spark, sf):
    path = f"{run_folder(spark)}/dataset"
    rows = planted_turns(spark, sf)
    files.write_dataset(rows, path, "csv")
    schema = StructType.fromDDL(
        "message_id string, content string, from_agent string, to_agent string, "
        "label int, attack_type string"
    )
    return files.read_messages(spark, path, "csv", schema)


def _sent(order: str):
    """A time for messages of tables that have none."""
    return F.timestamp_seconds(F.col(order) % 1_000_000_000)


def _in_utc(audit: DataFrame) -> DataFrame:
    utc = F.to_utc_timestamp("ts", F.current_timezone())
    return audit.withColumn("ts", F.date_format(utc, "yyyy-MM-dd HH:mm:ss"))


def _audit_sql(order: str) -> str:
    return f"""
    SELECT strftime(make_timestamp((({order}) % 1000000000) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts,
        message_id, from_agent, to_agent, predicted_type AS attack_type, confidence,
        {sql.preview("content", 120)} AS content_preview
    FROM detected WHERE is_injected"""


@query("write_audit", f"WITH RECURSIVE {sql.DETECTED_TURNS} {_audit_sql('seq')}")
def _(spark, sf):
    path = f"{run_folder(spark)}/audit"
    entries = routing.audit_entries(detected_turns(spark, sf).withColumn("ts", _sent("seq")))
    files.write_audit(entries, path)
    # the files hold UTC without a zone
    rows = spark.read.schema(AUDIT).json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


# -- corpus builder -----------------------------------------------------------

def _ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id")


_KIND_SQL = f"""
    SELECT doc_id, coalesce(({sql.array(fv.ATTACK_TYPES)})[place // quota + 1], 'benign') AS attack_type
    FROM (SELECT doc_id, row_number() OVER (ORDER BY {sql.hash_key("doc_id", "42-quota")}) - 1 AS place,
        CAST(floor((SELECT count(*) FROM documents) * 0.58e0 / 6) AS BIGINT) AS quota FROM documents)"""


@query("class_quota", _KIND_SQL)
def _(spark, sf):
    return corpus.with_quota_by_id(_ids(spark, sf), "doc_id", "42")


def _text_sql(kind: str, seed: str, row_id: str = "doc_id") -> str:
    def one(name, values):
        return sql.pick_one(row_id, f"{seed}-{name}", values)

    def between(name, bounds):
        return f"CAST({sql.pick_between(row_id, f'{seed}-{name}', *bounds)} AS VARCHAR)"

    payload = one("payload", fv.PAYLOADS)
    if kind == "direct_override":
        return sql.filled(one("template", fv.OVERRIDE_TEMPLATES), {"p": payload})
    if kind == "role_play_smuggling":
        return sql.filled(one("template", fv.ROLE_PLAY_TEMPLATES), {"p": payload})
    if kind == "tool_output_injection":
        return sql.filled(
            one("template", fv.TOOL_OUTPUT_TEMPLATES),
            {"benign": one("snippet", fv.TOOL_OUTPUT_SNIPPETS), "p": payload},
        )
    if kind == "indirect_chain_poisoning":
        return sql.filled(
            one("template", fv.CHAIN_TEMPLATES), {"p": payload, "agent": one("agent", fv.AGENTS)}
        )
    if kind == "encoded_payload":
        phrase = one("phrase", fv.ENCODED_SEEDS)
        lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        turned = lower[13:] + lower[:13] + upper[13:] + upper[:13]
        method = sql.pick_number(row_id, f"{seed}-method", 4)
        return f"""({one("prefix", fv.ENCODED_PREFIXES)} || CASE {method}
            WHEN 0 THEN to_base64(encode({phrase}))
            WHEN 1 THEN translate({phrase}, '{lower + upper}', '{turned}')
            WHEN 2 THEN lower(hex(encode({phrase})))
            ELSE translate({phrase}, '{"".join(fv.CONFUSABLES)}', '{"".join(fv.CONFUSABLES.values())}') END)"""
    if kind == "context_flooding":
        repeats = sql.pick_between(row_id, f"{seed}-repeats", *fv.FLOOD_REPEATS)
        padding = f"repeat({one('padding', fv.FLOOD_PADDING)}, {repeats})"
        phrase = one("phrase", fv.FLOOD_INJECTIONS)
        place = sql.pick_number(row_id, f"{seed}-place", 3)
        half = f"(length({padding}) // 2)"
        return f"""(CASE {place} WHEN 0 THEN {phrase} || '. ' || {padding}
            WHEN 1 THEN substr({padding}, 1, {half}) || ' ' || {phrase} || '. ' || substr({padding}, {half} + 1)
            ELSE {padding} || {phrase} || '.' END)"""
    return sql.filled(one("template", fv.BENIGN_TEMPLATES), {
        "task": one("task", fv.BENIGN_TASKS), "result": one("result", fv.BENIGN_RESULTS),
        "source": one("source", fv.BENIGN_SOURCES), "status": one("status", fv.BENIGN_STATUSES),
        "agent": one("agent", fv.BENIGN_AGENTS), "step": between("step", fv.BENIGN_STEP),
        "n": between("n", fv.BENIGN_N),
        "eta": f"({between('eta', fv.BENIGN_ETA_MINUTES)} || ' minutes')",
        "conf": between("conf", fv.BENIGN_CONFIDENCE),
    })


def _generator(name: str, kind: str) -> None:
    @query(name, f"SELECT doc_id, {_text_sql(kind, '7')} AS content FROM documents")
    def _(spark, sf):
        return _ids(spark, sf).select(
            "doc_id", corpus.GENERATORS[kind](F.col("doc_id"), "7").alias("content")
        )


for _name, _kind in [
    ("gen_override", "direct_override"), ("gen_roleplay", "role_play_smuggling"),
    ("gen_tool_output", "tool_output_injection"), ("gen_chain", "indirect_chain_poisoning"),
    ("gen_encoded", "encoded_payload"), ("gen_flood", "context_flooding"), ("gen_benign", fv.BENIGN),
]:
    _generator(_name, _kind)


def _augment_sql(text: str, row_id: str, seed: str) -> str:
    return f"""CASE {sql.pick_number(row_id, f"{seed}-augment", 10)}
        WHEN 0 THEN replace(upper({text}), 'ẞ', 'SS') WHEN 1 THEN lower({text}) WHEN 2 THEN replace({text}, '.', '..')
        WHEN 3 THEN replace({text}, ' ', '  ') WHEN 4 THEN '>>> ' || {text}
        WHEN 5 THEN {text} || ' <<<' WHEN 6 THEN replace({text}, ',', ';')
        WHEN 7 THEN chr(10) || {text} || chr(10) ELSE {text} END"""


@query("augment_text", f"""
    SELECT doc_id, {_augment_sql("text", "doc_id", "9")} AS content FROM documents""")
def _(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id", corpus.augment_text(F.col("text"), F.col("doc_id"), "9").alias("content")
    )


@query("assign_agents", f"SELECT event_id, {sql.agents('event_id', '42')} FROM events")
def _(spark, sf):
    return corpus.with_agents(table(spark, sf, "events").select("event_id"), "event_id", "42")


@query("build_corpus", f"""
    WITH kinds AS ({_KIND_SQL}), drafted AS (
        SELECT doc_id, attack_type, CASE attack_type
            {" ".join(f"WHEN '{k}' THEN {_text_sql(k, f'42-{k}')}" for k in fv.ATTACK_TYPES)}
            ELSE {_text_sql(fv.BENIGN, '42-benign')} END AS draft FROM kinds
    )
    SELECT CAST(doc_id AS VARCHAR) AS message_id,
        CAST('0x' || substr({sql.hash_key("doc_id", "42-order")}, 1, 15) AS BIGINT) AS seq,
        CASE WHEN attack_type = 'benign' THEN draft ELSE {_augment_sql("draft", "doc_id", "42")} END AS content,
        {sql.agents("doc_id", "42")},
        CASE WHEN attack_type = 'benign' THEN 0 ELSE 1 END AS label, attack_type FROM drafted""")
def _(spark, sf):
    return corpus.build_corpus_for_ids(_ids(spark, sf), "doc_id")


# -- rule filter --------------------------------------------------------------

@query("rule_hits", f"""
    WITH {sql.MESSAGES}, {sql.periodic("planted")}
    SELECT message_id, {sql.hit_names("content")} AS hits,
        message_id IN (SELECT message_id FROM repeated) AS periodic_hit FROM planted""")
def _(spark, sf):
    found = rule_filter.find_hits(planted(spark, sf))
    return found.select("message_id", F.array_join("rule_hits", ",").alias("hits"), "periodic_hit")


@query("rule_hits_pages", f"""
    WITH sent AS (SELECT CAST(page_id AS VARCHAR) AS message_id, page_id, html AS content FROM pages),
    {sql.periodic("sent")}
    SELECT page_id, {sql.hit_names("content")} AS hits, {sql.decode_hit("content")} AS decode_hit,
        message_id IN (SELECT message_id FROM repeated) AS periodic_hit
    FROM sent""")
def _(spark, sf):
    found = rule_filter.find_hits(texts(spark, sf, "pages"), "html")
    return found.select(
        "page_id", F.array_join("rule_hits", ",").alias("hits"), "decode_hit", "periodic_hit"
    )


@query("periodic_repeat", f"""
    WITH {sql.MESSAGES}, {sql.periodic("planted")}
    SELECT message_id, message_id IN (SELECT message_id FROM repeated) AS periodic_hit FROM planted""")
def _(spark, sf):
    return planted(spark, sf).select(
        "message_id", repetition.periodic_repeat(F.col("content")).alias("periodic_hit")
    )


@query("decode_scan", f"""
    WITH {sql.MESSAGES} SELECT message_id, {sql.decode_hit()} AS decode_hit FROM planted""")
def _(spark, sf):
    return planted(spark, sf).select(
        "message_id", decoding.decode_scan(F.col("content")).alias("decode_hit")
    )


@query("lexical_diversity", f"""
    WITH {sql.MESSAGES} SELECT message_id, {sql.low_diversity()} AS low_diversity_hit FROM planted""")
def _(spark, sf):
    counted = planted(spark, sf).select(
        "message_id", repetition.flood_words(F.col("content")).alias("tokens")
    )
    return counted.select(
        "message_id", repetition.low_diversity(F.col("tokens")).alias("low_diversity_hit")
    )


_RULES_SQL = f"WITH {sql.MESSAGES}, {sql.rules()} "


@query("rule_score", _RULES_SQL + f"""
    SELECT message_id, {", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in sql.COUNTS)},
        CAST(rule_total AS INTEGER) AS rule_total, rule_score FROM scored""")
def _(spark, sf):
    return rule_filter.score_rules(planted(spark, sf)).select(
        "message_id", *rule_filter.COUNT_COLUMNS, "rule_total", "rule_score"
    )


@query("rule_type", _RULES_SQL + "SELECT message_id, rule_type FROM scored")
def _(spark, sf):
    return rule_filter.score_rules(planted(spark, sf)).select("message_id", "rule_type")


@query("rule_label", _RULES_SQL + """
    SELECT rule_type, rule_label, count(*) AS n FROM scored GROUP BY 1, 2""")
def _(spark, sf):
    scored = rule_filter.score_rules(planted(spark, sf))
    return scored.groupBy("rule_type", "rule_label").agg(F.count("*").alias("n"))


@query("keyword_filter", f"""
    WITH {sql.MESSAGES}
    SELECT message_id, CAST({sql.keyword_hits()} > 0 AS INTEGER) AS keyword_label FROM planted""")
def _(spark, sf):
    return planted(spark, sf).select(
        "message_id", tx.contains_keyword(F.col("content")).cast("int").alias("keyword_label")
    )


# -- intent drift -------------------------------------------------------------

@query("intent_vector", f"""
    SELECT i, {sql.rounded("avg(v)", 6)} AS value FROM (
        SELECT unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(0, len(embedding))) AS i
        FROM embeddings WHERE label = 0) GROUP BY i""")
def _(spark, sf):
    mean = drift.centroid(table(spark, sf, "embeddings").where("label = 0"))
    return mean.select(F.posexplode("intent").alias("p", "value")).select(
        F.col("p").cast("bigint").alias("i"), round_to(F.col("value"), 6).alias("value")
    )


@query("embed_text")
def _(spark, sf):
    messages = conversation_messages(texts(spark, sf, "conversations"))
    return drift.embed_text(messages).select("message_id", "embedding")


_DRIFT_SQL = f"""WITH {sql.INTENT}, drifted AS (
    SELECT vec_id, {sql.drift("embedding")} AS drift_score FROM embeddings)"""


@query("drift_score", f"{_DRIFT_SQL} SELECT vec_id, drift_score FROM drifted")
def _(spark, sf):
    scored = drift.score_drift(table(spark, sf, "embeddings"), intent(spark, sf))
    return scored.select("vec_id", "drift_score")


@query("drift_label", f"""{_DRIFT_SQL}
    SELECT vec_id, CAST(drift_score >= 0.6e0 AS INTEGER) AS drift_label FROM drifted""")
def _(spark, sf):
    scored = drift.score_drift(table(spark, sf, "embeddings"), intent(spark, sf))
    return scored.select("vec_id", "drift_label")


# -- cascade ------------------------------------------------------------------

_HANDOFF = f"WITH RECURSIVE {sql.HANDOFF}, "


@query("edge_aggregate", f"""
    WITH {sql.HANDOFF}
    SELECT from_agent AS src, to_agent AS dst, count(*) AS cnt,
        {sql.rounded("sum(base_suspicion)", 4)} AS suspicion_total, min(seq) AS first_seen
    FROM handoff GROUP BY 1, 2""")
def _(spark, sf):
    return graph.edge_aggregate(handoff(spark, sf), suspicion="base_suspicion").withColumn(
        "suspicion_total", round_to(F.col("suspicion_total"), 4)
    )


@query("reachable_agents", _HANDOFF + sql.closure("handoff") + """
    SELECT src, dst, first_seen FROM pairs""")
def _(spark, sf):
    return graph.reachable_pairs(graph.edge_aggregate(handoff(spark, sf)))


_DENSE = f"WITH RECURSIVE {sql.TRADE}, " + """
edges AS (SELECT DISTINCT from_agent AS src, to_agent AS dst FROM trade),
agents AS (SELECT src AS agent FROM edges UNION SELECT dst FROM edges),
walks AS (
    SELECT src, dst FROM edges WHERE src <> dst
    UNION
    SELECT w.src, e.dst FROM walks w JOIN edges e ON w.dst = e.src WHERE w.src <> e.dst
) """


@query("reachable_agents_dense", _DENSE + "SELECT src, dst FROM walks")
def _(spark, sf):
    return graph.reachable_pairs(graph.edge_aggregate(trade(spark, sf))).select("src", "dst")


@query("cascade_potential", _HANDOFF + sql.closure("handoff") + f"""
    SELECT agent, count(src) AS reached,
        {sql.rounded("count(src) / CAST((SELECT count(*) FROM agents) - 1 AS DOUBLE)", 4)} AS cascade_potential
    FROM agents LEFT JOIN pairs ON src = agent GROUP BY agent""")
def _(spark, sf):
    edges = cut_lineage(graph.edge_aggregate(handoff(spark, sf)))
    return graph.cascade_potential(edges).withColumn(
        "cascade_potential", round_to(F.col("cascade_potential"), 4)
    )


@query("downstream_list", _DENSE + """
    SELECT src AS agent, array_to_string(list(dst ORDER BY dst), ',') AS downstream_agents
    FROM walks GROUP BY src""")
def _(spark, sf):
    pairs = graph.reachable_pairs(graph.edge_aggregate(trade(spark, sf)))
    return graph.downstream_list(pairs).withColumn(
        "downstream_agents", F.array_join("downstream_agents", ",")
    )


@query("agent_components", _DENSE + """
    , mutual AS (SELECT a.src AS agent, a.dst AS other FROM walks a JOIN walks b ON a.src = b.dst AND a.dst = b.src)
    SELECT agent, least(agent, coalesce((SELECT min(other) FROM mutual m WHERE m.agent = agents.agent), agent)) AS component
    FROM agents""")
def _(spark, sf):
    return reach.components(graph.edge_aggregate(trade(spark, sf)))


# the sketches of the exact closure, with the same registers
_REACH_SQL = _HANDOFF + sql.closure("handoff") + f""",
members AS (SELECT src AS agent, dst AS other FROM pairs UNION SELECT agent, agent FROM agents),
places AS (SELECT agent AS other, {sql.pick_number("agent", "reach", 256)} AS register,
        CAST('0x' || substr({sql.hash_key("agent", "reach")}, 13, 12) AS BIGINT) AS rest FROM agents),
ranks AS (SELECT agent, register, max(CASE WHEN rest = 0 THEN 49 ELSE 49 - length(bin(rest)) END) AS rank
        FROM members JOIN places USING (other) GROUP BY agent, register),
sums AS (SELECT agent, sum(pow(2e0, -rank)) AS powers, count(*) AS filled, 1 - count(*) / 256e0 AS empty
        FROM ranks GROUP BY agent),
estimates AS (SELECT agent, filled, 65536 / (2 * ln(2e0)) / (powers + 256 * (empty +
        {" + ".join(f"pow(empty, {float(2 ** k)}) * {2.0 ** (k - 1)}" for k in range(1, 15))})) AS n FROM sums),
sizes AS (SELECT a.agent, 1 + count(p.src) AS size FROM agents a
        LEFT JOIN pairs q ON q.src = a.agent LEFT JOIN pairs p ON p.src = q.dst AND p.dst = a.agent GROUP BY a.agent),
counted AS (SELECT agent, CASE WHEN agent NOT IN (SELECT src FROM pairs) THEN 0e0
        ELSE least(greatest(n - 1, size - 1, 1), (SELECT count(*) - 1 FROM agents)) END AS reached
        FROM estimates JOIN sizes USING (agent))
SELECT agent, {sql.rounded("reached", 4)} AS reached,
    {sql.rounded("CASE WHEN (SELECT count(*) FROM agents) > 1 THEN reached / (SELECT count(*) - 1 FROM agents) ELSE 0e0 END", 4)}
        AS cascade_potential FROM counted"""


@query("cascade_potential_estimate", _REACH_SQL)
def _(spark, sf):
    found = reach.reach_estimates(graph.edge_aggregate(handoff(spark, sf)), registers=256)
    return found.select("agent", *[round_to(F.col(c), 4).alias(c) for c in ("reached", "cascade_potential")])


def _handoff_context(spark, sf):
    return senders.cascade_context(handoff(spark, sf))


@query("cascade_potential_asof", _HANDOFF + sql.cascade("handoff") + f"""
    SELECT message_id, {sql.rounded("cascade_potential", 4)} AS cascade_potential FROM placed""")
def _(spark, sf):
    return _handoff_context(spark, sf).select(
        "message_id", round_to(F.col("cascade_potential"), 4).alias("cascade_potential")
    )


@query("suspicion_history", f"""
    WITH {sql.HANDOFF}
    SELECT message_id, {sql.rounded('''avg(base_suspicion) OVER (PARTITION BY from_agent ORDER BY seq
        ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)''', 4)} AS suspicion_history FROM handoff""")
def _(spark, sf):
    return senders.suspicion_history(handoff(spark, sf)).select(
        "message_id", round_to(F.col("suspicion_history"), 4).alias("suspicion_history")
    )


@query("cascade_risk", _HANDOFF + sql.cascade("handoff") + f"""
    SELECT message_id, {sql.rounded("cascade_risk", 4)} AS cascade_risk FROM placed""")
def _(spark, sf):
    return _handoff_context(spark, sf).select(
        "message_id", round_to(F.col("cascade_risk"), 4).alias("cascade_risk")
    )


@query("high_risk", _HANDOFF + sql.cascade("handoff") + """
    SELECT from_agent, count(*) AS n, count(*) FILTER (WHERE cascade_risk >= 0.55e0) AS high_risk
    FROM placed GROUP BY from_agent""")
def _(spark, sf):
    return _handoff_context(spark, sf).groupBy("from_agent").agg(
        F.count("*").alias("n"), F.count_if("high_risk").alias("high_risk")
    )


@query("agent_suspicion", f"""
    WITH {sql.HANDOFF}
    SELECT from_agent AS agent, {sql.rounded("avg(base_suspicion)", 4)} AS suspicion FROM (
        SELECT *, row_number() OVER (PARTITION BY from_agent ORDER BY seq DESC) AS place FROM handoff)
    WHERE place <= 10 GROUP BY 1""")
def _(spark, sf):
    return senders.agent_suspicion(handoff(spark, sf)).withColumn(
        "suspicion", round_to(F.col("suspicion"), 4)
    )


# -- text classifier ----------------------------------------------------------

_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
_NGRAMS = f"""tokens AS (SELECT doc_id, {_TERMS} AS t FROM documents), grams AS (
    SELECT doc_id, list_concat(t, list_concat(
        list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]),
        list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])
    )) AS g FROM tokens)"""


@query("word_ngrams", f"""
    WITH {_NGRAMS} SELECT doc_id, len(g) AS n, md5(array_to_string(g, '|')) AS digest FROM grams""")
def _(spark, sf):
    grams = text_model.word_ngrams(texts(spark, sf, "documents"), "text")
    return grams.select(
        "doc_id", F.size("ngrams").cast("bigint").alias("n"),
        F.md5(F.array_join("ngrams", "|").cast("binary")).alias("digest"),
    )


@query("tfidf", f"""
    WITH {_NGRAMS}, counted AS (
        SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM grams)
        GROUP BY 1, 2
    ), vocabulary AS (
        SELECT term, ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + count(*))) + 1e0 AS idf
        FROM counted GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 30000
    ), weighted AS (
        SELECT doc_id, term, (ln(tf) + 1e0) * idf AS raw FROM counted JOIN vocabulary USING (term)
    )
    SELECT doc_id, term, {sql.rounded("raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id))", 6)} AS weight
    FROM weighted""")
def _(spark, sf):
    weights = text_model.tfidf(texts(spark, sf, "documents"), "doc_id", "text")
    return weights.withColumn("weight", round_to(F.col("weight"), 6))


@query("class_weights", """
    SELECT quality AS label, count(*) AS n,
        (SELECT count(*) FROM labels) / (2e0 * count(*)) AS weight FROM labels GROUP BY quality""")
def _(spark, sf):
    return text_model.class_weights(table(spark, sf, "labels").withColumnRenamed("quality", "label"))


@query("truncate_tokens", """
    SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:256], ' ')
        AS content FROM documents""")
def _(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id", tx.truncate_tokens(F.col("text")).alias("content")
    )


_WORDS_SQL = "list_filter(string_split_regex(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]+'), lambda x: x <> '')"


@query("truncate_pieces", f"""
    WITH RECURSIVE split AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
    counted AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM split) GROUP BY word),
    parts AS (SELECT n, a, substr(word, a, k) AS part FROM (
        SELECT word, n, unnest(range(1, length(word) + 1)) AS a FROM counted), (VALUES (1), (2), (3)) lengths(k)),
    sums AS (SELECT CASE WHEN a = 1 THEN part ELSE '##' || part END AS piece, length(part) = 1 AS single, sum(n) AS n
        FROM parts GROUP BY 1, 2),
    vocabulary AS (SELECT piece FROM (SELECT piece FROM sums WHERE NOT single ORDER BY n DESC, piece LIMIT 2000)
        UNION SELECT piece FROM sums WHERE single),
    steps(word, pos, pieces) AS (
        SELECT word, 0, CAST([] AS VARCHAR[]) FROM counted
        UNION ALL
        SELECT word, pos + k, list_append(pieces, piece) FROM (
            SELECT word, pos, pieces, k, piece, max(k) OVER (PARTITION BY word, pos) AS most
            FROM steps, (VALUES (1), (2), (3)) lengths(k) JOIN vocabulary
            ON piece = (CASE WHEN pos = 0 THEN '' ELSE '##' END) || substr(word, pos + 1, k)
            WHERE pos + k <= length(word)) WHERE k = most),
    cut AS (SELECT word, pieces FROM steps WHERE pos = length(word)),
    placed AS (SELECT doc_id, unnest(w[1:254]) AS word, generate_subscripts(w[1:254], 1) AS place FROM split)
    SELECT split.doc_id, coalesce(replace(array_to_string(flatten(list(pieces ORDER BY place))[1:254], ' '), ' ##', ''), '') AS content
    FROM split LEFT JOIN placed ON split.doc_id = placed.doc_id LEFT JOIN cut USING (word) GROUP BY split.doc_id""")
def _(spark, sf):
    """The first 254 word pieces, over a vocabulary of the documents themselves."""
    docs = texts(spark, sf, "documents")
    vocabulary = vocabulary_from_table(frequent_pieces(docs, "text", 2000))
    return docs.select("doc_id", truncate_pieces(F.col("text"), vocabulary).alias("content"))


def labelled_corpus(spark, sf) -> dict[str, DataFrame]:
    """Labelled documents as messages, attacks being the toxic ones, by split part."""
    rows = _documents_source(spark, sf).withColumn(  # documents come in the order of their ids
        "seq", F.substring_index("message_id", ":", -1).cast("bigint"))
    stored = cut_lineage(selection.split_ratio(rows))
    return {part: stored.where(F.col("split") == part).drop("split")
            for part in ["train", "validation", "test"]}


@query("fit_logistic")
def _(spark, sf):
    model = text_model.fit_logistic(labelled_corpus(spark, sf)["train"])
    last = model.stages[-1]
    return spark.range(1).select(
        F.lit(len(model.stages[4].vocabulary)).alias("terms"),
        F.lit(float(last.intercept)).alias("intercept"),
        F.lit(int(last.numFeatures)).alias("features"),
    )


@query("score_classifier")
def _(spark, sf):
    parts = labelled_corpus(spark, sf)
    model = text_model.fit_logistic(parts["train"])
    return text_model.score_classifier(parts["test"], model).select(
        "message_id", "label", "classifier_score", "classifier_label", "classifier_argmax"
    )


@query("select_model")
def _(spark, sf):
    parts = labelled_corpus(spark, sf)
    _, report = text_model.select_model(parts["train"], parts["validation"], [0.1, 1.0, 10.0])
    return spark.createDataFrame(report)


@query("save_and_load_model")
def _(spark, sf):
    parts = labelled_corpus(spark, sf)
    model = text_model.fit_logistic(parts["train"])
    path = f"{run_folder(spark)}/model"
    text_model.save_model(model, path)
    again = text_model.score_classifier(parts["test"], text_model.load_model(path))
    return again.select("message_id", "classifier_score")


# -- fusion and routing -------------------------------------------------------

_DETECTED = f"WITH RECURSIVE {sql.DETECTED} "
_DETECTED_TURNS = f"WITH RECURSIVE {sql.DETECTED_TURNS} "


@query("base_suspicion", _DETECTED + f"""
    SELECT message_id, {sql.rounded("base_suspicion", 6)} AS base_suspicion FROM detected""")
def _(spark, sf):
    scored = score_texts(planted(spark, sf), document_layers(spark, sf))
    return scored.select("message_id", round_to(F.col("base_suspicion"), 6).alias("base_suspicion"))


@query("ensemble", _DETECTED + "SELECT message_id, confidence, is_injected FROM detected")
def _(spark, sf):
    return detected(spark, sf).select("message_id", "confidence", "is_injected")


@query("predicted_type", _DETECTED + "SELECT message_id, predicted_type FROM detected")
def _(spark, sf):
    return detected(spark, sf).select("message_id", "predicted_type")


@query("explain_decision", _DETECTED + "SELECT message_id, explanation FROM detected")
def _(spark, sf):
    return detected(spark, sf).select("message_id", "explanation")


_DETECT_COLUMNS = [
    "message_id", "from_agent", "to_agent", "rule_score", "rule_type", "classifier_score",
    "drift_score", "base_suspicion", "suspicion_history", "cascade_potential", "cascade_score",
    "high_risk", "confidence", "is_injected", "predicted_type", "explanation",
]
_DETECT_SQL = ", ".join(
    f"{sql.rounded(c, 4)} AS {c}" if c in ROUNDED else c for c in _DETECT_COLUMNS
)


@query("detect", _DETECTED + f"SELECT {_DETECT_SQL} FROM detected")
def _(spark, sf):
    return detected(spark, sf).select(*_DETECT_COLUMNS)


@query("route", _DETECTED_TURNS + """
    SELECT message_id, CASE WHEN is_injected THEN 'quarantine' ELSE 'pass' END AS lane FROM detected""")
def _(spark, sf):
    passed, held = routing.route(cut_lineage(detected_turns(spark, sf).select("message_id", "quarantined")))
    return passed.select("message_id", F.lit("pass").alias("lane")).unionByName(
        held.select("message_id", F.lit("quarantine").alias("lane"))
    )


@query("audit_entries", _DETECTED + _audit_sql("seq"))
def _(spark, sf):
    return _in_utc(routing.audit_entries(detected(spark, sf).withColumn("ts", _sent("seq"))))


@query("quarantine_summary", _DETECTED + """
    SELECT predicted_type, count(*) AS n FROM detected WHERE is_injected GROUP BY 1
    UNION ALL SELECT 'total', count(*) FROM detected WHERE is_injected""")
def _(spark, sf):
    return routing.quarantine_summary(detected(spark, sf))


@query("recent_quarantined", _DETECTED + """
    SELECT message_id, seq, confidence FROM detected WHERE is_injected ORDER BY seq DESC LIMIT 10""")
def _(spark, sf):
    return routing.recent_quarantined(detected(spark, sf)).select("message_id", "seq", "confidence")


@query("run_stats", _DETECTED + """
    SELECT count(*) AS total, count(*) FILTER (WHERE is_injected) AS flagged,
        count(*) FILTER (WHERE is_injected) AS quarantined FROM detected""")
def _(spark, sf):
    return routing.run_stats(detected(spark, sf))


_ALERT = f"""'[ALERT] Injection blocked.' || chr(10) || 'Attack type : ' || predicted_type || chr(10)
    || 'Confidence  : ' || printf('%.2f', {sql.rounded("confidence * 100e0", 2)}) || '%' || chr(10)
    || 'Reason      : ' || explanation"""


@query("observed_stats", SQL["run_stats"])
def _(spark, sf):
    """The counters of a run, taken while its detections are written."""
    watched, counters = routing.observed_stats(detected(spark, sf))
    watched.write.parquet(f"{run_folder(spark)}/detections")
    return routing.stats_row(spark, counters)


@query("guard_last_message", f"WITH RECURSIVE {sql.DETECTED_NEWEST}" + f"""
    SELECT conv_id, message_id, is_injected AND length(content) > 0 AS blocked,
        CASE WHEN is_injected AND length(content) > 0 THEN {_ALERT} END AS reply
    FROM detected""")
def _(spark, sf):
    """Only the newest message of each conversation is screened at all."""
    messages = conversation_messages(texts(spark, sf, "conversations"))
    newest = plant(routing.newest_messages(messages, "conv_id", "turn"), "seq", "content")
    found = detect(newest, Layers(drift=constant_drift()), keep=_without_text(newest))
    return routing.guard_last_message(found)


@query("log_view", _DETECTED + f"""
    SELECT step, sender, receiver, status, attack_pred, confidence, content FROM (
        SELECT seq AS step, from_agent AS sender, to_agent AS receiver, 'BLOCKED' AS status,
            predicted_type AS attack_pred, confidence, {sql.preview("content", 120)} AS content
        FROM detected WHERE is_injected ORDER BY seq DESC LIMIT {fv.LOG_VIEW_LENGTH})""")
def _(spark, sf):
    """The newest 20 quarantined messages, as a log shows them."""
    held = detected(spark, sf).where("quarantined")
    return routing.result_view(held, count=fv.LOG_VIEW_LENGTH)


@query("halt_downstream", _DETECTED_TURNS + """
    , stopped AS (
        SELECT *, min(turn) FILTER (WHERE is_injected) OVER (PARTITION BY conv_id) AS stop FROM detected
    )
    SELECT conv_id, turn, message_id, turn = stop AND stop IS NOT NULL AS blocked,
        CASE WHEN turn = stop THEN predicted_type END AS attack_type,
        CASE WHEN turn = stop THEN confidence END AS confidence,
        CASE WHEN turn = stop THEN explanation END AS explanation
    FROM stopped WHERE stop IS NULL OR turn <= stop""")
def _(spark, sf):
    kept = routing.halt_downstream(cut_lineage(detected_turns(spark, sf)), "conv_id", "turn")
    return kept.select(
        "conv_id", "turn", "message_id", F.col("alert").isNotNull().alias("blocked"),
        "alert.attack_type", "alert.confidence", "alert.explanation",
    )


@query("result_view", _DETECTED_TURNS + f"""
    SELECT seq AS step, from_agent AS sender, to_agent AS receiver,
        CASE WHEN is_injected THEN 'BLOCKED' ELSE 'PASSED' END AS status,
        predicted_type AS attack_pred, confidence, {sql.preview("content", 80)} AS content
    FROM detected""")
def _(spark, sf):
    return routing.result_view(detected_turns(spark, sf))


# -- evaluation ---------------------------------------------------------------

def _quality(spark, sf):
    labels = table(spark, sf, "labels")
    lengths = table(spark, sf, "documents").select("doc_id", "n_chars")
    return labels.join(lengths, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"),
        F.col("n_chars").alias("score"), (F.col("n_chars") % 50).alias("tied"),
    )


_QUALITY = """quality AS (
    SELECT doc_id, quality AS label, toxic AS prediction, n_chars AS score, n_chars % 50 AS tied
    FROM labels JOIN documents USING (doc_id))"""


@query("confusion_matrix", f"WITH {_QUALITY} SELECT {sql.cells('label', 'prediction')} FROM quality")
def _(spark, sf):
    return metrics.confusion_matrix(_quality(spark, sf))


@query("classification_metrics", f"""
    WITH {_QUALITY} SELECT {sql.METRICS} FROM (SELECT {sql.cells('label', 'prediction')} FROM quality)""")
def _(spark, sf):
    return metrics.classification_metrics(_quality(spark, sf))


@query("auc_roc", f"""
    WITH {_QUALITY}, scores AS (
        SELECT 'n_chars' AS kind, label, score FROM quality UNION ALL SELECT 'tied', label, tied FROM quality
    ) SELECT kind, {sql.rounded("auc", 6)} AS auc FROM ({sql.auc_by("kind", "scores")})""")
def _(spark, sf):
    rows = _quality(spark, sf).unpivot(
        ["doc_id", "label"], ["score", "tied"], "kind", "value"
    ).withColumn("kind", F.when(F.col("kind") == "score", "n_chars").otherwise("tied"))
    return metrics.auc_roc(rows, ["kind"], score="value").withColumn(
        "auc", round_to(F.col("auc"), 6)
    )


@query("roc_points", f"""
    WITH {_QUALITY}, counted AS (
        SELECT tied AS score, count(*) FILTER (WHERE label = 1) AS pos,
            count(*) FILTER (WHERE label = 0) AS neg FROM quality GROUP BY 1
    )
    SELECT CAST(score AS DOUBLE) AS threshold,
        {sql.rounded("sum(neg) OVER (ORDER BY score DESC) / CAST(sum(neg) OVER () AS DOUBLE)", 6)} AS fpr,
        {sql.rounded("sum(pos) OVER (ORDER BY score DESC) / CAST(sum(pos) OVER () AS DOUBLE)", 6)} AS tpr
    FROM counted UNION ALL SELECT NULL, 0e0, 0e0""")
def _(spark, sf):
    points = metrics.roc_points(_quality(spark, sf), score="tied")
    return points.select(
        "threshold", round_to(F.col("fpr"), 6).alias("fpr"), round_to(F.col("tpr"), 6).alias("tpr")
    )


def _system_sql(systems: dict[str, tuple[str, str | None]], source: str = "judged") -> str:
    rows = " UNION ALL ".join(
        f"SELECT {sql.quote(name)} AS system, attack_type, label, CAST({p} AS INTEGER) AS prediction, "
        f"{f'CAST({s} AS DOUBLE)' if s else '0e0'} AS score FROM {source}"
        for name, (p, s) in systems.items()
    )
    return f"""verdicts AS MATERIALIZED ({rows}),
    areas AS ({sql.auc_by("system", "verdicts")}),
    measured AS (
        SELECT system, {sql.METRICS}, {sql.rounded("auc", 4)} AS auc_roc FROM (
            SELECT system, {sql.cells("label", "prediction")} FROM verdicts GROUP BY system
        ) JOIN areas USING (system)
    )"""


_JUDGED = """judged AS MATERIALIZED (
    SELECT *, CAST(drift_score >= 0.6e0 AS INTEGER) AS drift_label,
        CAST(classifier_score >= 0.65e0 AS INTEGER) AS classifier_label,
        CAST(is_injected AS INTEGER) AS full_label, 0 AS none_label,
        CAST(classifier_score > 0 AS INTEGER) AS keyword_label FROM detected)"""


@query("ablation", f"""WITH RECURSIVE {sql.DETECTED}, {_JUDGED},
    {_system_sql(evaluate.LAYER_COLUMNS)} SELECT * FROM measured""")
def _(spark, sf):
    return evaluate.ablation(detected(spark, sf, None))


@query("metrics_by_type", f"""WITH RECURSIVE {sql.DETECTED}, {_JUDGED}
    SELECT attack_type, {sql.METRICS}, 0e0 AS auc_roc FROM (
        SELECT attack_type, {sql.cells("label", "full_label")} FROM judged
        GROUP BY attack_type HAVING count(*) >= 2)""")
def _(spark, sf):
    return evaluate.evaluation_by_type(detected(spark, sf, None))


_SIMPLE_SYSTEMS = {
    "B0: No Protection": ("none_label", None),
    "B1: Keyword Filter": ("keyword_label", "keyword_label"),
    "B3: Rules Only": ("rule_label", "rule_score"),
    "B4: Classifier Only": ("classifier_label", "classifier_score"),
    "B5: Full System": ("full_label", "confidence"),
}
_COMPARED = f"""WITH RECURSIVE {sql.DETECTED}, {_JUDGED}, {_system_sql(_SIMPLE_SYSTEMS)},
    compared AS (SELECT * REPLACE (CASE WHEN system = 'B0: No Protection' THEN 0e0 ELSE auc_roc END
        AS auc_roc) FROM measured) """


#: The same with the regression, whose text_label and text_score stand in ``regressed``.
_COMPARED_ALL = f"""WITH RECURSIVE {sql.DETECTED}, {_JUDGED}, {sql.held_out_scores("planted")},
    rated AS (SELECT * FROM judged JOIN regressed USING (message_id)),
    {_system_sql({**_SIMPLE_SYSTEMS, "B2: TF-IDF + LR": ("text_label", "text_score")}, "rated")},
    compared AS (SELECT * REPLACE (CASE WHEN system = 'B0: No Protection' THEN 0e0 ELSE auc_roc END
        AS auc_roc) FROM measured) """


def _comparison(spark, sf, held_out=False):
    return evaluate.baseline_comparison(
        planted(spark, sf), layers=document_layers(spark, sf), held_out=held_out
    )


@query("baseline_comparison", _COMPARED_ALL + "SELECT * FROM compared")
def _(spark, sf):
    """All six systems on all messages; the regression is fitted half by half."""
    return _comparison(spark, sf, held_out=True)


@query("baseline_comparison_trained")
def _(spark, sf):
    """All six systems, with both trained classifiers, on held-out messages."""
    parts = labelled_corpus(spark, sf)
    model = text_model.fit_logistic(parts["train"])
    layers = Layers(classifier=classifier_from_model(model), drift=drift_from_text(fv.INTENT_TEXT))
    return evaluate.baseline_comparison(parts["test"], layers=layers, text_model=model)


@query("improvement", _COMPARED + f"""
    SELECT c.system, {sql.rounded("f.f1 - c.f1", 4)} AS delta_f1,
        {sql.rounded("f.auc_roc - c.auc_roc", 4)} AS delta_auc,
        {sql.rounded("c.fpr - f.fpr", 4)} AS delta_fpr
    FROM compared c JOIN compared f ON f.system = 'B5: Full System' WHERE c.system <> 'B5: Full System'""")
def _(spark, sf):
    return metrics.improvement(cut_lineage(_comparison(spark, sf)), "B5: Full System")


@query("metric_report", _COMPARED + """
    UNPIVOT (SELECT system, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall,
        CAST(f1 AS DOUBLE) AS f1, CAST(accuracy AS DOUBLE) AS accuracy, CAST(fpr AS DOUBLE) AS fpr,
        CAST(auc_roc AS DOUBLE) AS auc_roc, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp,
        CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn,
        CAST(tp + fp + fn + tn AS DOUBLE) AS total FROM compared)
    ON COLUMNS(* EXCLUDE (system)) INTO NAME metric VALUE value""")
def _(spark, sf):
    return metrics.metric_report(_comparison(spark, sf))


@query("score_distribution", f"""
    SELECT {sql.rounded("avg(value)", 2)} AS mean, {sql.rounded("quantile_cont(value, 0.5)", 2)} AS median,
        {sql.rounded("quantile_cont(value, 0.95)", 2)} AS p95 FROM events""")
def _(spark, sf):
    return metrics.score_distribution(table(spark, sf, "events"), "value")


@query("approx_distribution", """
    SELECT event_type, count(*) AS n, true AS median_within, true AS p95_within FROM events GROUP BY event_type""")
def _(spark, sf):
    """Sketched quantiles, and whether their exact ranks are within 2 % of all rows."""
    rows = table(spark, sf, "events")
    found = metrics.approx_distribution(rows, "value", ["event_type"]).select(
        F.col("event_type").alias("_type"), "median", "p95")
    ranked = rows.join(F.broadcast(found), F.col("event_type") == F.col("_type"))
    n = F.count("*")

    def within(name, share):
        low, high = F.count_if(F.col("value") < F.col(name)) / n, F.count_if(F.col("value") <= F.col(name)) / n
        return ((low - 0.02 <= share) & (share <= high + 0.02)).alias(f"{name}_within")

    return ranked.groupBy("event_type").agg(n.alias("n"), within("median", F.lit(0.5)), within("p95", F.lit(0.95)))


@query("histogram", """
    SELECT CAST(least(40, floor((value - low) / (high - low) * 40) + 1) AS INTEGER) AS bin, count(*) AS n
    FROM events, (SELECT min(value) AS low, max(value) AS high FROM events) GROUP BY 1""")
def _(spark, sf):
    return metrics.histogram(table(spark, sf, "events"), "value")


@query("quarantine_rate", f"""
    WITH {sql.HANDOFF}
    SELECT date_trunc('hour', ts) AS window_start, event_type AS predicted_type, count(*) AS n,
        count(*) FILTER (WHERE base_suspicion >= 0.5e0) AS quarantined FROM handoff GROUP BY 1, 2""")
def _(spark, sf):
    rows = handoff(spark, sf).select(
        "ts", F.col("event_type").alias("predicted_type"),
        (F.col("base_suspicion") >= 0.5).alias("quarantined"),
    )
    return routing.quarantine_rate(rows)


# -- exchangeable parts -------------------------------------------------------

@query("custom_layers", _HANDOFF.replace("WITH RECURSIVE", "WITH").rstrip(", ") + """
    SELECT message_id, base_suspicion >= 0.65e0 AS flagged FROM handoff""")
def _(spark, sf):
    """A classifier layer made of any column expression."""
    layer = classifier_from_column(F.col("base_suspicion"))
    scored = layer(handoff(spark, sf), DEFAULT)
    return scored.select(
        "message_id", (F.col("classifier_score") >= DEFAULT.thresholds.classifier).alias("flagged")
    )


@query("custom_rules", f"""
    WITH sent AS (SELECT CAST(doc_id AS VARCHAR) AS message_id, doc_id, text AS content FROM documents),
    {sql.periodic("sent")}
    SELECT doc_id, CAST(CASE WHEN regexp_matches(content, '\\b(dan|jailbreak)\\b', 'i') THEN 1 ELSE 0 END AS INTEGER) AS total,
        message_id IN (SELECT message_id FROM repeated) AS periodic_hit FROM sent""")
def _(spark, sf):
    """A rule set read from a table: the persona rule with word boundaries."""
    rows = spark.createDataFrame(
        [("persona_word", "role_play_smuggling", r"\b(dan|jailbreak)\b")],
        "name string, attack_type string, pattern string",
    )
    found = rule_filter.find_hits(texts(spark, sf, "documents"), "text", rules_from_table(rows))
    return found.select("doc_id", F.size("rule_hits").alias("total"), "periodic_hit")


# -- streaming ----------------------------------------------------------------

def _arrivals(spark, sf, name, place, start, pieces=3):
    """The table's rows in files that arrive piece by piece.

    ``start`` starts a stream over the folder, which reads what is there and stops; it
    is started again, from its checkpoint, for each piece, a micro-batch of many files.
    """
    rows = table(spark, sf, name)
    folder = f"{run_folder(spark)}/{name}"
    for piece in range(pieces):
        rows.where(f"{place} = {piece}").write.mode("append").parquet(folder)
        start(files.stream_messages(spark, folder, rows.schema)).awaitTermination()


# conversations overlap in time: everybody's first turns come first, then their next
_TURN_PLACE = "least(turn div 3, 2)"
# most events come after one with a larger number
_EVENT_PLACE = "event_id % 3"


def turn_stream(rows: DataFrame) -> DataFrame:
    """Planted conversation turns; users and systems speak to the assistant."""
    placed = rows.withColumn("seq", turn_order(F.col("conv_id"), F.col("turn")))
    planted_rows = plant(placed, "seq", "text")
    return planted_rows.select(
        F.concat_ws(":", "conv_id", "turn").alias("message_id"), "seq", "content",
        F.col("role").alias("from_agent"),
        F.when(F.col("role") == "assistant", "user").otherwise("assistant").alias("to_agent"),
        "label", "attack_type", _sent("seq").alias("ts"),
    )


_TURN_STREAM = "turns AS MATERIALIZED (" + f"""
    SELECT format('{{}}:{{}}', conv_id, turn) AS message_id, (conv_id << 32) | turn AS seq, text,
        (least(turn // 3, 2) << 58) | (conv_id << 32) | turn AS arrival,
        role AS from_agent, CASE WHEN role = 'assistant' THEN 'user' ELSE 'assistant' END AS to_agent
    FROM conversations
), planted AS MATERIALIZED (
    SELECT * REPLACE (arrival AS seq) FROM (
        {sql.planted("turns", "seq", "text", "message_id, seq, arrival, from_agent, to_agent")})
)"""


@query("stream_score", f"""WITH {_TURN_STREAM}, {sql.rules()}
    SELECT message_id, rule_score, rule_type, {sql.rounded(sql.keyword_share(), 4)} AS classifier_score
    FROM scored""")
def _(spark, sf):
    folder = run_folder(spark)
    columns = ["message_id", "rule_score", "rule_type"]

    def start(rows):
        scored = stream_score(turn_stream(rows), Layers(drift=constant_drift())).select(
            *columns, round_to(F.col("classifier_score"), 4).alias("classifier_score"))
        return scored.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option(
            "path", f"{folder}/scored").trigger(availableNow=True).start()

    _arrivals(spark, sf, "conversations", _TURN_PLACE, start)
    return spark.read.parquet(f"{folder}/scored")


def _screened_handoffs(spark, sf) -> DataFrame:
    sink = StreamScreening(run_folder(spark))
    _arrivals(spark, sf, "events", _EVENT_PLACE, lambda rows: start_screening(
        handoff_messages(rows), sink, available_now=True))
    return sink.detections(spark)


# each message registered when it arrives
_ARRIVED = sql.HANDOFF.replace("event_id AS seq", "((event_id % 3) << 40) | event_id AS seq")


@query("stream_history", SQL["suspicion_history"].replace(sql.HANDOFF, _ARRIVED))
def _(spark, sf):
    return _screened_handoffs(spark, sf).select(
        "message_id", round_to(F.col("suspicion_history"), 4).alias("suspicion_history")
    )


@query("stream_history_keyed", SQL["suspicion_history"].replace(sql.HANDOFF, _ARRIVED))
def _(spark, sf):
    """The same by keyed state operators."""
    folder = run_folder(spark)

    def start(rows):
        with state_store(spark):
            return keyed_history(handoff_messages(rows), slice_width=1000).writeStream.format("parquet").option(
                "checkpointLocation", f"{folder}/progress").option("path", f"{folder}/history").trigger(
                    availableNow=True).start()

    _arrivals(spark, sf, "events", _EVENT_PLACE, start)
    return spark.read.parquet(f"{folder}/history").select(
        "message_id", round_to(F.col("suspicion_history"), 4).alias("suspicion_history"))


@query("stream_graph", SQL["cascade_potential_asof"].replace(sql.HANDOFF, _ARRIVED))
def _(spark, sf):
    return _screened_handoffs(spark, sf).select(
        "message_id", round_to(F.col("cascade_potential"), 4).alias("cascade_potential")
    )


@query("stream_quarantine", f"""WITH RECURSIVE {_TURN_STREAM}, {sql.screened("planted", "0.5e0")}
    {_audit_sql("seq & 288230376151711743")}""")
def _(spark, sf):
    sink = StreamScreening(run_folder(spark), Layers(drift=constant_drift()))
    _arrivals(spark, sf, "conversations", _TURN_PLACE, lambda rows: start_screening(
        turn_stream(rows), sink, available_now=True))
    return _in_utc(sink.audit(spark).drop("batch"))


@query("stream_quarantine_rate", SQL["quarantine_rate"])
def _(spark, sf):
    """Tumbling windows over the event stream."""
    folder = run_folder(spark)

    def start(rows):
        stamped = handoff_messages(rows).select(
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("predicted_type"),
            (F.col("base_suspicion") >= 0.5).alias("quarantined"),
        )
        counts = routing.quarantine_rate(stamped, watermark="1 hour").withColumn(
            "window_start", F.col("window_start").cast("timestamp_ntz")
        )
        return counts.writeStream.outputMode("update").foreachBatch(keep_changed).option(
            "checkpointLocation", f"{folder}/progress"
        ).trigger(availableNow=True).start()

    def keep_changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rate/batch={number}")

    # in order of time, as the window's watermark drops what is an hour late
    cuts = table(spark, sf, "events").agg(F.percentile_approx("event_id", [1 / 3, 2 / 3], 10_000)).first()[0]
    place = f"(CASE WHEN event_id > {cuts[1]} THEN 2 WHEN event_id > {cuts[0]} THEN 1 ELSE 0 END)"
    _arrivals(spark, sf, "events", place, start)
    keys = ["window_start", "predicted_type"]
    newest = F.max_by(F.struct("n", "quarantined"), F.col("batch")).alias("x")
    return spark.read.parquet(f"{folder}/rate").groupBy(*keys).agg(newest).select(*keys, "x.*")


# -- a layer of one's own -----------------------------------------------------

@query("plugged_in_classifier", f"""
    WITH {sql.MESSAGES} SELECT message_id, {sql.rounded("""length(regexp_replace(lower(content), '[^aeiou]', '', 'g'))
        / CAST(greatest(length(content), 1) AS DOUBLE)""", 4)} AS classifier_score
    FROM planted""")
def _(spark, sf):
    """A model in Python, batch by batch, in place of the built-in classifier."""
    @F.pandas_udf("double")
    def vowel_share(content: pd.Series) -> pd.Series:
        lowered = content.fillna("").str.lower()
        return lowered.str.count("[aeiou]") / lowered.str.len().clip(lower=1)

    layers = Layers(classifier=classifier_from_column(vowel_share(F.col("content"))), drift=constant_drift())
    return score_texts(planted(spark, sf), layers).select(
        "message_id", round_to(F.col("classifier_score"), 4).alias("classifier_score")
    )


def _letter_model():
    """A logistic model of letter counts, as one that is loaded from somewhere."""
    import numpy as np

    weights = np.array([0.02, -0.01, 0.05])

    def predict(content: np.ndarray) -> np.ndarray:
        counts = np.array([[t.count("e"), t.count("a"), t.count("!")] for t in content], float).reshape(-1, 3)
        return 1 / (1 + np.exp(-(counts @ weights - 0.5)))

    return predict


def _count_sql(letter: str) -> str:
    return f"(length(content) - length(replace(content, '{letter}', '')))"


@query("batch_inference", f"""
    WITH {sql.MESSAGES}, scores AS (SELECT message_id, 1 / (1 + exp(-(0.02e0 * {_count_sql("e")}
        - 0.01e0 * {_count_sql("a")} + 0.05e0 * {_count_sql("!")} - 0.5e0))) AS score FROM planted)
    SELECT message_id, {sql.rounded("score", 4)} AS classifier_score, score >= 0.65e0 AS flagged FROM scores""")
def _(spark, sf):
    """A classifier asked batch by batch, loaded once a worker."""
    layers = Layers(classifier=classifier_from_batches(_letter_model), drift=constant_drift())
    return score_texts(planted(spark, sf), layers).select(
        "message_id", round_to(F.col("classifier_score"), 4).alias("classifier_score"),
        (F.col("classifier_score") >= DEFAULT.thresholds.classifier).alias("flagged"))


@query("batch_vectors", f"""
    WITH {sql.MESSAGES}, v AS (SELECT message_id, [{_count_sql("e")}, {_count_sql("a")}, {_count_sql("!")}] AS x FROM planted)
    SELECT message_id, {sql.rounded("(1e0 - coalesce(CASE WHEN x <> [0, 0, 0] THEN list_cosine_similarity(CAST(x AS DOUBLE[]), [1e0, 2e0, 0e0]) END, 0e0)) / 2e0", 4)} AS drift_score
    FROM v""")
def _(spark, sf):
    """Vectors of an encoder asked batch by batch, and their drift from an intent."""
    def load():
        import numpy as np

        return lambda content: np.array(
            [[t.count("e"), t.count("a"), t.count("!")] for t in content], np.float32).reshape(-1, 3)

    layers = Layers(drift=drift_from_batches(load, [1.0, 2.0, 0.0]))
    return score_texts(planted(spark, sf), layers).select("message_id", "drift_score")


@query("many_rules", f"""
    WITH {sql.MESSAGES} SELECT message_id, {sql.hit_names("content")} AS hits FROM planted""")
def _(spark, sf):
    """The catalogue as a large rule set, without its guards."""
    hits = matching_rules(F.col("content"), DEFAULT_RULES)
    return planted(spark, sf).select("message_id", F.array_join(hits, ",").alias("hits"))
