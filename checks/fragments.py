"""SQL pieces shared by the comparison queries (DuckDB dialect)."""

from __future__ import annotations

from parapet import fixed_values as fv
from parapet.functions.rules import DEFAULT_RULES
from parapet.sources import tables as tb


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def rounded(value: str, digits: int) -> str:
    # the engine's own rounding; the small term as in the library: sums may differ in a last bit
    return f"round(CAST({value} AS DOUBLE) + 1e-{digits + 7}, {digits})"


def hash_key(row_id: str, seed: str) -> str:
    return f"md5({quote(seed + '|')} || CAST({row_id} AS VARCHAR))"


def pick_number(row_id: str, seed: str, choices: int) -> str:
    return f"(CAST('0x' || substr({hash_key(row_id, seed)}, 1, 12) AS BIGINT) % {choices})"


def pick_one(row_id: str, seed: str, values: list[str]) -> str:
    return f"({array(values)})[{pick_number(row_id, seed, len(values))} + 1]"


def pick_between(row_id: str, seed: str, low: int, high: int) -> str:
    return f"({pick_number(row_id, seed, high - low + 1)} + {low})"


def filled(template: str, fillers: dict[str, str]) -> str:
    for name, value in fillers.items():
        template = f"replace({template}, {quote('{' + name + '}')}, {value})"
    return template


def preview(content: str, length: int) -> str:
    return (
        f"(CASE WHEN length({content}) > {length} THEN substr({content}, 1, {length}) || '…' "
        f"ELSE {content} END)"
    )


def agents(row_id: str, seed: str) -> str:
    n = len(fv.AGENTS)
    sender = pick_number(row_id, f"{seed}-sender", n)
    step = pick_number(row_id, f"{seed}-receiver", n - 1)
    return (
        f"({array(fv.AGENTS)})[{sender} + 1] AS from_agent, "
        f"({array(fv.AGENTS)})[(({sender} + 1 + {step}) % {n}) + 1] AS to_agent"
    )


# -- planted messages ---------------------------------------------------------

def planted(source: str, row_id: str, text: str, columns: str) -> str:
    """SELECT adding content, label and attack_type to the rows of ``source``."""
    place = pick_number(row_id, "plant", len(tb.PLANTED))
    tail = f"({array(tb.PLANTED)})[place + 1]"
    tail = f"replace({tail}, '{{base64}}', to_base64(encode({quote(tb.PLANTED_PHRASE)})))"
    tail = f"replace({tail}, '{{padding}}', {quote(tb.PLANTED_PADDING * 25)})"
    flood = f"repeat({quote(tb.PLANTED_FLOOD_WORD)}, length({text}) + 100)"
    return f"""
        SELECT {columns},
            {text} || CASE WHEN place = {len(tb.PLANTED) - 1} THEN {flood} ELSE {tail} END AS content,
            CAST(place > 2 AS INTEGER) AS label,
            CASE WHEN place <= 2 THEN 'benign' WHEN place <= 4 THEN 'direct_override'
                WHEN place = 5 THEN 'role_play_smuggling' WHEN place = 6 THEN 'tool_output_injection'
                WHEN place = 7 THEN 'indirect_chain_poisoning' WHEN place = 8 THEN 'encoded_payload'
                ELSE 'context_flooding' END AS attack_type
        FROM (SELECT *, {place} AS place FROM {source})"""


MESSAGES = f"""planted AS MATERIALIZED (
    {planted("documents", "doc_id", "text",
             "doc_id, CAST(doc_id AS VARCHAR) AS message_id, doc_id AS seq, source, "
             + agents("doc_id", "plant"))}
)"""

TURNS = """turns AS MATERIALIZED (
    SELECT conv_id, turn, format('{}:{}', conv_id, turn) AS message_id,
        (conv_id << 32) | turn AS seq, text, role AS from_agent,
        coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), 'sink') AS to_agent
    FROM conversations
)"""

PLANTED_TURNS = f"""{TURNS},
planted AS MATERIALIZED (
    {planted("turns", "seq", "text", "conv_id, turn, message_id, seq, from_agent, to_agent")}
)"""


# -- rule filter --------------------------------------------------------------

def type_hits(kind: str, content: str = "content") -> str:
    tests = [
        f"CAST(regexp_matches({content}, {quote(r.pattern)}, 'is') AS INTEGER)"
        for r in DEFAULT_RULES if r.attack_type == kind
    ]
    return " + ".join(tests) or "0"


def hit_names(content: str) -> str:
    tests = ", ".join(
        f"CASE WHEN regexp_matches({content}, {quote(r.pattern)}, 'is') THEN '{r.name}' END"
        for r in DEFAULT_RULES
    )
    return f"array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ',')"


def decode_hit(content: str = "content") -> str:
    token = "rtrim(k, '=')"
    keywords = " OR ".join(f"contains(d, {quote(k)})" for k in fv.DECODED_KEYWORDS)
    padded = f"rpad({token}, CAST(4 * ceil(length({token}) / 4.0) AS INTEGER), '=')"
    usable = (
        f"list_filter(regexp_extract_all({content}, {quote(fv.BASE64_TOKEN)}), "
        f"lambda k: length({token}) % 4 <> 1 AND NOT contains({token}, '='))"
    )
    decoded = f"list_transform({usable}, lambda k: lower(CAST(from_base64({padded}) AS VARCHAR)))"
    return f"(len(list_filter({decoded}, lambda d: {keywords})) > 0)"


def low_diversity(content: str = "content") -> str:
    tokens = (
        f"list_filter(string_split_regex(lower({content}), "
        f"'[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+'), lambda x: x <> '')"
    )
    return (
        f"(length({content}) >= {fv.FLOOD_MIN_CHARS} AND len({tokens}) > 0 AND "
        f"len(list_distinct({tokens})) / len({tokens}) < {fv.FLOOD_MAX_UNIQUE_RATIO}e0)"
    )


def periodic(source: str) -> str:
    """CTE ``repeated(message_id)``: texts with a unit of at least five
    characters at least 21 times in a row.

    t[i] = t[i + p] then holds on at least 20 p positions in a row, one of which
    is 20 p - 1 modulo 20 p; half of them lie on one side of it.
    """
    def same(start: str, size: str) -> str:
        return f"substr(t, {start} + 1, {size}) = substr(t, {start} + p + 1, {size})"

    def near(anchors: str) -> str:
        return f"""SELECT message_id, t, n, p, a FROM {anchors}
    WHERE {same("a", "1")}
      AND (CASE WHEN {same("a", "10 * p")} AND a + 11 * p <= n THEN true
           WHEN a >= 10 * p THEN {same("(a - 10 * p)", "10 * p")} ELSE false END)"""

    def direct(rows: str) -> str:
        return f"""SELECT DISTINCT message_id FROM {rows}
    WHERE (a + 21 * p <= n AND {same("a", "20 * p")})
       OR (a + 1 >= 20 * p AND {same("(a + 1 - 20 * p)", "20 * p")})"""

    bounds, stages = [(5, "8"), (9, "50"), (51, "n")], []
    for k, (low, high) in enumerate(bounds):
        settled = "".join(
            f" AND message_id NOT IN (SELECT message_id FROM direct_{e})" for e in range(k)
        )
        stages.append(f""", periods_{k} AS (
    SELECT message_id, t, n, unnest(range({low}, least({high}, n // 21) + 1)) AS p
    FROM folded WHERE true{settled}
), anchors_{k} AS (
    SELECT message_id, t, n, p, unnest(range(20 * p - 1, n - p, 20 * p)) AS a FROM periods_{k}
), near_{k} AS MATERIALIZED ({near(f"anchors_{k}")}
), direct_{k} AS MATERIALIZED ({direct(f"near_{k}")}
)""")
    # A run covers a multiple of 85 whose 16 characters come back within n / 21:
    # texts without such a place are settled.  Then short units before long ones.
    return f"""lowered AS MATERIALIZED (
    SELECT message_id, lower(content) AS t, length(content) AS n FROM {source}
    WHERE length(content) >= 105
), probes AS (
    SELECT message_id, t, n, unnest(range(0, n - 16, 85)) AS a FROM lowered
), folded AS MATERIALIZED (
    SELECT * FROM lowered WHERE message_id IN (
        SELECT message_id FROM probes
        WHERE contains(substr(t, a + 6, n // 21 + 11), substr(t, a + 1, 16)))
)""" + "".join(stages) + f""", direct AS MATERIALIZED (
    {" UNION ".join(f"SELECT message_id FROM direct_{k}" for k in range(len(bounds)))}
), undecided AS (
    SELECT * FROM ({" UNION ALL ".join(f"SELECT * FROM near_{k}" for k in range(len(bounds)))})
    WHERE message_id NOT IN (SELECT message_id FROM direct)
), shifted AS (
    SELECT message_id, t, n, p, unnest(range(greatest(0, a - 20 * p + 1), a + 1)) AS s FROM undecided
), repeated AS MATERIALIZED (
    SELECT message_id FROM direct
    UNION
    SELECT message_id FROM shifted WHERE s + 21 * p <= n AND {same("s", "20 * p")}
)"""


COUNTS = [f"n_{kind}" for kind in fv.ATTACK_TYPES]


def rules(source: str = "planted") -> str:
    """CTEs ending in ``scored``: the rows of source with all rule columns."""
    total = " + ".join(COUNTS)
    most = f"greatest({', '.join(COUNTS)})"
    kinds = " ".join(
        f"WHEN {most} > 0 AND n_{kind} = {most} THEN '{kind}'" for kind in fv.ATTACK_TYPES
    )
    plain = ", ".join(
        f"{type_hits(kind)} AS h_{kind}" for kind in fv.ATTACK_TYPES if kind != "context_flooding"
    )
    return f"""{periodic(source)},
found AS MATERIALIZED (
    SELECT {source}.*, {plain}, {decode_hit()} AS decode_hit, {low_diversity()} AS low_diversity_hit,
        message_id IN (SELECT message_id FROM repeated) AS periodic_hit
    FROM {source}
), counted AS (
    SELECT *, h_direct_override AS n_direct_override,
        h_role_play_smuggling AS n_role_play_smuggling,
        h_tool_output_injection AS n_tool_output_injection,
        h_indirect_chain_poisoning AS n_indirect_chain_poisoning,
        h_encoded_payload + CASE WHEN decode_hit THEN 3 ELSE 0 END AS n_encoded_payload,
        CASE WHEN low_diversity_hit THEN 3 ELSE 0 END
            + CAST(periodic_hit AS INTEGER) AS n_context_flooding
    FROM found
), scored AS MATERIALIZED (
    SELECT *, {total} AS rule_total, least(1e0, ({total}) * 0.15e0) AS rule_score,
        CASE {kinds} ELSE 'benign' END AS rule_type,
        CAST(least(1e0, ({total}) * 0.15e0) >= 0.4e0 AS INTEGER) AS rule_label
    FROM counted
)"""


def keyword_hits(content: str = "content") -> str:
    return "(" + " + ".join(
        f"CAST(contains(lower({content}), {quote(k)}) AS INTEGER)" for k in fv.KEYWORDS
    ) + ")"


def keyword_share(content: str = "content") -> str:
    return f"least(1e0, {keyword_hits(content)} / 3e0)"


# -- drift --------------------------------------------------------------------

INTENT = """intent AS MATERIALIZED (
    SELECT list(v ORDER BY i) AS vector FROM (
        SELECT i, avg(v) AS v FROM (
            SELECT unnest(CAST(embedding AS DOUBLE[])) AS v,
                unnest(range(1, len(embedding) + 1)) AS i
            FROM embeddings WHERE label = 0
        ) GROUP BY i
    )
)"""


def drift(vector: str) -> str:
    cosine = f"list_cosine_similarity(CAST({vector} AS DOUBLE[]), (SELECT vector FROM intent))"
    return rounded(f"(1e0 - coalesce({cosine}, 0e0)) / 2e0", 4)


# -- graph --------------------------------------------------------------------

def closure(messages: str) -> str:
    """CTEs edges, agents and pairs(src, dst, first_seen) of a message relation."""
    return f"""edges AS MATERIALIZED (
    SELECT from_agent AS src, to_agent AS dst, min(seq) AS first_seen, count(*) AS cnt
    FROM {messages} GROUP BY 1, 2
), agents AS MATERIALIZED (
    SELECT agent, min(first_seen) AS first_seen FROM (
        SELECT src AS agent, first_seen FROM edges UNION ALL SELECT dst, first_seen FROM edges
    ) GROUP BY agent
), walks AS (
    SELECT src, dst, first_seen FROM edges WHERE src <> dst
    UNION
    SELECT w.src, e.dst, greatest(w.first_seen, e.first_seen)
    FROM walks w JOIN edges e ON w.dst = e.src WHERE w.src <> e.dst AND e.src <> e.dst
), pairs AS MATERIALIZED (
    SELECT src, dst, min(first_seen) AS first_seen FROM walks GROUP BY 1, 2
)"""


def cascade(messages: str) -> str:
    """CTE ``placed``: history, as-of potential and risk of every message.

    The messages carry base_suspicion.
    """
    return f"""{closure(messages)},
context AS (
    SELECT m.*,
        avg(base_suspicion) OVER (
            PARTITION BY from_agent ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW
        ) AS suspicion_history,
        (SELECT count(*) FROM pairs p WHERE p.src = m.from_agent AND p.first_seen <= m.seq) AS reached,
        (SELECT count(*) FROM agents a WHERE a.first_seen <= m.seq) AS agents
    FROM {messages} m
), placed AS MATERIALIZED (
    SELECT *,
        CASE WHEN agents > 1 THEN reached / CAST(agents - 1 AS DOUBLE) ELSE 0e0 END AS cascade_potential,
        (base_suspicion * 0.7e0 + suspicion_history * 0.3e0)
            * CASE WHEN agents > 1 THEN reached / CAST(agents - 1 AS DOUBLE) ELSE 0e0 END AS cascade_risk
    FROM context
)"""


HANDOFF = """handoff AS MATERIALIZED (
    SELECT CAST(event_id AS VARCHAR) AS message_id, event_id AS seq, ts, event_type,
        'a' || user_id AS from_agent,
        'a' || (user_id // (2 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 2)) AS to_agent,
        least(1e0, value / 100e0) AS base_suspicion
    FROM events
)"""

TRADE = """trade AS MATERIALIZED (
    SELECT 'n' || s_nationkey AS from_agent, 'n' || c_nationkey AS to_agent, l_orderkey AS seq
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
)"""


# -- fusion -------------------------------------------------------------------

def two_digits(value: str) -> str:
    return f"printf('%.2f', {rounded(value, 2)})"


EXPLANATION = f"""coalesce(nullif(array_to_string(list_filter([
    CASE WHEN rule_score >= 0.4e0 THEN 'RBF matched ' || rule_type || ' pattern (score='
        || {two_digits('rule_score')} || ')' END,
    CASE WHEN classifier_score >= 0.65e0 THEN 'Classifier confidence=' || {two_digits('classifier_score')} END,
    CASE WHEN drift_score >= 0.6e0 THEN 'Semantic drift=' || {two_digits('drift_score')} || ' (above threshold)' END,
    CASE WHEN cascade_score >= 0.55e0 THEN 'Cascade risk=' || {two_digits('cascade_score')} END
], lambda x: x IS NOT NULL), ' | '), ''), {quote(fv.NO_SIGNAL)})"""


def screened(source: str, drift_sql: str, join: str = "") -> str:
    """CTEs ending in ``detected``: the whole screening of planted messages."""
    return f"""{rules(source)},
suspected AS MATERIALIZED (
    SELECT scored.*, {drift_sql} AS drift_score,
        rule_score * 0.5e0 + classifier_score * 0.5e0 AS base_suspicion
    FROM (SELECT *, {keyword_share()} AS classifier_score FROM scored) scored {join}
), {cascade("suspected")},
fused AS (
    SELECT *, 0.2e0 * rule_score + 0.45e0 * classifier_score + 0.2e0 * drift_score
        + 0.15e0 * cascade_score AS fused
    FROM (SELECT *, {rounded('cascade_risk', 4)} AS cascade_score FROM placed)
), detected AS MATERIALIZED (
    SELECT *, fused >= 0.5e0 AS is_injected, {rounded('fused', 4)} AS confidence,
        CASE WHEN rule_type <> 'benign' THEN rule_type WHEN fused >= 0.5e0 THEN 'unknown_injection'
            ELSE 'benign' END AS predicted_type,
        {EXPLANATION} AS explanation, cascade_risk >= 0.55e0 AS high_risk
    FROM fused
)"""


DETECTED = f"""{MESSAGES}, {INTENT},
{screened("planted", drift("embedding"), "LEFT JOIN embeddings ON vec_id = scored.doc_id")}"""

DETECTED_TURNS = f"""{PLANTED_TURNS},
{screened("planted", "0.5e0")}"""


DETECTED_NEWEST = f"""{TURNS},
newest AS (SELECT * FROM turns QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)),
planted AS MATERIALIZED (
    {planted("newest", "seq", "text", "conv_id, turn, message_id, seq, from_agent, to_agent")}
),
{screened("planted", "0.5e0")}"""


# -- text classifier ----------------------------------------------------------

DESCENT_STEPS = 600


def held_out_scores(source: str) -> str:
    """CTEs ending in ``regressed(message_id, text_label, text_score)``: each half of the
    messages by the balanced L2 regression on TF-IDF of the other.

    Accelerated gradient descent on one coefficient a row, as the optimum is a weighted sum
    of the rows; place -1 holds the intercept, which bears no penalty.  A loss bends by at
    most a quarter of the greatest sum of a row's products with all rows.
    """
    t = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]{2,}')"
    return f"""halved AS MATERIALIZED (
    SELECT message_id, row_number() OVER (ORDER BY message_id) AS i, label,
        {pick_number("message_id", "half", 2)} AS half, {t} AS t FROM {source}
), halved_terms AS MATERIALIZED (
    SELECT i, half, term, count(*) AS tf FROM (SELECT i, half, unnest(list_concat(t, list_concat(
        list_transform(range(1, len(t)), lambda k: t[k] || ' ' || t[k + 1]),
        list_transform(range(1, len(t) - 1), lambda k: t[k] || ' ' || t[k + 1] || ' ' || t[k + 2])))) AS term
        FROM halved) GROUP BY ALL
), half_vocabulary AS MATERIALIZED (
    SELECT 1 - half AS judged, term, row_number() OVER (PARTITION BY half ORDER BY term) AS j,
        ln((1e0 + (SELECT count(*) FROM halved h WHERE h.half = c.half)) / (1e0 + df)) + 1e0 AS idf
    FROM (SELECT half, term, count(*) AS df, sum(tf) AS n FROM halved_terms GROUP BY half, term
        QUALIFY row_number() OVER (PARTITION BY half ORDER BY n DESC, term) <= {fv.MAX_FEATURES}) c
), half_weights AS MATERIALIZED (
    SELECT judged, i, j, half, raw / sqrt(sum(raw * raw) OVER (PARTITION BY judged, i)) AS x FROM (
        SELECT judged, i, j, half, (ln(tf) + 1e0) * idf AS raw FROM halved_terms JOIN half_vocabulary USING (term))
), taught AS MATERIALIZED (SELECT judged, i, j, x FROM half_weights WHERE half <> judged
), balanced AS MATERIALIZED (
    SELECT 1 - half AS judged, i, CAST(label AS DOUBLE) AS y, count(*) OVER (PARTITION BY half)
        / (2e0 * count(*) OVER (PARTITION BY half, label)) AS s FROM halved
), bent AS MATERIALIZED (
    SELECT judged, 1e0 + 0.25e0 * max(n + coalesce(product, 0e0)) AS most FROM (
        SELECT *, sum(s) OVER (PARTITION BY judged) AS n FROM balanced)
    LEFT JOIN (SELECT judged, i, sum(x * total) AS product FROM taught JOIN (
        SELECT judged, j, sum(x * s) AS total FROM taught JOIN balanced USING (judged, i) GROUP BY ALL)
        USING (judged, j) GROUP BY ALL) USING (judged, i)
    GROUP BY judged
), descent(step, judged, i, a, u) AS (
    SELECT 0, judged, i, 0e0, 0e0 FROM (SELECT judged, i FROM balanced UNION ALL SELECT judged, -1 FROM bent)
    UNION ALL (
    WITH summed AS (SELECT judged, j, sum(u * x) AS w FROM descent JOIN taught USING (judged, i) GROUP BY ALL),
    margins AS (SELECT judged, i, sum(w * x) AS z FROM summed JOIN taught USING (judged, j) GROUP BY ALL),
    pulls AS (
        SELECT b.judged, b.i, s * (1e0 / (1e0 + exp(-(coalesce(z, 0e0) + o.u))) - y) AS r
        FROM balanced b LEFT JOIN margins m ON m.judged = b.judged AND m.i = b.i
        JOIN descent o ON o.judged = b.judged AND o.i = -1),
    moved AS (
        SELECT step, judged, i, a, u - (r + u) / most AS next, most FROM descent JOIN pulls USING (judged, i) JOIN bent USING (judged)
        UNION ALL
        SELECT any_value(step), judged, -1, any_value(a), any_value(u) - sum(r) / any_value(most), any_value(most)
        FROM (SELECT * FROM descent WHERE i = -1) JOIN (SELECT judged, r FROM pulls) USING (judged) JOIN bent USING (judged) GROUP BY judged)
    SELECT step + 1, judged, i, next, next + (next - a) * (sqrt(most) - 1e0) / (sqrt(most) + 1e0) FROM moved
    WHERE step < {DESCENT_STEPS})
), taught_terms AS (
    SELECT judged, j, sum(a * x) AS w FROM descent JOIN taught USING (judged, i) WHERE step = {DESCENT_STEPS} GROUP BY ALL
), regressed AS MATERIALIZED (
    SELECT message_id, CAST(z > 0 AS INTEGER) AS text_label, 1e0 / (1e0 + exp(-z)) AS text_score FROM (
        SELECT h.message_id, coalesce(m.z, 0e0) + o.a AS z FROM halved h
        JOIN descent o ON o.judged = h.half AND o.i = -1 AND o.step = {DESCENT_STEPS}
        LEFT JOIN (SELECT k.i, sum(w * x) AS z FROM half_weights k JOIN taught_terms v
            ON v.judged = k.judged AND v.j = k.j WHERE k.half = k.judged GROUP BY k.i) m ON m.i = h.i)
)"""


# -- metrics ------------------------------------------------------------------

def cells(label: str, prediction: str) -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {label} = {t} AND {prediction} = {p}) AS {name}"
        for name, t, p in [("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)]
    )


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN ({part}) / CAST({whole} AS DOUBLE) ELSE 0e0 END"


METRICS = ", ".join([
    f"{rounded(_ratio('tp', '(tp + fp)'), 4)} AS precision",
    f"{rounded(_ratio('tp', '(tp + fn)'), 4)} AS recall",
    f"{rounded(_ratio('2 * tp', '(2 * tp + fp + fn)'), 4)} AS f1",
    f"{rounded(_ratio('tp + tn', '(tp + fp + fn + tn)'), 4)} AS accuracy",
    f"{rounded(_ratio('fp', '(fp + tn)'), 4)} AS fpr",
    "tp, fp, fn, tn",
])


def auc_by(groups: str, relation: str) -> str:
    """SELECT groups, auc from rows of (groups, label, score)."""
    part = f"PARTITION BY {groups} " if groups else ""
    lead = f"{groups}, " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""SELECT {lead}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
        sum(pos * (below + neg * 0.5e0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))
        ELSE 0e0 END AS auc
    FROM (
        SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {lead}score, count(*) FILTER (WHERE label = 1) AS pos,
                count(*) FILTER (WHERE label = 0) AS neg
            FROM {relation} GROUP BY {lead}score)
    ) {by}"""
