"""The labelled corpus builder: texts computed from row ids.

Every choice is a seeded pick from a fixed list, so a row depends on its id
only: no shuffle, no state, any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parapet import fixed_values as fv
from parapet.functions.decoding import base64_text, hex_text, homoglyph_text, rot13_text
from parapet.functions.picks import pick_between, pick_number, pick_one, shuffle_key
from parapet.operators.selection import find_cuts


def _fill(template: Column, fillers: dict[str, Column]) -> Column:
    for name, value in fillers.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def override_text(row_id: Column, seed: str) -> Column:
    return _fill(
        pick_one(row_id, f"{seed}-template", fv.OVERRIDE_TEMPLATES),
        {"p": pick_one(row_id, f"{seed}-payload", fv.PAYLOADS)},
    )


def roleplay_text(row_id: Column, seed: str) -> Column:
    return _fill(
        pick_one(row_id, f"{seed}-template", fv.ROLE_PLAY_TEMPLATES),
        {"p": pick_one(row_id, f"{seed}-payload", fv.PAYLOADS)},
    )


def tool_output_text(row_id: Column, seed: str) -> Column:
    return _fill(
        pick_one(row_id, f"{seed}-template", fv.TOOL_OUTPUT_TEMPLATES),
        {
            "benign": pick_one(row_id, f"{seed}-snippet", fv.TOOL_OUTPUT_SNIPPETS),
            "p": pick_one(row_id, f"{seed}-payload", fv.PAYLOADS),
        },
    )


def chain_text(row_id: Column, seed: str) -> Column:
    return _fill(
        pick_one(row_id, f"{seed}-template", fv.CHAIN_TEMPLATES),
        {
            "p": pick_one(row_id, f"{seed}-payload", fv.PAYLOADS),
            "agent": pick_one(row_id, f"{seed}-agent", fv.AGENTS),
        },
    )


def encoded_text(row_id: Column, seed: str) -> Column:
    phrase = pick_one(row_id, f"{seed}-phrase", fv.ENCODED_SEEDS)
    method = pick_number(row_id, f"{seed}-method", 4)
    encoded = (
        F.when(method == 0, base64_text(phrase))
        .when(method == 1, rot13_text(phrase))
        .when(method == 2, hex_text(phrase))
        .otherwise(homoglyph_text(phrase))
    )
    return F.concat(pick_one(row_id, f"{seed}-prefix", fv.ENCODED_PREFIXES), encoded)


def flood_text(row_id: Column, seed: str) -> Column:
    repeats = pick_between(row_id, f"{seed}-repeats", *fv.FLOOD_REPEATS)
    padding = F.repeat(pick_one(row_id, f"{seed}-padding", fv.FLOOD_PADDING), repeats.cast("int"))
    phrase = pick_one(row_id, f"{seed}-phrase", fv.FLOOD_INJECTIONS)
    place = pick_number(row_id, f"{seed}-place", 3)
    half = F.floor(F.length(padding) / 2).cast("int")
    middle = F.concat(
        F.substring(padding, F.lit(1), half), F.lit(" "), phrase, F.lit(". "),
        F.substring(padding, half + 1, F.length(padding)),
    )
    return (
        F.when(place == 0, F.concat(phrase, F.lit(". "), padding))
        .when(place == 1, middle)
        .otherwise(F.concat(padding, phrase, F.lit(".")))
    )


def benign_text(row_id: Column, seed: str) -> Column:
    def number(name: str, bounds: tuple[int, int]) -> Column:
        return pick_between(row_id, f"{seed}-{name}", *bounds).cast("string")

    return _fill(
        pick_one(row_id, f"{seed}-template", fv.BENIGN_TEMPLATES),
        {
            "task": pick_one(row_id, f"{seed}-task", fv.BENIGN_TASKS),
            "result": pick_one(row_id, f"{seed}-result", fv.BENIGN_RESULTS),
            "source": pick_one(row_id, f"{seed}-source", fv.BENIGN_SOURCES),
            "status": pick_one(row_id, f"{seed}-status", fv.BENIGN_STATUSES),
            "agent": pick_one(row_id, f"{seed}-agent", fv.BENIGN_AGENTS),
            "step": number("step", fv.BENIGN_STEP),
            "n": number("n", fv.BENIGN_N),
            "eta": F.concat(number("eta", fv.BENIGN_ETA_MINUTES), F.lit(" minutes")),
            "conf": number("conf", fv.BENIGN_CONFIDENCE),
        },
    )


GENERATORS = {
    "direct_override": override_text,
    "role_play_smuggling": roleplay_text,
    "tool_output_injection": tool_output_text,
    "indirect_chain_poisoning": chain_text,
    "encoded_payload": encoded_text,
    "context_flooding": flood_text,
    fv.BENIGN: benign_text,
}


def augment_text(text: Column, row_id: Column, seed: str) -> Column:
    """One of ten surface changes, two of which leave the text as it is."""
    change = pick_number(row_id, f"{seed}-augment", 10)
    changed = [
        F.upper(text),
        F.lower(text),
        F.replace(text, F.lit("."), F.lit("..")),
        F.replace(text, F.lit(" "), F.lit("  ")),
        F.concat(F.lit(">>> "), text),
        F.concat(text, F.lit(" <<<")),
        F.replace(text, F.lit(","), F.lit(";")),
        F.concat(F.lit("\n"), text, F.lit("\n")),
    ]
    result = text
    for number, value in enumerate(changed):
        result = F.when(change == number, value).otherwise(result)
    return result


def with_agents(df: DataFrame, id_column: str, seed: str) -> DataFrame:
    """A sender and another agent as receiver, both uniform."""
    row_id, count = F.col(id_column), len(fv.AGENTS)
    sender = pick_number(row_id, f"{seed}-sender", count)
    receiver = (sender + 1 + pick_number(row_id, f"{seed}-receiver", count - 1)) % count
    agents = F.lit(fv.AGENTS)
    return df.withColumns({
        "from_agent": F.element_at(agents, (sender + 1).cast("int")),
        "to_agent": F.element_at(agents, (receiver + 1).cast("int")),
    })


def quota_per_attack(rows: int, share: float = fv.ATTACK_SHARE) -> int:
    return int(rows * share / len(fv.ATTACK_TYPES))


def with_quota_by_number(df: DataFrame, number_column: str, rows: int) -> DataFrame:
    """Attack type by running number (0 to rows - 1): equal quotas, rest benign."""
    quota = quota_per_attack(rows)
    kind = F.lit(fv.BENIGN)
    for place in reversed(range(len(fv.ATTACK_TYPES))):
        kind = F.when(
            F.col(number_column) < quota * (place + 1), F.lit(fv.ATTACK_TYPES[place])
        ).otherwise(kind)
    return df.withColumn("attack_type", kind)


def with_quota_by_id(df: DataFrame, id_column: str, seed: str) -> DataFrame:
    """The same exact quotas for any unique ids, dealt out in hash order."""
    quota = quota_per_attack(df.count())
    ends = [quota * (place + 1) for place in range(len(fv.ATTACK_TYPES))]
    keyed = df.withColumn("_key", shuffle_key(F.col(id_column), f"{seed}-quota"))
    cuts = find_cuts(keyed.select("_key"), "_key", sorted(set(ends)))
    kind = F.lit(fv.BENIGN)
    for place in reversed(range(len(fv.ATTACK_TYPES))):
        kind = F.when(
            F.col("_key") <= cuts[ends[place]].key, F.lit(fv.ATTACK_TYPES[place])
        ).otherwise(kind)
    return keyed.withColumn("attack_type", kind).drop("_key")


def messages_for_types(df: DataFrame, id_column: str, seed: str) -> DataFrame:
    """Texts, agents, labels and order for rows that have an attack type."""
    row_id = F.col(id_column)
    attack = None
    for kind in fv.ATTACK_TYPES:
        text = GENERATORS[kind](row_id, f"{seed}-{kind}")
        test = F.col("attack_type") == kind
        attack = F.when(test, text) if attack is None else attack.when(test, text)
    benign = F.col("attack_type") == fv.BENIGN
    drafted = df.withColumn(
        "_text", attack.otherwise(benign_text(row_id, f"{seed}-{fv.BENIGN}"))
    )
    written = drafted.withColumn(
        "content",
        F.when(benign, F.col("_text")).otherwise(augment_text(F.col("_text"), row_id, seed)),
    )
    order = F.substring(shuffle_key(row_id, f"{seed}-order"), 1, 15)
    return with_agents(written, id_column, seed).select(
        row_id.cast("string").alias("message_id"),
        F.conv(order, 16, 10).cast("bigint").alias("seq"),
        "content", "from_agent", "to_agent",
        F.when(benign, 0).otherwise(1).alias("label"),
        "attack_type",
    )


def build_corpus(spark: SparkSession, rows: int = fv.CORPUS_SIZE, seed: str = "42") -> DataFrame:
    """``rows`` labelled messages with the fixed class quotas."""
    numbered = with_quota_by_number(spark.range(rows), "id", rows)
    return messages_for_types(numbered, "id", seed)


def build_corpus_for_ids(df: DataFrame, id_column: str, seed: str = "42") -> DataFrame:
    """A labelled corpus with one message per (unique) id of a table."""
    ids = df.select(F.col(id_column).alias("id"))
    return messages_for_types(with_quota_by_id(ids, "id", seed), "id", seed)
