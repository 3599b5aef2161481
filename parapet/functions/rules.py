"""The rule catalogue and the column expressions built from it.

Each rule is a regex that is searched in the message.  Next to its name stands
a guard: words of which at least one per ``&`` group must occur for the regex
to be able to match at all.  Guards are plain substring tests on the folded
text, an order of magnitude cheaper than the regex, and leave the result as it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from parapet import fixed_values as fv
from parapet.functions.text import WHITESPACE, WORD_CHARACTERS, all_of, any_of

_NAMES_AND_GUARDS = {
    "direct_override": [
        ("ignore_prior_instructions", "ignore & instructions & previous|prior|above|earlier"),
        ("privileged_command", "system|admin|root|master & override|reset|command|update|patch"),
        ("forget_everything", "forget & everything"),
        ("disregard_role", "disregard & role|instructions|directives|context"),
        ("new_system_prompt", "prompt & system & new"),
        ("role_has_changed", "changed & your & role|task|instruction"),
        ("emergency_override", "emergency & override"),
        ("instructions_deprecated", "deprecated & priority & message"),
        ("maintenance_mode", "mode & pipeline|system & reset|debug|maintenance"),
        ("prior_context_void", "void & prior"),
        ("master_key", "master & received"),
        ("unlock_mode", "unlock & mode"),
        ("higher_priority_command", "higher & priority & command"),
    ],
    "role_play_smuggling": [
        ("pretend_to_be", "pretend"),
        ("act_as", "act & as"),
        ("hypothetically_you", "hypothetically|imagine|suppose & you"),
        ("simulate_being", "simulate & being"),
        ("you_are_now_bot", "you & now & are & bot|agent|ai|model"),
        ("unrestricted_persona", "dan|jailbreak|filter|unrestricted"),
        ("roleplay_as", "roleplay"),
        ("testing_purposes_disable", "purposes & disable"),
        ("fictional_frame", "fictional|hypothetical|creative & frame|scenario|exercise"),
        ("legacy_agent", "legacy & agent"),
        ("in_this_story", "story|simulation|scenario & this"),
        ("thought_experiment_steps", "experiment & describe & steps"),
    ],
    "tool_output_injection": [
        ("quoted_note_ignore", "ignore & note|hidden|annotation|instruction|cmd|command"),
        ("html_comment_command", "<!--"),
        ("bracketed_metadata_ignore", "ignore & metadata|hidden|cache|annotation"),
        ("post_exec_hook", "hook|note|watermark|embedded"),
        ("tool_output_override", "override & api_response|tool_output|db_result"),
        ("json_instruction_ignore", "json & instruction & ignore"),
        ("search_result_injected", "injected & result & retrieval|search"),
        ("log_entry_override", "warning & override & entry"),
        ("ocr_hidden_text", "ocr & hidden & result"),
    ],
    "indirect_chain_poisoning": [
        ("pass_to_next_agent", "agent & next|downstream|coordinator|orchestrator & pass|relay|forward|send|tell"),
        ("include_in_report", "include & your & report|reply|response|summary"),
        ("add_to_memory", "add & memory|context|blackboard"),
        ("agent_command_tag", "[agent_cmd"),
        ("chain_message", "chain|pipeline|workflow & message|update|injection|override"),
        ("hidden_note", "steganographic|hidden|embedded & note|broadcast|message"),
        ("carry_instruction_downstream", "instruction & downstream"),
        ("watermark_response", "watermark|tag & your & response|reply|output"),
        ("append_to_context_window", "append & passing"),
        ("hidden_broadcast", "hidden & broadcast"),
        ("trojan_comment", "trojan"),
        ("when_agent_reads_output", "reads & output"),
    ],
    "encoded_payload": [
        ("decode_and_execute", "decode & execute"),
        ("encoded_instruction", "base64|b64|rot|hex|unicode & instruction|payload|command|directive|override"),
        ("decode_before_executing", "executing & before"),
        ("obfuscated_payload", "obfuscat"),
        ("encrypted_task", "encrypted"),
        ("compressed_instruction_block", "compressed & instruction"),
        ("stealth_payload", "stealth"),
    ],
}


@dataclass(frozen=True)
class Rule:
    name: str
    attack_type: str
    pattern: str
    guard: str = ""

    def guard_groups(self) -> list[list[str]]:
        if not self.guard:
            return []
        return [group.strip().split("|") for group in self.guard.split("&")]


DEFAULT_RULES = [
    Rule(name, attack_type, pattern, guard)
    for attack_type, patterns in fv.RULE_PATTERNS.items()
    for pattern, (name, guard) in zip(patterns, _NAMES_AND_GUARDS[attack_type], strict=True)
]


def spelt_out(pattern: str) -> str:
    """White space and word characters as classes: Java's own ``\\s`` and
    ``\\w`` know ASCII only."""
    return (
        pattern.replace(r"[\s-]", f"[-{WHITESPACE}]")
        .replace(r"\s", f"[{WHITESPACE}]")
        .replace(r"\w", f"[{WORD_CHARACTERS}]")
    )


def java_pattern(pattern: str) -> str:
    """The pattern for texts as they are."""
    return f"(?isu){spelt_out(pattern)}"


def lowered_pattern(pattern: str) -> str | None:
    """The pattern for lower-cased texts, or None if lowering it could change
    what it means (escapes other than white space, words and punctuation)."""
    if re.search(r"\\[A-Zabdefhkpux]|\(\?(?!:)", pattern):
        return None
    parts = re.split(r"(\\.)", pattern)
    return f"(?s){spelt_out(''.join(p if p.startswith(chr(92)) else p.lower() for p in parts))}"


def rule_condition(
    rule: Rule, content: Column, folded: Column, special: Column, candidate: Column | None = None
) -> Column:
    """True if the rule matches.  ``candidate`` tells if its guard holds, where that is known.

    Lower-cased text needs no case-insensitive search, which is much faster.
    ``special`` marks the few texts with letters that lower to something else
    than the ASCII letter they match; these are searched as they are.
    """
    guards = [candidate] if candidate is not None else [
        any_of([F.contains(folded, F.lit(word)) for word in group])
        for group in rule.guard_groups()
    ]
    found = content.rlike(java_pattern(rule.pattern))
    lowered = lowered_pattern(rule.pattern)
    if lowered is not None:
        found = F.when(special, found).otherwise(folded.rlike(lowered))
    return all_of([*guards, found])


MANY_RULES = 200


def hits_by_type(
    rules: list[Rule], content: Column, folded: Column, special: Column, candidates: Column | None = None
) -> dict[str, Column]:
    """For every attack type, the array of names of the rules that match.

    ``candidates`` holds the rules whose guard is satisfied, numbered among those with a guard.

    Up to ``MANY_RULES`` rules are columns, each with its guard.  More are found by one
    automaton over their literals, and need no guard.
    """
    by_type: dict[str, list[Rule]] = {}
    for rule in rules:
        by_type.setdefault(rule.attack_type, []).append(rule)
    if len(rules) > MANY_RULES:
        from parapet.functions.literals import matching_rules

        return {
            kind: F.coalesce(matching_rules(content, members), F.array().cast("array<string>"))
            for kind, members in by_type.items()
        }
    numbers = {id(r): n for n, r in enumerate(r for r in rules if r.guard)}

    def condition(rule: Rule) -> Column:
        known = candidates is not None and rule.guard
        return rule_condition(
            rule, content, folded, special, F.array_contains(candidates, numbers[id(rule)]) if known else None)

    return {
        attack_type: F.array_remove(
            F.array(*[F.when(condition(r), F.lit(r.name)).otherwise(F.lit("")) for r in members]), ""
        )
        for attack_type, members in by_type.items()
    }


def rules_from_table(table: DataFrame, limit: int = 1000) -> list[Rule]:
    """Rules kept as rows of (name, attack_type, pattern[, guard]).

    A rule set is small by nature; a table over ``limit`` rows is refused.
    """
    columns = ["name", "attack_type", "pattern"]
    if "guard" in table.columns:
        columns.append("guard")
    rows = table.select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"rule table has more than {limit} rows")
    return [Rule(*[value or "" for value in row]) for row in sorted(rows)]
