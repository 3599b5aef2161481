"""Many rules at once, next to plain searches."""

import random
import re
import time

from parapet.functions.literals import FLAGS, Matcher, required
from parapet.functions.rules import DEFAULT_RULES, Rule


def test_literals_of_patterns():
    assert required("ignore (all )?previous") == {"gnore "} or len(next(iter(required("ignore (all )?previous")))) >= 6
    assert required("(foo|bar)baz") == {"baz"} or required("(foo|bar)baz") == {"foo", "bar"}
    assert required("a.c") is None and required("[abc]{5}") is None and required("(abc)?") is None
    assert required("(?:abc){2,}") == {"abc"} and required("x|yz") is None
    assert required(r"\bword\b") == {"word"}


def texts_for(rules, rng):
    words = ["all", "previous", "the", "system", "PROMPT", "memory", "next", "agent", "Override", "hidden", "note",
             "ſystem", "K", "\n", "decode", "and", "execute", "act", "as", "if", "you", "are", "now"]
    for _ in range(400):
        yield " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))


def test_hits_equal_plain_searches():
    rng = random.Random(7)
    made = []
    for i in range(1000):
        a, b = (rng.choice(["all", "system", "memory", "note", "hidden", "agent", "act", "k"]) + rng.choice(["", " ", "s?", r"\w+"]) for _ in range(2))
        made.append(Rule(f"r{i}", "direct_override", rng.choice([f"{a}.*{b}", f"({a}|{b})\\s+you", f"{a}{b}", f"(?:{a}){{1,2}}[aeiou]", f"\\b{a}\\b", ".{3}x?"])))
    for rules in (DEFAULT_RULES, made):
        matcher = Matcher(rules)
        compiled = [(r.name, re.compile(r.pattern, FLAGS)) for r in rules]
        for text in list(texts_for(rules, rng))[: 400 if rules is DEFAULT_RULES else 60]:
            assert matcher.hits(text) == [name for name, p in compiled if p.search(text)]


def test_cost_hardly_grows_with_the_rules():
    rng = random.Random(8)
    letters = "abcdefghjlmnopqrtuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(9))
    rules = [Rule(f"r{i}", "direct_override", f"{word()}\\s+{word()}") for i in range(3000)]
    texts = [" ".join(word() for _ in range(300)) for _ in range(60)]

    def seconds(count):
        matcher = Matcher(rules[:count])
        matcher.hits(texts[0])
        best = 9e9
        for _ in range(3):
            start = time.perf_counter()
            for text in texts:
                matcher.hits(text)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(3000) < 5 * seconds(30) + 0.05


def test_a_large_rule_table_counts_as_a_small_one(spark, monkeypatch):
    from parapet.functions import rules as small
    from parapet.operators.rule_filter import find_hits

    rng = random.Random(9)
    rows = [(i, text) for i, text in enumerate(list(texts_for(DEFAULT_RULES, rng))[:60])] + [(60, None), (61, "")]
    frame = spark.createDataFrame(rows, "id int, content string")
    columns = find_hits(frame).drop("content").orderBy("id").collect()
    monkeypatch.setattr(small, "MANY_RULES", 5)
    assert find_hits(frame).drop("content").orderBy("id").collect() == columns
