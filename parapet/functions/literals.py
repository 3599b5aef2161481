"""Many rules at once: which rules can match a text, by one pass over it.

A pattern says which words a match must hold: of a sequence all its parts', of an
alternation one of each branch's.  For every rule the longest such set of literals is
taken from the parsed pattern, and one automaton over the literals of all rules runs
over the lower-cased text.  Only rules whose literals occur are searched as patterns,
so the cost hardly grows with the number of rules, and rules need no hand-written
guard.  A rule without literals is searched in every text.
"""

from __future__ import annotations

import re
from re import _constants as sre, _parser as parser

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

from parapet.functions.rules import Rule

FLAGS = re.IGNORECASE | re.DOTALL
#: Alternatives that are still worth looking for, instead of searching the pattern.
MOST_LITERALS = 64
_SHORTEST = 2


def _plain(code: int) -> str | None:
    """A character as it stands in folded text; None if it folds to something else,
    or letters of other scripts fold to it."""
    char = chr(code)
    return char.lower() if char.isascii() and char.lower() not in "kis" else None


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """Of two sets of literals the one that is rarer by its shortest member."""
    if a is None or b is None:
        return a if b is None else b
    return max(a, b, key=lambda own: (min(map(len, own)), -len(own)))


def required(pattern: str) -> frozenset[str] | None:
    """Literals of which a match holds one at least, in lower case; None if unknown.

    The letters i, k and s have relatives outside ASCII that match them, and end a literal.
    """
    found = _of(parser.parse(pattern, FLAGS))
    return found if found and min(map(len, found)) >= _SHORTEST else None


def _of(parts) -> frozenset[str] | None:
    best, run = None, ""

    def close():
        nonlocal best, run
        if run:
            best = _better(best, frozenset([run]))
        run = ""

    for op, value in parts:
        if op is sre.LITERAL:
            char = _plain(value)
            if char is None:
                close()
            else:
                run += char
            continue
        inner = None
        if op is sre.SUBPATTERN:
            nested = list(value[3])
            if all(o is sre.LITERAL and _plain(v) is not None for o, v in nested) and not value[1] and not value[2]:
                run += "".join(_plain(v) for _, v in nested)
                continue
            inner = _of(value[3])
        elif op is sre.BRANCH:
            sets = [_of(branch) for branch in value[1]]
            if all(s is not None for s in sets):
                union = frozenset().union(*sets)
                inner = union if len(union) <= MOST_LITERALS else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner = _of(value[2])
        elif op is sre.ATOMIC_GROUP:
            inner = _of(value)
        elif op is sre.AT:
            continue  # an anchor has no width
        close()
        best = _better(best, inner)
    close()
    return best


class Matcher:
    """The automaton of a rule set, and its compiled patterns."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.compiled = rules, {}
        self.always, owners = [], {}
        for number, rule in enumerate(rules):
            words = required(rule.pattern)
            if words is None:
                self.always.append(number)
            for word in words or ():
                owners.setdefault(word, []).append(number)
        self.owners = list(owners.items())
        self.machine = None

    def __getstate__(self):
        return {**self.__dict__, "machine": None, "compiled": {}}

    def candidates(self, text: str) -> set[int]:
        """Rules that may match."""
        if self.machine is None and self.owners:  # built once a worker
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for word, numbers in self.owners:
                self.machine.add_word(word, numbers)
            self.machine.make_automaton()
        found = set(self.always)
        if self.owners:
            for _, numbers in self.machine.iter(text.lower()):
                found.update(numbers)
        return found

    def hits(self, text: str) -> list[str]:
        """Names of the rules that match, in the order of the rules."""
        out = []
        for number in sorted(self.candidates(text)):
            pattern = self.compiled.get(number)
            if pattern is None:
                pattern = self.compiled[number] = re.compile(self.rules[number].pattern, FLAGS)
            if pattern.search(text):
                out.append(self.rules[number].name)
        return out


def matching_rules(content: Column, rules: list[Rule]) -> Column:
    """Names of the rules that match, as a map-only column; none for a null text.

    For large rule sets; the built-in catalogue is faster as JVM columns.
    """
    matcher = Matcher(rules)

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [] if text is None else matcher.hits(text))

    find.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(find, ArrayType(StringType()))(content)
