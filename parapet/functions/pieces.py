"""Word pieces: the longest pieces of a vocabulary, from left to right.

A text is cut into words at white space; a word is cut into the longest piece of the
vocabulary that it starts with, then the longest continuation (written with ``##``) of
what is left, and so on.  A word that can't be cut so is one unknown piece.  The
vocabulary is a trie, looked up letter by letter.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from parapet import fixed_values as fv
from parapet.functions.text import words

UNKNOWN = "[UNK]"
CONTINUED = "##"
_END = ""
#: Words whose pieces a worker keeps.
KEPT_WORDS = 200_000


class Pieces:
    """The trie of a vocabulary."""

    def __init__(self, vocabulary: list[str]):
        self.first: dict = {}
        self.later: dict = {}
        self.known: dict[str, list[str]] = {}
        for piece in vocabulary:
            root = self.later if piece.startswith(CONTINUED) and len(piece) > 2 else self.first
            node = root
            for letter in piece[2:] if root is self.later else piece:
                node = node.setdefault(letter, {})
            node[_END] = piece

    def of_word(self, word: str) -> list[str]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            found = self.known[word] = self._cut(word)
        return found

    def _cut(self, word: str) -> list[str]:
        out, at, root = [], 0, self.first
        while at < len(word):
            node, i, best, stop = root, at, None, at
            while i < len(word) and word[i] in node:
                node, i = node[word[i]], i + 1
                if _END in node:
                    best, stop = node[_END], i
            if best is None:
                return [UNKNOWN]
            out.append(best)
            at, root = stop, self.later
        return out

    def first_of(self, tokens: list[str], limit: int) -> list[str]:
        out: list[str] = []
        for token in tokens:
            if len(out) >= limit:
                break
            out += self.of_word(token)
        return out[:limit]


def first_pieces(content: Column, vocabulary: list[str], limit: int = fv.MAX_TOKENS) -> Column:
    """The first ``limit`` word pieces of the lower-cased text.  Map-only; null stays null.

    No word after the first ``limit`` is looked at: each gives a piece at least.
    """
    pieces = Pieces(vocabulary)

    def cut(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda own: None if own is None else pieces.first_of(list(own), limit))

    cut.__annotations__ = {"tokens": pd.Series, "return": pd.Series}
    return F.pandas_udf(cut, ArrayType(StringType()))(F.slice(words(content), 1, limit))


def truncate_pieces(content: Column, vocabulary: list[str], limit: int = fv.MAX_TOKENS, special: int = 2) -> Column:
    """The text of the first pieces, as a model sees it that adds ``special`` pieces of
    its own to make ``limit``: words by single blanks, the last one maybe in part."""
    own = first_pieces(content, vocabulary, limit - special)
    joined = F.array_join(own, " ")
    return F.replace(joined, F.lit(f" {CONTINUED}"), F.lit(""))


def vocabulary_from_table(table: DataFrame, column: str = "piece", limit: int = 200_000) -> list[str]:
    """A vocabulary kept as rows; one over ``limit`` pieces is refused."""
    rows = table.select(column).where(F.col(column).isNotNull()).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"vocabulary has more than {limit} pieces")
    return sorted({r[column] for r in rows})


def frequent_pieces(df: DataFrame, content: str, size: int, longest: int = 3) -> DataFrame:
    """A vocabulary of a corpus: its ``size`` most frequent parts of words of up to
    ``longest`` letters, ties by piece, and all single letters.  Not trained merges, but
    enough to cut any word of the corpus."""
    counted = df.select(F.explode(words(F.col(content))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    parts = counted.select("word", "n", at).select(
        "n", "at", F.explode(F.array(*[F.substring("word", F.col("at"), F.lit(k)) for k in range(1, longest + 1)])).alias("part"),
        (F.length("word") - F.col("at") + 1).alias("left"))
    # parts cut short by the word's end are shorter ones
    piece = F.when(F.col("at") == 1, F.col("part")).otherwise(F.concat(F.lit(CONTINUED), F.col("part")))
    sums = parts.groupBy(piece.alias("piece"), (F.length("part") == 1).alias("single")).agg(F.sum("n").alias("n"))
    best = sums.where("NOT single").orderBy(F.desc("n"), "piece").limit(size)
    return best.unionByName(sums.where("single")).select("piece").distinct()
