"""Word pieces next to a straightforward cut."""

import random

import pytest
from pyspark.sql import functions as F

from parapet.functions import pieces


def straight(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        for stop in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:stop]
            if piece in vocabulary:
                out.append(piece)
                at = stop
                break
        else:
            return ["[UNK]"]
    return out


def test_longest_match(spark):
    rng = random.Random(3)
    vocabulary = {rng.choice(["", "##"]) + "".join(rng.choice("abé#") for _ in range(rng.randint(1, 4))) for _ in range(60)}
    vocabulary |= {"a", "b", "##a", "##b"}
    cut = pieces.Pieces(sorted(vocabulary))
    for _ in range(2000):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 12)))
        assert cut.of_word(word) == straight(word, vocabulary)
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "aB  ab\tzz b"), (4, "ab " * 400), (5, "a" * 100_000)]
    own = sorted(vocabulary)
    frame = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r for r in frame.select("id", pieces.first_pieces(F.col("text"), own, 7).alias("p"),
                                            pieces.truncate_pieces(F.col("text"), own, 9).alias("t")).collect()}
    assert got[0]["p"] is None and got[1]["p"] == [] and got[2]["p"] == []
    for i in (3, 4, 5):
        want = [p for w in rows[i][1].lower().split() for p in straight(w[:40], vocabulary)][:7]
        assert got[i]["p"] == want
        assert got[i]["t"] == " ".join(want).replace(" ##", "")


def test_vocabulary_is_bounded(spark):
    table = spark.createDataFrame([("a",), ("b",), (None,)], "piece string")
    assert pieces.vocabulary_from_table(table) == ["a", "b"]
    with pytest.raises(ValueError):
        pieces.vocabulary_from_table(table, limit=1)
