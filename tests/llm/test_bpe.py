import hashlib
import struct

import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parapet.llm import byte_bpe
from parapet.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.public_vocabulary()


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def by_scanning(piece, ranks):
    """Merge the least pair, leftmost first, by looking at all pairs each time."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            break
        i = min(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@given(st.text(alphabet="abehinrst é中'", max_size=60))
@settings(max_examples=300, deadline=None)
def test_heap_equals_scanning(text):
    v = test_heap_equals_scanning.vocabulary
    assert byte_bpe.merged(text.encode(), v.ranks, v.longest) == by_scanning(text.encode(), v.ranks)


test_heap_equals_scanning.vocabulary = byte_bpe.public_vocabulary()


def test_the_hash_is_minimal_and_perfect(vocabulary):
    import numpy as np

    assert len(vocabulary.seeds) == len(vocabulary.at_place) == len(vocabulary.tokens)
    assert sorted(vocabulary.at_place.tolist()) == list(range(len(vocabulary.tokens)))
    own = vocabulary.whole(vocabulary.data, vocabulary.starts, vocabulary.ends)
    assert (own == np.arange(len(vocabulary.tokens))).all()
    # what isn't a token isn't found, not even beside equal hashes
    odd = np.frombuffer(b"zzqqzzqq", np.uint8)
    assert vocabulary.whole(odd, np.array([0]), np.array([8])).tolist() == [-1]
    same = byte_bpe.Vocabulary([bytes([b]) for b in range(256)] + [b"ab"], vocabulary.pattern)
    same.hashes = np.zeros_like(same.hashes)
    assert -1 in same.whole(odd, np.array([0, 0]), np.array([1, 2])).tolist()


ODD = [
    None, "", " ", "\n\n \t", "it's we'll I'M  x　\u001c\u0085y", "12²３ ½", "\U0001f600" * 40, "\0\0a",
    "<|endoftext|> and more", "� ́e", "a" * 30_000, "ab" * 20_000, " " * 5_000 + "x",
]


def test_texts_equal_the_library(spark, vocabulary, reference):
    long = "Words, numbers 123 and é中文; " * 60_000  # beyond a chunk
    rows = [(i, t, "en") for i, t in enumerate([*ODD, long, "same", "same"])] + [(None, "no id", None), (None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    for packed in (False, True):
        ids = byte_bpe.encode(docs, vocabulary, packed=packed)
        assert ids.columns == ["doc_id", "lang", "decoded", "ids"]
        got = byte_bpe.decode(ids, vocabulary).collect()
        assert len(got) == len(rows)
        texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
        for r in got:
            own = [x for x, in struct.iter_unpack("<I", r["ids"])] if packed else r["ids"]
            if r["doc_id"] is not None:
                assert own == reference.encode_ordinary(texts[r["doc_id"]])
                assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
                assert r["lang"] == "en"


def test_ids_that_are_none(spark, vocabulary):
    rows = [(1, None), (2, []), (3, [0, None]), (4, [50256]), (5, [-1]), (6, [64, 65])]
    got = {r["k"]: r["decoded"] for r in byte_bpe.decode(
        spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1), vocabulary).collect()}
    assert got[1] is None and got[3] is None and got[4] is None and got[5] is None
    assert bytes(got[2]) == b"" and bytes(got[6]) == vocabulary.tokens[64] + vocabulary.tokens[65]
    odd = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(struct.pack("<I", 65)))], "k int, ids binary")
    got = {r["k"]: r["decoded"] for r in byte_bpe.decode(odd.coalesce(1), vocabulary).collect()}
    assert got[1] is None and bytes(got[2]) == vocabulary.tokens[65]


def test_kept_ids_are_bounded(vocabulary, reference):
    import numpy as np

    encoder = byte_bpe.Encoder(vocabulary, kept_ids=10)
    for text in ("zqxj wvkq", "jjkqz wvkq", "zqxj"):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, at = encoder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == reference.encode_ordinary(text) and len(encoder.ids) < 40


def test_empty_table(spark, vocabulary):
    none = spark.createDataFrame([], DOCS)
    assert byte_bpe.decode(byte_bpe.encode(none, vocabulary), vocabulary).count() == 0


def test_query_equals_the_library(spark, reference):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
