"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model has n-grams of up to three words, per language, and below them byte
n-grams of up to four bytes, which spell words that were not seen and what stands
between words.  The word counts grow with the trusted text.  Counts never leave
the cluster's tables: texts are dealt with in blocks, each block asks for
the n-grams it holds, in packed rows that meet what other blocks teach of the same
n-grams, by shards, and the answers go back to their blocks, where documents are scored.  Word
n-grams are counted and told part by part, and a part's tables and shuffles are
removed before the next one: all n-grams at once take many times the disk of the
texts.  That reads the texts once a part.  A
document is kept if its perplexity is within a quantile of what trusted documents
of its language have.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from parapet.llm.shared import BLANKS, Scratch, chunks, mix64, stored

ORDER = 4
WORDS = 3  # of the longest word n-gram
BLOCK_BYTES = 8_000_000
PIECE_BYTES = 250_000
PARTS = 4  # of the longest word n-grams, a power of two: one part at a time is counted and told to the blocks
ROUNDS = 3  # of the blocks that meet their answers at a time
FEW_BLOCKS = 4  # up to the bytes of so many, one part and one round do
QUANTILE = 0.99
CALIBRATION = 0.1
SHARD_BYTES = 32_000_000  # of what blocks ask and teach that meets in one piece
PACKED = 2  # bytes of that for a byte of text
ID_BITS = 42  # of a key, which tell the n-grams of one context apart
CODE_BITS = 4  # that name the shard of a byte n-gram
DENSE = 1 << 23  # places of a table of byte n-grams; more are searched for
BROADCAST_IDS = 2_000_000  # 8 bytes each; more are joined by shuffling


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values, by sorting: much faster than numpy's hash table."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The code (four bytes) of the n-gram that ends at each byte; zeros stand before a text."""
    code = data.astype(np.uint32)
    for back in range(1, ORDER):
        code[back:] |= data[:-back].astype(np.uint32) << np.uint32(8 * back)
    for place in range(ORDER - 1):  # a place after the end is in a later text, which clears more
        at = offsets[:-1] + place
        code[at[at < len(data)]] &= np.uint32((1 << 8 * (place + 1)) - 1)
    return code


def look_up_grams(table: np.ndarray, values: np.ndarray):
    """A function that gives the values of codes, all of which are in the sorted ``table``.

    Where few pairs of bytes occur, a code is a place in a table of first and last pairs.
    """
    first, last = distinct(table >> np.uint32(16)), distinct(table & np.uint32(0xFFFF))
    if len(first) * len(last) > DENSE:
        return lambda codes: values[np.searchsorted(table, codes)]
    row, column = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    row[first], column[last] = np.arange(len(first)) * len(last), np.arange(len(last))
    place = lambda codes: row[codes >> np.uint32(16)] + column[codes & np.uint32(0xFFFF)]
    dense = np.zeros(len(first) * len(last))
    dense[place(table)] = values
    return lambda codes: dense[place(codes)]


_ID = np.uint64((1 << ID_BITS) - 1)
_BLANK = np.isin(np.arange(256), list(BLANKS))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words: ``find_words`` for words between ``BLANKS``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = (data != 0x20) & (data - np.uint8(9) > 4)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    turns = edge[1:-1] | (inside[1:] != inside[:-1])  # where a word or a gap ends
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= turns
    finishes[:-1] &= turns
    starts = np.flatnonzero(begins)
    places = np.searchsorted(starts, offsets)
    return starts, np.flatnonzero(finishes) + 1, np.repeat(np.arange(len(offsets) - 1), np.diff(places))


_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight of its bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    lengths = ends - starts
    out = mix64((eight[starts] & _KEPT[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    done, left = 8, np.flatnonzero(lengths > 8)
    while len(left):
        part = eight[starts[left] + done] & _KEPT[np.minimum(lengths[left] - done, 8)]
        out[left] = mix64(mix64(out[left] + np.uint64(done)) ^ part)
        done, left = done + 8, left[lengths[left] > done + 8]
    return out


def word_grams(data: np.ndarray, offsets: np.ndarray, lang: str, words: int) -> tuple:
    """Starts, ends and text numbers of words, and (gram, context) for orders 1 to ``words``.

    Keys are 64-bit hashes with the language in them.  The context of an n-gram is
    the shorter one that ends at the word before; of a single word, the language.
    """
    starts, ends, of = words_of(data, offsets)
    own = word_hashes(data, starts, ends)
    root = np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))
    begins = np.ones(len(of), bool)
    begins[1:] = of[1:] != of[:-1]
    out, context = [], np.full(len(own), root, np.uint64)
    for k in range(1, words + 1):
        gram = mix64(mix64(context + np.uint64(k)) + own)
        out.append((gram.view(np.int64), context.view(np.int64)))
        context = np.zeros_like(gram)
        context[1:] = gram[:-1]
        context[begins] = mix64(np.array([root ^ np.uint64(k)]))[0]
    return starts, ends, of, out


def _all_grams(data: np.ndarray, offsets: np.ndarray, lang: str, words: int) -> tuple:
    """What ``word_grams`` gives, made in pieces that fit a processor's cache."""
    pieces, first = [], 0
    while first < len(offsets) - 1:
        last = max(int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1, first + 1)
        own = offsets[first:last + 1]
        starts, ends, of, found = word_grams(data[own[0]:own[-1]], own - own[0], lang, words)
        pieces.append((starts + own[0], ends + own[0], of + first, found))
        first = last
    none = np.zeros(0, np.int64)
    return *(np.concatenate([none, *(p[k] for p in pieces)]) for k in range(3)), [
        tuple(np.concatenate([none, *(p[3][k][i] for p in pieces)]) for i in (0, 1)) for k in range(words)]


def _by_language(batch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch (id, lang, text), by chunk and language: language, rows, bytes, offsets."""
    langs = np.array([x or "" for x in batch.column(1).to_pylist()], object)
    for first, last, data, offsets in chunks(batch.column(2), BLOCK_BYTES):
        for lang in sorted(set(langs[first:last])):
            own = np.flatnonzero(langs[first:last] == lang)
            parts = [data[offsets[i]:offsets[i + 1]] for i in own]
            sizes = [len(p) for p in parts]
            yield lang, own + first, np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").alias("text"))


def _texts(docs: DataFrame, known: Column, asked: bool = True) -> DataFrame:
    """Rows with whether they are trusted, and whether they are to be scored.  All passes over
    the texts read these columns, so that batches and blocks are the same in each."""
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"),
        known.alias("known"), F.lit(asked).alias("asked"))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all texts, pre-counted in the tasks."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            for lang, _, data, offsets in _by_language(batch):
                codes, n = np.unique(grams(data, offsets), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return _rows(docs).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("c"))


def _least_and_most(rows: DataFrame) -> DataFrame:
    """With d1, d2, d3, how much counts of 1, 2, and 3 or more lose; n1 to n4 are given."""
    y = F.expr("n1 / greatest(n1 + 2 * n2, 1)")
    part = lambda k, expr: F.least(F.lit(k - 0.05), F.greatest(F.lit(0.05), F.coalesce(F.expr(expr), F.lit(k / 2))))
    return rows.withColumn("y", y).withColumns({
        "d1": part(1, "1 - 2 * y * n2 / nullif(n1, 0)"), "d2": part(2, "2 - 3 * y * n3 / nullif(n2, 0)"),
        "d3": part(3, "3 - 4 * y * n4 / nullif(n3, 0)")})


def _discounts(counts: DataFrame) -> DataFrame:
    """_lang, d1, d2, d3 of each language."""
    n = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    return _least_and_most(counts.groupBy("lang").agg(*n)).select(F.col("lang").alias("_lang"), "d1", "d2", "d3")


def train(trusted: DataFrame, stored=stored) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to 4: (lang, gram, p) of what was seen, (lang, context, rest) of contexts.

    The highest order counts occurrences, lower orders distinct bytes before.
    """
    counts = {ORDER: stored(gram_counts(trusted), "kn-counts")}
    for k in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << 8 * k) - 1)
        counts[k] = stored(counts[k + 1].groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(
            F.count("*").alias("c")), "kn-counts")
    out = []
    for k in range(1, ORDER + 1):
        rows = counts[k].join(F.broadcast(_discounts(counts[k])), F.col("lang") == F.col("_lang")).drop("_lang")  # a row a language
        rows = rows.withColumn("context", F.shiftright("gram", 8)).withColumn(
            "d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        sums = rows.groupBy("lang", "context").agg(F.sum("c").alias("s"), F.sum("d").alias("lost"))
        rest = stored(sums.select("lang", "context", "s", (F.col("lost") / F.col("s")).alias("rest")), "kn-rest")
        seen = rows.join(rest, ["lang", "context"]).withColumn("own", (F.col("c") - F.col("d")) / F.col("s"))
        if k == 1:
            seen = seen.withColumn("p", F.col("own") + F.col("rest") / 256)
        else:
            below = out[-1][0].select("lang", F.col("gram").alias("_tail"), F.col("p").alias("_p"))
            seen = seen.withColumn("_tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(
                below, ["lang", "_tail"]).withColumn("p", F.col("own") + F.col("rest") * F.col("_p"))
        out.append((stored(seen.select("lang", "gram", "p"), "kn-seen"), rest.select("lang", "context", "rest")))
    return out


def count_words(trusted: DataFrame, words: int) -> DataFrame:
    """lang, order, context, gram, c of all n-grams.

    The highest order counts occurrences, lower orders distinct words before.
    """
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            for lang, _, data, offsets in _by_language(batch):
                *_, found = _all_grams(data, offsets, lang, words)
                for k, (gram, context) in enumerate(found, 1):
                    longer = gram if k == words else found[k][0]  # what is counted; it holds the n-gram
                    sub, first, n = np.unique(longer, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), k, np.int32)), pa.array(context[first]),
                         pa.array(gram[first]), pa.array(sub if k < words else np.zeros_like(sub)), pa.array(n.astype(np.int64))],
                        ["lang", "order", "context", "gram", "longer", "n"])

    keys = ["lang", "order", "context", "gram"]
    rows = _rows(trusted).mapInArrow(count, "lang string, order int, context long, gram long, longer long, n long")
    return rows.groupBy(*keys, "longer").agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        F.sum(F.when(F.col("order") == words, F.col("n")).otherwise(1)).alias("c"))


def _contexts(counts: DataFrame) -> DataFrame:
    """lang, order, key, more, n1, n2, n3: how many n-grams of a context have a count of 1,
    2, and 3 or more, and what counts beyond 3 add to their sum."""
    some = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return counts.groupBy("lang", "order", F.col("context").alias("key")).agg(
        F.sum(F.greatest(F.col("c") - 3, F.lit(0))).alias("more"), some(F.col("c") == 1).alias("n1"),
        some(F.col("c") == 2).alias("n2"), some(F.col("c") >= 3).alias("n3"))


def _count_sums(counts: DataFrame) -> DataFrame:
    """lang, order, n1 to n4, more, total: how many n-grams have a count of 1 to 4, or of
    more, and the sum of counts; to be added up over parts."""
    n = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    return counts.groupBy("lang", "order").agg(*n, F.sum(F.when(F.col("c") > 4, 1).otherwise(0)).alias("more"), F.sum("c").alias("total"))


def _word_discounts(sums: DataFrame) -> DataFrame:
    """_lang, _order, d1, d2, d3 as the bytes have them; and total and rest of the context of
    all words of the language (of order 1 only)."""
    added = sums.groupBy("lang", "order").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "more", "total")))
    n = [F.col(f"n{k}").cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    d = _least_and_most(added.select("lang", "order", *n, "more", "total"))
    lost = F.expr("n1 * d1 + n2 * d2 + (n3 + n4 + more) * d3")
    return d.select(F.col("lang").alias("_lang"), F.col("order").alias("_order"), "d1", "d2", "d3",
                    F.col("total").cast("double").alias("total"), (lost / F.col("total")).alias("rest"))


def train_words(trusted: DataFrame, words: int) -> DataFrame:
    """key, num, total, rest: of n-grams the discounted count, of contexts the sum of
    counts and the share that goes to the shorter n-gram.  The whole model as one table.
    """
    counts = stored(count_words(trusted, words), "kn-words")
    d = F.broadcast(_word_discounts(_count_sums(counts)).drop("total", "rest"))  # a row a language and order
    known = lambda rows: rows.join(d, (F.col("lang") == F.col("_lang")) & (F.col("order") == F.col("_order")))
    own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    none = F.lit(None).cast("double")
    grams = known(counts).select(F.col("gram").alias("key"), (F.col("c") - own).alias("num"), none.alias("total"), none.alias("rest"))
    contexts = known(_contexts(counts)).withColumn("total", F.expr("cast(more + n1 + 2 * n2 + 3 * n3 as double)")).select(
        "key", none.alias("num"), "total",
        F.expr("(n1 * d1 + n2 * d2 + n3 * d3) / total").alias("rest"))
    return stored(grams.unionByName(contexts).groupBy("key").agg(*(F.max(c).alias(c) for c in ("num", "total", "rest"))), "kn-words")


def _pack(*columns: np.ndarray, rising: bool = True) -> bytes:
    """Columns of 8-byte values in few bytes; rising: the first is of sorted numbers."""
    import pyarrow as pa

    first = np.diff(columns[0], prepend=columns[0].dtype.type(0)) if rising else columns[0]
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(first), 8).T.ravel() for c in (first, *columns[1:])]
    return len(first).to_bytes(8, "little") + pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, columns: int, rising: bool = True) -> np.ndarray:
    """What was packed, as rows of unsigned numbers."""
    import pyarrow as pa

    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros((columns, 0), np.uint64)
    raw = pa.decompress(blob[8:], decompressed_size=8 * n * columns, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, n).transpose(0, 2, 1)
    out = np.array(planes, order="C").view(np.uint64)[:, :, 0]
    if rising:
        out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _mine(keys: np.ndarray, part: int, bits: int) -> np.ndarray:
    """Whether keys are of the part, which their first ``bits`` name."""
    return keys >> np.uint64(64 - bits) == np.uint64(part) if bits else np.ones(len(keys), bool)


def _shards(keys: np.ndarray, part_bits: int, bits: int) -> np.ndarray:
    """The shard of each key of a part: the next ``bits``."""
    return ((keys << np.uint64(part_bits)) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def _level_keys(found: list, level: int, part: int = 0, bits: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the n-grams of so many words and of the contexts of those a word longer: the sorted
    distinct keys of this part; of each word the place of its n-gram among them, and that of the
    context of its longer n-gram; -1 in other parts."""
    gram = found[level - 1][0].view(np.uint64)
    own = np.flatnonzero(_mine(gram, part, bits))
    if level == len(found):
        keys, place = np.unique(gram[own], return_inverse=True)
        rank = np.full(len(gram), -1)
        rank[own] = place
        return keys, rank, np.full(len(gram), -1)
    context = found[level][1].view(np.uint64)
    begins = np.ones(len(gram), bool)
    begins[1:] = context[1:] != gram[:-1]
    first = distinct(context[begins])
    first = first[_mine(first, part, bits)]
    keys, place = np.unique(np.concatenate([gram[own], first]), return_inverse=True)
    rank = np.full(len(gram), -1)
    rank[own] = place[:len(own)]
    after = np.full(len(gram), -1)
    after[1:] = rank[:-1]
    after[begins] = -1
    if len(first):
        at = np.minimum(np.searchsorted(first, context[begins]), len(first) - 1)
        after[begins] = np.where(first[at] == context[begins], place[len(own):][at], -1)
    return keys, rank, after


def _distinct(rank: np.ndarray, ids: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct pairs of a place and an id, and which of them each pair is."""
    if ranks <= 1 << (64 - ID_BITS):
        pairs, place = np.unique(rank.astype(np.uint64) << np.uint64(ID_BITS) | ids, return_inverse=True)
        return (pairs >> np.uint64(ID_BITS)).astype(np.int64), pairs & _ID, place
    order = np.lexsort((ids, rank))
    new = np.ones(len(order), bool)
    new[1:] = (rank[order][1:] != rank[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return rank[order][new].astype(np.int64), ids[order][new], place


def _followers(found: list, after: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the longest n-grams whose contexts are in this part: the distinct ones, as places of
    contexts and ids; the words that end one, and which of them it is.

    An id is the last bits of a key: it tells the n-grams of one context apart.
    """
    own = np.flatnonzero(after >= 0)
    return *_distinct(after[own], found[-1][0].view(np.uint64)[own] & _ID, keys), own


ASKED = "shard int, lang string, role int, block long, asked boolean, taught boolean, keys binary, prefixes binary, followers binary, before binary"
TOLD = "kind int, block long, place long, lang string, n int, keys binary, followers binary, sums array<long>"


def _asking(level: int, words: int, part: int, part_bits: int, bits: int):
    """Of each block and shard what it asks for and what its known texts teach, packed.

    keys: the n-grams of ``level`` words; how many followers each has, and how many n-grams
    a word longer end in it in known texts.  prefixes: the contexts of those that known
    texts hold.  followers: of the longest n-grams ids and how often known texts hold them.
    before: ids of the longer n-grams that are counted.
    """
    import pyarrow as pa

    names = [x.split()[0] for x in ASKED.split(", ")]

    def ask(batches):
        for batch in batches:
            known = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for block, lang, _, rows, data, offsets in _named([batch]):
                _, _, of, found = _all_grams(data, offsets, lang, min(level + 1, words))
                keys, rank, after = _level_keys(found, level, part, part_bits)
                if not len(keys):
                    continue
                taught = known[rows][of]
                held = np.flatnonzero(taught & (rank >= 0))
                none, nothing = np.zeros(0, np.uint64), np.zeros(len(keys), np.int64)
                follows = follower = before = prefix = none
                n = many = ends = nothing
                if level == words - 1:
                    follows, follower, place, own = _followers(found, after, len(keys))
                    many = np.bincount(follows, minlength=len(keys))
                    n = np.bincount(place, weights=taught[own], minlength=len(follower)).astype(np.int64)
                if words == 1:
                    ends = np.bincount(rank[held], minlength=len(keys))
                elif len(held):
                    tails, before, _ = _distinct(rank[held], found[level][0].view(np.uint64)[held] & _ID, len(keys))
                    ends = np.bincount(tails, minlength=len(keys))
                if level > 1:
                    prefix = np.zeros(len(keys), np.uint64)
                    prefix[rank[held]] = found[level - 1][1].view(np.uint64)[held]
                shards = _shards(keys, part_bits, bits)
                own = distinct(shards)
                cuts = np.searchsorted(shards, [*own.tolist(), own[-1] + 1])
                to_follower, to_before = (np.concatenate([[0], np.cumsum(x)]) for x in (many, ends))
                out = [[], [], [], []]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    f, g = slice(to_follower[a], to_follower[b]), slice(to_before[a], to_before[b])
                    out[0].append(_pack(keys[a:b], many[a:b].astype(np.int64), ends[a:b].astype(np.int64)))
                    out[1].append(_pack(prefix[a:b][ends[a:b] > 0], rising=False) if level > 1 else b"")
                    out[2].append(_pack(follower[f], n[f], rising=False) if level == words - 1 else b"")
                    out[3].append(_pack(before[g], rising=False) if words > 1 else b"")
                some = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array([lang] * some), pa.array(np.ones(some, np.int32)), pa.array(np.full(some, block)),
                     pa.array([bool(batch.column(4)[0].as_py())] * some), pa.array([bool(len(held) or n.any())] * some),
                     *(pa.array(x, pa.binary()) for x in out)], names)
    return ask


def _summed(part: int, part_bits: int, bits: int):
    """Rows of the contexts' sums that the longer n-grams gave, by part and shard."""
    import pyarrow as pa

    names = [x.split()[0] for x in ASKED.split(", ")]

    def split(batches):
        for batch in batches:
            for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                table = _unpack(blob.as_py(), 5)
                table = table[:, _mine(table[0], part, part_bits)]
                shards = _shards(table[0], part_bits, bits)
                own = distinct(shards)
                packed = [_pack(*table[:, a:b]) for a, b in zip(np.searchsorted(shards, own), np.searchsorted(shards, own, "right"))]
                some, empty = len(own), pa.array([b""] * len(own), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array([lang] * some, pa.string()), pa.array(np.zeros(some, np.int32)), pa.array(np.zeros(some, np.int64)),
                     pa.array([False] * some, pa.bool_()), pa.array([False] * some, pa.bool_()), pa.array(packed, pa.binary()), empty, empty, empty], names)
    return split


def _classes(c: np.ndarray) -> list[int]:
    """n1 to n4, more, total: how many counts are 1 to 4, or more, and their sum."""
    n = np.bincount(np.minimum(c, 5), minlength=6)
    return [*(int(x) for x in n[1:6]), int(c.sum())]


def _by_key(keys: np.ndarray, c: np.ndarray, size: int) -> list[np.ndarray]:
    """Of each place in ``keys``: more, n1, n2, n3 over its counts."""
    return [np.bincount(keys, weights=x, minlength=size).astype(np.int64) for x in (np.maximum(c - 3, 0), c == 1, c == 2, c >= 3)]


def _told_shard(level: int, words: int, sums: list[bytes], blobs: list[tuple]) -> tuple[list, list, list]:
    """A language's shard: (block, keys, followers) of the blocks that ask, packed; (n, classes);
    and the sums of the contexts, packed.

    Told are of a key its count, and more, n1, n2, n3 of the n-grams it is the context of; of a
    follower its count.  Zeros for what was not seen.
    """
    none, nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cat = lambda x, empty: np.concatenate([empty, *x])
    taught = [(_unpack(keys, 3), prefixes, followers, before) for _, _, known, keys, prefixes, followers, before in blobs if known]
    table = distinct(cat((x[0] for x, *_ in taught), none))
    at = [np.searchsorted(table, x[0]) for x, *_ in taught]
    counts, classes, passed = np.zeros(len(table), np.int64), [], []
    if words == 1:
        for place, (x, *_) in zip(at, taught):
            counts[place] += x[2].view(np.int64)
    else:
        tails = cat((np.repeat(place, x[2].view(np.int64)) for place, (x, *_) in zip(at, taught)), nothing)
        tails, *_ = _distinct(tails, cat((_unpack(x[3], 1, False)[0] for x in taught), none), len(table))
        counts = np.bincount(tails, minlength=len(table))
    context, follows, follower, held = [np.zeros(len(table), np.int64) for _ in range(4)], nothing, none, nothing
    if level == words - 1:
        pairs = [_unpack(x[2], 2, False) for x in taught]
        own = cat((np.repeat(place, x[1].view(np.int64))[y[1] > 0] for place, (x, *_), y in zip(at, taught, pairs)), nothing)
        follows, follower, place = _distinct(own, cat((y[0][y[1] > 0] for y in pairs), none), len(table))
        held = np.bincount(place, weights=cat((y[1][y[1] > 0].view(np.int64) for y in pairs), nothing), minlength=len(follower)).astype(np.int64)
        context = _by_key(follows, held, len(table))
        classes.append((words, _classes(held)))
    classes.append((level, _classes(counts[counts > 0])))
    if level > 1:
        prefix = np.zeros(len(table), np.uint64)
        for place, (x, prefixes, *_) in zip(at, taught):
            prefix[place[x[2] > 0]] = _unpack(prefixes, 1, False)[0]
        lower, place = np.unique(prefix[counts > 0], return_inverse=True)
        if len(lower):
            passed = [_pack(lower, *_by_key(place, counts[counts > 0], len(lower)))]
    lower = [_unpack(x, 5) for x in sums]
    above, place = np.unique(cat((x[0] for x in lower), none), return_inverse=True)
    above_sums = [np.bincount(place, weights=cat((x[k].view(np.int64) for x in lower), nothing), minlength=len(above)).astype(np.int64) for k in range(1, 5)]

    def look_up(known, keys, columns):
        if not len(known):
            return [np.zeros(len(keys), np.int64) for _ in columns], np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        seen = known[place] == keys
        return [np.where(seen, x[place], 0) for x in columns], np.where(seen, place, -1)

    pairs = follows.astype(np.uint64) << np.uint64(ID_BITS) | follower if len(table) <= 1 << (64 - ID_BITS) else None
    where = np.searchsorted(follows, np.arange(len(table) + 1)) if pairs is None else None
    told = []
    for block, asks, _, keys, _, followers, _ in blobs:
        if not asks:
            continue
        x = _unpack(keys, 3)
        (c, *own), place = look_up(table, x[0], [counts, *context])
        if level < words - 1:
            own, _ = look_up(above, x[0], above_sums)
        answer = b""
        if level == words - 1:
            ids = _unpack(followers, 2, False)[0]
            of = np.repeat(place, x[1].view(np.int64))
            c_follower = np.zeros(len(ids), np.int64)
            some = np.flatnonzero(of >= 0)
            if pairs is not None:
                (c_follower[some],), _ = look_up(pairs, of[some].astype(np.uint64) << np.uint64(ID_BITS) | ids[some], [held])
            else:
                for k in some.tolist():
                    a, b = where[of[k]], where[of[k] + 1]
                    j = a + int(np.searchsorted(follower[a:b], ids[k]))
                    c_follower[k] = held[j] if j < b and follower[j] == ids[k] else 0
            answer = _pack(c_follower, rising=False)
        told.append((block, _pack(c, *own, rising=False), answer))
    return told, classes, passed


def told_words(asked: DataFrame, level: int, words: int, part: int, shards: int) -> DataFrame:
    """What all shards tell (kind 0), the classes of counts (1), the sums of shorter contexts (2)."""
    import pyarrow as pa

    def answer(batches):
        at, sums, blobs = None, [], []

        def rows():
            told, classes, passed = _told_shard(level, words, sums, blobs)
            place = (level << 56) + (part << 40) + at[0]
            out = [(0, block, place, at[1], 0, keys, followers, None) for block, keys, followers in told]
            out += [(1, 0, place, at[1], n, None, None, numbers) for n, numbers in classes]
            out += [(2, 0, place, at[1], 0, blob, None, None) for blob in passed]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], [x.split()[0] for x in TOLD.split(", ")])

        for batch in batches:
            shard, lang, role = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for j in range(batch.num_rows):
                if at != (shard[j], lang[j]):
                    if at is not None:
                        yield rows()
                    at, sums, blobs = (shard[j], lang[j]), [], []
                if role[j] == 0:
                    sums.append(batch.column(6)[j].as_py())
                else:
                    blobs.append(tuple(batch.column(k)[j].as_py() for k in range(3, 10)))
        if at is not None:
            yield rows()

    met = asked.repartition(shards, "shard", "lang").sortWithinPartitions("shard", "lang", "role")
    return met.mapInArrow(answer, TOLD)


def _word_values(found: list, told: dict[int, list[np.ndarray]], numbers: list) -> list[list[np.ndarray]]:
    """Of each order num, total and rest of every word, from what the block was told of each
    level; not a number where nothing was seen.

    told: of a level the numbers of its keys, and those of the followers.
    numbers: of each order d1, d2, d3, total, rest; empty if the language has no trusted words.
    """
    size, words = len(found[0][0]), len(found)
    out = [[np.full(size, np.nan) for _ in range(3)] for _ in found]
    if not numbers or not size:
        return out
    out[0][1][:], out[0][2][:] = numbers[0][3:]

    def num(order, c):
        return np.where(c > 0, c - np.array([0, *numbers[order - 1][:3]])[np.minimum(c, 3)], np.nan)

    for level in range(1, max(words, 2)):
        keys, rank, after = _level_keys(found, level)
        answers, followers = told[level]
        if answers.shape[1] != len(keys):
            raise ValueError(f"a block asked for {len(keys)} n-grams and was told of {answers.shape[1]}")
        out[level - 1][0] = num(level, answers[0])[rank]
        if level < words:
            d1, d2, d3, *_ = numbers[level]
            more, n1, n2, n3 = answers[1:]
            total = (more + n1 + 2 * n2 + 3 * n3).astype(float)
            total[total == 0] = np.nan
            out[level][1:] = total[after], ((n1 * d1 + n2 * d2 + n3 * d3) / total)[after]
        if level == words - 1:
            ids, _, place, own = _followers(found, after, len(keys))  # all words, as all contexts are asked for
            if len(ids) != followers.shape[1] or len(own) != size:
                raise ValueError("a block was told of other n-grams than it asked for")
            out[level][0] = num(words, followers[0])[place]
    return out


def _interpolated(orders: list[list[np.ndarray]], spelled: np.ndarray) -> np.ndarray:
    """Log probability of each word from num, total, rest of each order; ``spelled``: that of its bytes."""
    part, left = np.zeros(len(spelled)), np.ones(len(spelled))
    for num, total, rest in reversed(orders):
        known = ~np.isnan(total)
        seen = known & ~np.isnan(num)
        part += np.where(seen, left * num / np.where(known, total, 1), 0)
        left *= np.where(known, rest, 1)
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(part), np.log(left) + spelled)


def _word_logs(found: list, spelled: np.ndarray, table: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """``_interpolated`` by a whole table as of ``train_words``.  A key that has no row was not seen."""
    def of(keys, x):
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, x[at], np.nan)

    return _interpolated([[of(gram, values[0]), of(context, values[1]), of(context, values[2])] for gram, context in found], spelled)


def probabilities(wanted: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """lang, gram, logp of distinct n-grams: joins with the counts of each order.

    A language without trusted text gives every byte 1/256.
    """
    rows, p = wanted, F.lit(1 / 256)
    for k, (seen, rest) in enumerate(model, 1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        own = seen.select(F.col("lang"), F.col("gram").alias("_tail"), F.col("p").alias(f"_p{k}"))
        left = rest.select(F.col("lang"), F.col("context").alias("_context"), F.col("rest").alias(f"_r{k}"))
        rows = rows.withColumn("_tail", tail).join(own, ["lang", "_tail"], "left").drop("_tail")
        rows = rows.withColumn("_context", F.shiftright(tail, 8)).join(left, ["lang", "_context"], "left").drop("_context")
        p = F.coalesce(F.col(f"_p{k}"), F.coalesce(F.col(f"_r{k}"), F.lit(1.0)) * p)
    return rows.select("lang", "gram", F.log(p).alias("logp"))


def _named(batches):
    """Blocks of a task, named by their content, so that both passes over the texts
    name them alike; equal blocks ask and are answered alike."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for lang, rows, data, offsets in _by_language(batch):
            h = blake2b(data, digest_size=8)
            h.update(repr((lang, offsets.tolist(), [ids[i] for i in rows.tolist()])).encode())
            yield int.from_bytes(h.digest(), "little", signed=True), lang, batch, rows, data, offsets


def _code_shards(codes: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each byte n-gram."""
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)


def byte_answers(texts: DataFrame, model: list[tuple[DataFrame, DataFrame]], scratch: Scratch) -> DataFrame:
    """block, shard, logs: what the sorted distinct byte n-grams of a block cost, as bytes of
    doubles, by shard.

    Blocks ask in packed rows; a row for each n-gram is made of the distinct ones only.
    """
    import pyarrow as pa

    def ask(batches):
        for block, lang, _, _, data, offsets in _named(batches):
            codes = distinct(grams(data, offsets))
            shards = _code_shards(codes, CODE_BITS)
            own = distinct(shards)
            packed = [_pack(codes[shards == x].astype(np.uint64)) for x in own.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), block)), pa.array([lang] * len(own), pa.string()), pa.array(own), pa.array(packed, pa.binary())],
                ["block", "lang", "shard", "codes"])

    def names(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = distinct(np.concatenate([_unpack(batch.column(1)[j].as_py(), 1)[0] for j in np.flatnonzero(langs == lang).tolist()]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64))], ["lang", "gram"])

    def number(batches):
        for batch in batches:
            shards = _code_shards(batch.column(1).to_numpy(), CODE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards)], ["lang", "gram", "logp", "shard"])

    def answer(batches):
        at, known = None, []
        for batch in batches:
            lang, shard = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            role, gram, logp = (batch.column(k).to_numpy() for k in (2, 3, 4))
            codes, out = batch.column(5), []
            new = np.ones(len(role), bool)
            new[1:] = (shard[1:] != shard[:-1]) | (role[1:] != role[:-1])
            new[1:] |= np.array([a != b for a, b in zip(lang[1:], lang[:-1])], bool)
            edges = np.flatnonzero(new).tolist()
            for first, last in zip(edges, [*edges[1:], len(role)]):
                if at != (lang[first], shard[first]):
                    at, known = (lang[first], shard[first]), []
                if role[first] == 0:
                    known.append((gram[first:last].copy(), logp[first:last].copy()))
                    continue
                table, logs = (np.concatenate(x) for x in zip(*known))
                for j in range(first, last):
                    asked = _unpack(codes[j].as_py(), 1)[0].view(np.int64)
                    out.append((gram[j], shard[j], logs[np.searchsorted(table, asked)].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], ["block", "shard", "logs"])

    asked = scratch.stored(texts.mapInArrow(ask, "block long, lang string, shard int, codes binary"), "kn-asked")
    wanted = asked.select("lang", "codes").mapInArrow(names, "lang string, gram long").distinct()
    known = scratch.stored(probabilities(wanted, model).mapInArrow(number, "lang string, gram long, logp double, shard int"), "kn-known")
    both = known.select("lang", "shard", F.lit(0).alias("role"), "gram", "logp", F.lit(None).cast("binary").alias("codes")).unionByName(
        asked.select("lang", "shard", F.lit(1).alias("role"), F.col("block").alias("gram"), F.lit(0.0).alias("logp"), "codes"))
    met = both.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "role", "gram")
    answers = scratch.stored(met.mapInArrow(answer, "block long, shard int, logs binary"), "kn-logs")
    scratch.removed("kn-asked", "kn-known")
    return answers


def word_answers(texts: list[DataFrame], words: int, size: int, scratch: Scratch, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """What ``told_words`` tells the blocks, and the discounts of each order.

    One part of the n-grams at a time is asked for, counted and told: the longest and their
    contexts first, then what is shorter.  size: bytes of the texts.  Tables of texts are
    read one by one: a union may join their partitions, and so their blocks.
    """
    told, passed = [], []
    for level in range(max(words - 1, 1), 0, -1):
        own = parts if level > 1 or words < 3 else max(1, parts // 2)
        part_bits, sums, passed = own.bit_length() - 1, passed, []
        shards = max(1, int(np.ceil(size * PACKED / own / SHARD_BYTES)))
        bits = (shards - 1).bit_length()
        for part in range(own):
            asked = [x.mapInArrow(_asking(level, words, part, part_bits, bits), ASKED) for x in texts]
            asked += [x.mapInArrow(_summed(part, part_bits, bits), ASKED) for x in sums]
            told.append(scratch.stored(told_words(functools.reduce(DataFrame.unionByName, asked), level, words, part, 1 << bits), "kn-told"))
            passed.append(told[-1].where("kind = 2").select("lang", "keys"))
    every = functools.reduce(DataFrame.unionByName, told)
    sums = every.where("kind = 1").select("lang", F.col("n").alias("order"), *(
        F.col("sums")[k].alias(c) for k, c in enumerate(("n1", "n2", "n3", "n4", "more", "total"))))
    discounts = scratch.stored(_word_discounts(sums).where("total > 0"), "kn-discounts")
    return every.where("kind = 0").select("block", "place", "keys", "followers"), discounts


def scores(texts: DataFrame, logs: DataFrame, told: DataFrame | None = None, discounts: DataFrame | None = None,
           words: int = 0, rounds: int = 1, turn: int = 0) -> DataFrame:
    """doc_id, lang, n_bytes, and of every row what a byte costs (null for an empty text):
    perplexity by the byte n-grams alone, word_perplexity with the word n-grams on top.

    logs, told, discounts: of ``byte_answers`` and ``word_answers``; of rounds, only the blocks of this turn.
    """
    import pyarrow as pa

    def keep(batches):
        for block, lang, batch, rows, _, _ in _named(batches):
            if block % rounds != turn:
                continue
            sink = pa.BufferOutputStream()
            part = batch.select([0, 1, 2]).take(pa.array(rows))
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([lang]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "lang", "texts"])

    none = lambda kind: F.lit(None).cast(kind)
    numbers = "array<array<double>>"
    texts = texts.mapInArrow(keep, "block long, lang string, texts binary")
    wanted = F.pmod("block", F.lit(rounds)) == turn
    logs = logs.where(wanted)
    if told is None:
        texts = texts.withColumn("numbers", none(numbers))
    else:
        own = discounts.groupBy("_lang").agg(F.transform(F.array_sort(F.collect_list(  # a row an order
            F.struct("_order", F.array("d1", "d2", "d3", "total", "rest")))), lambda x: x["col2"]).alias("numbers"))
        texts = texts.join(F.broadcast(own), F.col("lang") == F.col("_lang"), "left").drop("_lang")  # a row a language
    both = logs.select("block", F.lit(0).alias("role"), F.col("shard").cast("long").alias("place"), F.col("logs").alias("texts"),
                       none("binary").alias("contexts"), none(numbers).alias("numbers"))
    both = both.unionByName(texts.select("block", F.lit(2).alias("role"), F.lit(0).cast("long").alias("place"), "texts",
                                         none("binary").alias("contexts"), "numbers"))
    if told is not None:
        both = both.unionByName(told.where(wanted).select("block", F.lit(1).alias("role"), "place", F.col("keys").alias("texts"),
                                                         F.col("followers").alias("contexts"), none(numbers).alias("numbers")))
    met = both.repartition("block").sortWithinPartitions("block", "role", "place")

    def score(batches):
        at, value, told = None, {}, {}
        for batch in batches:
            block, role, place = (batch.column(k).to_numpy() for k in range(3))
            for j in range(batch.num_rows):
                if at != block[j]:
                    at, value, told = block[j], {}, {}
                if role[j] == 0:
                    value[int(place[j])] = np.frombuffer(batch.column(3)[j].as_py(), np.float64)
                elif role[j] == 1:  # equal blocks are told the same
                    told.setdefault(int(place[j]), (batch.column(3)[j].as_py(), batch.column(4)[j].as_py()))
                else:
                    with pa.ipc.open_stream(batch.column(3)[j].as_buffer()) as stream:
                        yield scored(stream.read_all().combine_chunks(), value, told, batch.column(5)[j].as_py() or [])

    def scored(part, value, told, numbers):
        lang = part.column(1)[0].as_py() or ""
        pieces = [(data, offsets) for _, _, data, offsets in chunks(part.column(2))]
        codes = [grams(*x) for x in pieces]
        table = distinct(np.concatenate([np.zeros(0, np.uint32), *(distinct(x) for x in codes)]))
        shards, logs = _code_shards(table, CODE_BITS), np.zeros(len(table))
        for k, x in value.items():
            logs[shards == k] = x
        cost = look_up_grams(table, logs)
        if words:
            levels = {}
            for place in sorted(told):
                keys, followers = told[place]
                levels.setdefault(place >> 56, []).append(
                    (_unpack(keys, 5, False).view(np.int64), _unpack(followers or bytes(8), 1, False).view(np.int64)))
            told = {k: [np.concatenate(x, 1) for x in zip(*v)] for k, v in levels.items()}
            every = [_all_grams(*x, lang, words) for x in pieces]
            found = [tuple(np.concatenate([x[3][k][i] for x in every]) for i in (0, 1)) for k in range(words)]
            orders, done = _word_values(found, told, numbers), 0
        n, total, by_words = [], [], []
        for j, ((data, offsets), own_codes) in enumerate(zip(pieces, codes)):
            size = np.diff(offsets)
            sums, worded = np.zeros(len(size)), np.zeros(len(size))
            if len(data):
                own = cost(own_codes)
                some = np.flatnonzero(size)
                sums[some] = np.add.reduceat(own, offsets[:-1][some])
                if words:
                    starts, ends, *_ = every[j]
                    if len(starts):
                        own_orders = [[x[done:done + len(starts)] for x in order] for order in orders]
                        done += len(starts)
                        edges = np.stack([starts, ends], 1).ravel()
                        spelled = np.add.reduceat(np.append(own, 0.0), edges)[::2]
                        own[~_BLANK[data]] = 0  # a word counts at its first byte
                        own[starts] = _interpolated(own_orders, spelled)
                worded[some] = np.add.reduceat(own, offsets[:-1][some])
            n += size.tolist()
            total += sums.tolist()
            by_words += (worded if words else sums).tolist()
        per, per_worded = ([float(np.exp(-t / k)) if k else None for t, k in zip(x, n)] for x in (total, by_words))
        return pa.RecordBatch.from_arrays(
            [part.column(0).combine_chunks(), part.column(1).combine_chunks(), pa.array(n, pa.int64()),
             pa.array(per, pa.float64()), pa.array(per_worded, pa.float64())],
            ["doc_id", "lang", "n_bytes", "perplexity", "word_perplexity"])

    return met.mapInArrow(score, "doc_id long, lang string, n_bytes long, perplexity double, word_perplexity double")


def scores_in_rounds(docs: DataFrame, trusted: DataFrame, words: int, parts: int = PARTS, rounds: int = ROUNDS,
                     known: str | None = None) -> DataFrame:
    """``scores`` by models of the trusted texts, some blocks at a time; each table is
    removed after its last reader.  Few blocks are dealt with at once.

    known: the column of ``docs`` that marks the trusted ones, if there is one; else these are
    read beside them.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _texts(docs, F.col(known) if known else F.lit(False))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= FEW_BLOCKS * BLOCK_BYTES:
        parts = rounds = 1
    taught = [texts] if known else [texts, _texts(trusted, F.lit(True), False)]
    told, discounts = word_answers(taught, words, size, scratch, parts) if words else (None, None)
    logs = byte_answers(texts, train(trusted, scratch.stored), scratch)  # last, as the parts need the disk
    scratch.removed("kn-counts", "kn-rest", "kn-seen")
    out = [scratch.stored(scores(texts, logs, told, discounts, words, rounds, k), "kn-scores") for k in range(rounds)]
    scratch.removed("kn-logs", "kn-told", "kn-discounts")
    return functools.reduce(DataFrame.unionByName, out)


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE,
             calibration: float = CALIBRATION, words: int = WORDS) -> DataFrame:
    """Every row with both perplexities, their thresholds in its language, and kept.

    A row is kept if both are within their threshold.  words: of the longest word
    n-gram; 0 leaves the byte model alone, which can't tell good words in a bad
    order.

    trusted_ids: doc_id of the rows to learn from.  A share of them, picked by a
    hash of the id, is left out of the counts: the threshold is a quantile of the
    perplexities of these rows of that language, which are as new to the model as
    any other text.  With a share of 0 it is taken over all trusted rows.  A
    language without such rows keeps all its rows.  A null lang is a language of its own.  A null or empty
    text has no perplexity and is not kept.  Other columns play no part.
    """
    docs = docs.select("doc_id", "text", "lang")
    ids = stored(trusted_ids.select(F.col("doc_id").cast("long").alias("_id")).where("_id IS NOT NULL").distinct(), "kn-trusted")
    small = ids.count() <= BROADCAST_IDS
    apart = F.pmod(F.xxhash64("_id"), F.lit(1_000)) < int(calibration * 1_000)
    known, judges = ids.where(~apart), ids.where(apart) if calibration else ids
    known, judges = (F.broadcast(x) if small else x for x in (known, judges))
    trusted = docs.join(known, docs["doc_id"] == F.col("_id"), "left_semi")
    if small:
        marked = docs.join(known, docs["doc_id"] == F.col("_id"), "left").select(*docs.columns, F.col("_id").isNotNull().alias("_known"))
        scored = scores_in_rounds(marked, trusted, words, known="_known")
    else:  # a join would shuffle the texts
        scored = scores_in_rounds(docs, trusted, words)
    limits = scored.join(judges, F.col("doc_id") == F.col("_id"), "left_semi").groupBy(
        F.coalesce("lang", F.lit("")).alias("_lang")).agg(
            F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"),
            F.percentile_approx("word_perplexity", quantile, 10_000).alias("word_threshold"))
    within = lambda x, y: F.coalesce(F.col(x) <= F.coalesce(y, F.lit(float("inf"))), F.lit(False))
    return scored.join(F.broadcast(limits), F.coalesce("lang", F.lit("")) == F.col("_lang"), "left").select(  # a row a language
        "doc_id", "lang", "n_bytes", "perplexity", "threshold", "word_perplexity", "word_threshold",
        (within("perplexity", "threshold") & within("word_perplexity", "word_threshold")).alias("kept"))
