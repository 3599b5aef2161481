"""Packing documents into fixed-length training sequences.

The token ids of the documents of a partition form one stream.  Windows of at
most ``length`` ids cut it, in order, so that the padding plus a penalty for every
cut inside a document is least: a dynamic program over the ends of documents and
sentences, whose best predecessor within reach is at the head of a monotone queue.

A partition of the input is packed by its own task without a shuffle, block by
block; what a block leaves in its last window is carried into the next.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, functions as F

LENGTH = 2048
END = 1  # the id after a document
TOKENIZER = "word_bpe_49k.json"
#: Tokens that a cut costs, by where it is: after a document, a sentence, or elsewhere.
AFTER_DOCUMENT, AFTER_SENTENCE, ELSEWHERE = 0, 8, 24
WINDOW = 4  # and a window, so that small ones don't pay without need
STEP = 32  # places inside a long sentence where a cut is allowed
BLOCK_IDS = 1 << 18  # ids that are planned at once
CACHED_WORDS = 600_000

#: Punctuation that the tokenizer parts from letters and digits beside it (an apostrophe it may not).
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = 0x250  # letters below this are normalised, and lower-cased one by one


class Encoder:
    """Ids of whole texts as 32-bit bytes, with the ids of each word kept.

    Words are parted by blanks, which the tokenizer drops, and it lower-cases A-Z,
    so a text's ids are those of its words.  Texts with the opening of a special
    token keep their case, as special tokens have one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.stop = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            if re.fullmatch(r"[.!?]+[\"')\]]*</w>", token):
                self.stop[i] = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, _LATIN)}

    def _whole(self, word: bytes) -> bytes:
        """Ids of a word; one of Latin letters needs no more than the model."""
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < chr(_LATIN) and "\u0130" not in text:
            text = text.lower()
            if not text.isascii():
                text = text.translate(self.letters)
            ids = [t.id for t in self.model.tokenize(text)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.uint32).tobytes()

    def _get(self, word: bytes) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.known[word] = self._whole(word)
        return ids

    def _learn(self, word: bytes) -> bytes:
        core = word.strip(_MARKS)
        if core and len(core) < len(word) and core[:1].isalnum() and core[-1:].isalnum() and b"<|" not in word:
            at = word.index(core)
            head, tail = word[:at], word[at + len(core):]
            ids = (self._get(head) if head else b"") + self._get(core) + (self._get(tail) if tail else b"")
        else:
            ids = self._whole(word)
        self.known[word] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        out = []
        for text in texts:
            words = (text if b"<|" in text else text.lower()).split()
            ids = list(map(self.known.get, words))
            if None in ids:
                for i, own in enumerate(ids):
                    if own is None:
                        ids[i] = self.known.get(words[i]) or self._learn(words[i])
            out.append(b"".join(ids))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a tokenizer file: a path, or a name of a public one."""
    if name not in _encoders:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders[name] = Encoder(path)
    return _encoders[name]


def cut_places(ids: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in one document (counted in ids, its end last) where cuts are allowed, and penalties."""
    ends = np.flatnonzero(stop[ids[:-1]]) + 1
    ends = ends[ends < len(ids) - 1]  # what is left would be the end's id alone
    bounds = np.r_[0, ends, len(ids)]
    gaps = np.diff(bounds)
    inner = [np.arange(a + STEP, a + g, STEP) for a, g in zip(bounds[:-1][gaps > STEP], gaps[gaps > STEP])]
    where = np.concatenate([ends, *inner, [len(ids)]]).astype(np.int64)
    cost = np.full(len(where), ELSEWHERE)
    cost[:len(ends)] = AFTER_SENTENCE
    cost[-1] = AFTER_DOCUMENT
    order = np.argsort(where, kind="stable")
    return where[order], cost[order]


def is_power(n: int) -> bool:
    return n & (n - 1) == 0


def best_cuts(place: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Ends of the windows over [0, place[-1]], the cheapest way.

    ``place`` rises, its steps are at most ``length``.  A window of n ids costs
    length - n, or nothing if n is a power of two, WINDOW, and the cost of its end.
    """
    where = [0, *place.tolist()]
    price = [0, *cost.tolist()]
    price[-1] = 0
    # predecessors at the distance of a power of two, if that is a place
    spans = [1 << k for k in range(5, length.bit_length()) if 1 << k < length]
    points = np.array(where)
    exact: list[list[int]] = [[] for _ in where]
    for span in spans:
        at = np.searchsorted(points, points - span)
        for j in np.flatnonzero(points[np.minimum(at, len(points) - 1)] == points - span).tolist():
            exact[j].append(int(at[j]))
    best, before = [0.0] * len(where), [0] * len(where)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # best + place, rising from the head
    for j in range(1, len(where)):
        p = where[j]
        while p - where[queue[0][1]] > length:
            queue.popleft()
        value, i = queue[0]
        value += length - p
        for k in exact[j]:
            if best[k] < value:
                value, i = best[k], k
        value += price[j] + WINDOW
        best[j], before[j] = value, i
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(where) - 1
    while j:
        out.append(where[j])
        j = before[j]
    return out[::-1]


def last_cuts(n: int, length: int = LENGTH) -> list[int]:
    """Ends of the windows over a rest of n ids: one, or powers of two where that pays."""
    if not n:
        return []
    parts = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    if length - n <= (len(parts) - 1) * (ELSEWHERE + WINDOW):
        parts = [n]
    return np.cumsum(parts).tolist()


class _Stream:
    """The ids of a partition's documents that have no sequence yet."""

    def __init__(self, first_sequence: int, length: int):
        self.sequence, self.length = first_sequence, length
        self.docs: list[tuple] = []  # id, ids, start of what is left
        self.places: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray, stop: np.ndarray) -> None:
        place, cost = cut_places(ids, stop)
        self.docs.append((doc_id, ids, 0))
        self.places.append(place + self.size)
        self.costs.append(cost)
        self.size += len(ids)

    def flush(self, last: bool):
        """Pieces (doc_id, start, length, crc, doc ids, sequence, offset, ids) of full windows, or all."""
        if not self.size:
            return
        place, cost = np.concatenate(self.places), np.concatenate(self.costs)
        cuts = best_cuts(place, cost, self.length)
        kept = cuts[-2] if len(cuts) > 1 else 0  # the start of the last window
        if last:
            cuts = cuts[:-1] + [kept + c for c in last_cuts(self.size - kept, self.length)]
        else:
            cuts = cuts[:-1]
        at, d, begin = 0, 0, 0  # place, document, its place
        docs, rest = self.docs, 0
        for end in cuts:
            offset = 0
            while at < end:
                doc_id, ids, done = docs[d]
                left = len(ids) - done - (at - begin)
                n = min(left, end - at)
                start = done + at - begin
                own = ids[start:start + n]
                yield doc_id, start, n, zlib.crc32(own), len(ids), self.sequence, offset, own
                at, offset = at + n, offset + n
                if n == left:
                    d, begin = d + 1, at
            self.sequence += 1
        rest = docs[d:]
        if rest:
            doc_id, ids, done = rest[0]
            rest[0] = doc_id, ids, done + at - begin
        own = place > at
        self.docs, self.places, self.costs = rest, [place[own] - at], [cost[own]]
        self.size -= at


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
         length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document in a sequence.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` the ids.  A document is its ids and the end's id; a null or empty
    text is that one id.  Every row of ``docs`` is packed, repeated ones too.
    Sequences hold documents in the order of the input's partitions and never
    share one; sequence ids are unique, with gaps between partitions.  Other
    columns play no part.  An empty table has no sequence.
    """
    import pyarrow as pa

    fields = ["doc_id long", "start long", "length long", "ids_crc32 long", "doc_tokens long",
              "sequence_id long", "offset long"] + ["ids array<int>"] * with_ids
    names = [f.split()[0] for f in fields]
    types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        stream = _Stream(TaskContext.get().partitionId() << 36, length)

        def rows(last: bool):
            found = list(stream.flush(last))
            for a in range(0, len(found), 10_000):
                columns = list(zip(*found[a:a + 10_000]))[:7 + with_ids]
                if with_ids:
                    columns[7] = [x.view(np.int32) for x in columns[7]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary())
            step = 100
            for a in range(0, batch.num_rows, step):
                part = [t or b"" for t in texts.slice(a, step).to_pylist()]
                for doc_id, own in zip(ids_of[a:a + step], encode.encode(part)):
                    ids = np.empty(len(own) // 4 + 1, np.uint32)
                    ids[:-1] = np.frombuffer(own, np.uint32)
                    ids[-1] = END
                    stream.add(doc_id, ids, encode.stop)
                    if stream.size >= BLOCK_IDS:
                        yield from rows(False)
        yield from rows(True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(fields))
