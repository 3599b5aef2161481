"""Byte-level BPE: texts to ids and back, by the ranks of a public vocabulary.

A text is split by the vocabulary's pattern, and every match is encoded on its
own, in two tiers.  A minimal perfect hash (hash and displace: a seed for each
bucket of tokens sends them to places of their own, as many as there are tokens)
answers for whole matches that are tokens, a chunk of text at a time, and the
bytes are compared.  What is left goes through a heap of pairs over bytes linked
to their neighbours: the pair of least rank, leftmost on ties, is merged until no
pair is a token.  Both are map-only; a worker keeps a bounded number of ids of
matches it merged before.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from parapet.llm.shared import chunks, hash_words, mix64

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Ids of merged matches that a worker keeps.
KEPT_IDS = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def merged(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one match: pairs of neighbours in order of rank, leftmost first."""
    n, get = len(piece), ranks.get
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is gone
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = end[start]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two has been merged since
        end[start], end[middle] = stop, 0
        if stop < n:
            before[stop] = start
            if end[stop] - start <= longest and (rank := get(piece[start:end[stop]])) is not None:
                heapq.heappush(heap, (rank, start, end[stop]))
        first = before[start]
        if first >= 0 and stop - first <= longest and (rank := get(piece[first:stop])) is not None:
            heapq.heappush(heap, (rank, first, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


def _placed(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the buckets, and the number of the hash at each place.

    A bucket with one hash names its place directly, as -1 - place.
    """
    n = len(hashes)
    seeds, owner = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    bucket = (hashes % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
    groups = np.split(order, first[1:])
    for own in sorted(groups, key=len, reverse=True):
        if len(own) == 1:
            break
        seed = 1
        while True:
            at = (mix64(hashes[own] + np.uint64(seed * int(_STEP) % 2**64)) % np.uint64(n)).astype(np.int64)
            if (owner[at] < 0).all() and len(set(at.tolist())) == len(own):
                break
            seed += 1
        seeds[bucket[own[0]]], owner[at] = seed, own
    free = iter(np.flatnonzero(owner < 0).tolist())
    for own in groups:
        if len(own) == 1:
            place = next(free)
            seeds[bucket[own[0]]], owner[place] = -1 - place, own[0]
    return seeds, owner


@dataclass
class Vocabulary:
    """Tokens by rank, with their minimal perfect hash."""

    tokens: list[bytes]
    pattern: str
    ranks: dict[bytes, int] = field(init=False)

    def __post_init__(self):
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.longest = int(lengths.max())
        hashes = hash_words(self.data, self.starts, self.ends)
        kept = np.unique(hashes, return_index=True)[1]  # equal hashes: the rest is found by the second tier
        self.seeds, owner = _placed(hashes[kept])
        self.at_place, self.hashes = kept[owner], hashes
        self.ranks = {t: i for i, t in enumerate(self.tokens)}

    def whole(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of each part of the bytes that is a token, else -1."""
        hashes = hash_words(data, starts, ends)
        n = np.uint64(len(self.seeds))
        seed = self.seeds[(hashes % n).astype(np.int64)]
        place = (mix64(hashes + seed.astype(np.uint64) * _STEP) % n).astype(np.int64)
        rank = self.at_place[np.where(seed < 0, -1 - seed, place)]
        found = np.flatnonzero((self.hashes[rank] == hashes) & (self.ends[rank] - self.starts[rank] == ends - starts))
        out = np.full(len(starts), -1, np.int64)
        if len(found):
            own, lengths = rank[found], (ends - starts)[found]
            first = np.cumsum(lengths) - lengths
            step = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            same = data[step + np.repeat(starts[found], lengths)] == self.data[step + np.repeat(self.starts[own], lengths)]
            out[found] = np.where(np.logical_and.reduceat(same, first), own, -1)
        return out


def load(path: str, pattern: str) -> Vocabulary:
    """A rank file: lines of a token in base64 and its rank, ranks from 0 without gaps."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks have gaps")
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("a byte has no token")
    return Vocabulary(tokens, pattern)


def public_vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """One of the installed public vocabularies."""
    import public_tokenizers

    return load(public_tokenizers.path(name), public_tokenizers.PATTERN)


class Encoder:
    """Ids of texts in a worker."""

    def __init__(self, vocabulary: Vocabulary, kept_ids: int = KEPT_IDS):
        import regex

        self.vocabulary, self.kept_ids = vocabulary, kept_ids
        self.split = regex.compile(vocabulary.pattern).findall
        self._forget()

    def _forget(self):
        self.known: dict[bytes, int] = {}
        self.ids, self.stops = array("I"), array("q", [0])

    def _number(self, piece: bytes) -> int:
        number = self.known.get(piece)
        if number is None:
            own = self.vocabulary.ranks.get(piece)
            self.ids.extend([own] if own is not None else merged(piece, self.vocabulary.ranks, self.vocabulary.longest))
            number = self.known[piece] = len(self.stops) - 1
            self.stops.append(len(self.ids))
        return number

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each text's ids."""
        raw = data.tobytes()
        lengths, pieces = [], np.zeros(len(offsets) - 1, np.int64)
        for i in range(len(offsets) - 1):
            own = self.split(raw[offsets[i]:offsets[i + 1]].decode())
            lengths.append(np.fromiter(map(len, own), np.int64, len(own)))
            pieces[i] = len(own)
        # matches tile the text: their ends in characters, then in bytes
        ends = np.cumsum(np.concatenate(lengths)) if lengths else np.zeros(0, np.int64)
        if not len(ends):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts_of = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.append(starts_of, len(data))[ends]
        starts = np.r_[0, ends[:-1]]
        rank = self.vocabulary.whole(data, starts, ends)
        left = np.flatnonzero(rank < 0)
        if len(self.ids) > self.kept_ids:
            self._forget()
        cut = [raw[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist())]
        number = np.fromiter(map(self._number, cut), np.int64, len(left))
        stops, kept = np.array(self.stops, np.int64), np.array(self.ids, np.uint32)
        count = np.ones(len(rank), np.int64)
        count[left] = stops[number + 1] - stops[number]
        stop = np.cumsum(count)
        ids = np.repeat(np.where(rank < 0, 0, rank), count).astype(np.uint32)
        if len(left):
            own = count[left]
            step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            ids[np.repeat((stop - count)[left], own) + step] = kept[np.repeat(stops[number], own) + step]
        return ids, np.r_[0, stop][np.r_[0, np.cumsum(pieces)]]


def decoded(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids, all one after another, and the offsets of each row's bytes."""
    lengths = (vocabulary.ends - vocabulary.starts)[ids]
    stop = np.r_[0, np.cumsum(lengths)]
    step = np.arange(int(stop[-1])) - np.repeat(stop[:-1], lengths)
    return vocabulary.data[step + np.repeat(vocabulary.starts[ids], lengths)], stop[offsets]


def _column(values: np.ndarray, offsets: np.ndarray, kind, known: np.ndarray | None = None):
    """An Arrow array of byte strings (offsets in bytes) or of lists."""
    import pyarrow as pa

    gone = None if known is None or known.all() else pa.py_buffer(np.packbits(known, bitorder="little"))
    at = pa.py_buffer(offsets.astype(np.int32))
    if pa.types.is_list(kind):
        return pa.Array.from_buffers(kind, len(offsets) - 1, [gone, at], children=[pa.array(values, kind.value_type)])
    return pa.Array.from_buffers(kind, len(offsets) - 1, [gone, at, pa.py_buffer(values.tobytes())])


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids",
           packed: bool = False) -> DataFrame:
    """The rows with ``ids`` instead of their text, as integers or, ``packed``, as
    unsigned little-endian 32-bit numbers in one binary.

    A null or empty text has no ids (an empty array, not null).  Texts are encoded
    whole: one longer than a chunk is a chunk of its own, and no text depends on
    another, so repeated rows get the same ids.  A pair's ties go to the leftmost.
    Other columns are kept; one named as the result is replaced.
    """
    import pyarrow as pa

    kind = pa.binary() if packed else pa.list_(pa.int32())
    rest = [c for c in docs.columns if c.lower() not in (text_col.lower(), ids_col.lower())]
    rows = docs.select(*[docs[f"`{c}`"] for c in rest], docs[f"`{text_col}`"].cast("string").alias(ids_col))
    empty = F.lit(b"") if packed else F.array().cast("array<int>")
    schema = rows.select(*[f"`{c}`" for c in rest], empty.alias(ids_col)).schema
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of the vocabulary's size

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                ids, at = encoder.encode(data, offsets)
                own = _column(ids.astype("<u4"), 4 * at, kind) if packed else _column(ids.astype(np.int32), at, kind)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, last - first) for c in batch.columns[:-1]), own], batch.schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """The rows and the bytes of their ids, given as integers or packed.

    Bytes need not be whole characters, so they stay binary.  Null where the ids are
    null, hold a null, or hold a number that is no token; no ids give no bytes.
    Other columns are kept; one named as the result is replaced.
    """
    import pyarrow as pa

    rest = [c for c in rows.columns if c.lower() != bytes_col.lower()]
    rows = rows.select(*[f"`{c}`" for c in rest])
    schema = rows.select("*", F.lit(b"").cast("binary").alias(bytes_col)).schema
    schema[len(rest)].nullable = True
    column = [c.lower() for c in rest].index(ids_col.lower())
    packed = rows.schema[column].dataType.typeName() == "binary"
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    limit = 1 << 18  # ids worked on at once, and one row at least

    def run(batches):
        own = shared.value
        for batch in batches:
            given = batch.column(column)
            known = np.asarray(given.is_valid())
            if packed:
                given = given.fill_null(b"").cast(pa.large_binary())
                at = np.frombuffer(given.buffers()[1], np.int64)[given.offset:given.offset + len(given) + 1]
                known &= (at[1:] - at[:-1]) % 4 == 0
                held = given.buffers()[2]
                whole = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
            else:
                given = given.fill_null([])
                at, values = given.offsets.to_numpy().astype(np.int64), given.values
                whole = values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            unit = 4 if packed else 1
            first = 0
            while first < len(given):
                last = max(int(np.searchsorted(at, at[first] + limit * unit, "right")) - 1, first + 1)
                last = min(last, len(given))
                fit = known[first:last].copy()
                lengths = np.where(fit, at[first + 1:last + 1] - at[first:last], 0)
                parts = [whole[a:a + n] for a, n in zip(at[first:last].tolist(), lengths.tolist()) if n]
                ids = np.concatenate(parts) if parts else np.zeros(0, whole.dtype)
                ids = (np.frombuffer(ids.tobytes(), "<u4") if packed else ids).astype(np.int64)
                offsets = np.r_[0, np.cumsum(lengths // unit)]
                odd = (ids < 0) | (ids >= len(own.tokens))
                if odd.any():
                    bad = np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1
                    fit[bad], ids[odd] = False, 0
                data, stops = decoded(own, ids, offsets)
                if not fit.all():  # nothing is left of a row that can't be decoded
                    data = data[np.repeat(fit, np.diff(stops))]
                    stops = np.r_[0, np.cumsum(np.where(fit, np.diff(stops), 0))]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, last - first) for c in batch.columns), _column(data, stops, pa.binary(), fit)],
                    [*batch.schema.names, bytes_col])
                first = last

    return rows.mapInArrow(run, schema)
