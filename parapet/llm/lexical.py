"""Ranked lexical search: an inverted index in shards, searched by block-max MaxScore.

Index.  A task turns the texts it reads into shards of bounded size, one after
another, without a shuffle.  A shard has a list for each term: its documents in
blocks of 128, gaps and frequencies packed in one, two or four bytes, and for each
block the (frequency, length) pairs that no other pair of the block beats.  A score
grows with the frequency and falls with the length, so these give a block's largest
score under any collection's counts, without the block being unpacked.

Search.  In a shard the lists of a query are ordered by the most they can add.  The
lists that together can't reach the k-th score found so far are non-essential: new
candidates come only from the other, essential ones.  Candidates are then taken
through the non-essential lists, the strongest first.  One whose sum and remaining
bounds stay below the k-th score is dropped, first by the list's bound, then by its
block's, and only blocks with candidates left are unpacked.  A task keeps one heap a
query over all its shards; heaps of tasks are merged by a ranking window.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from parapet.llm.shared import chunks, find_words, hash_words, lower_ascii, stored

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NOT_TERM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32

BLOCK = 128
#: A shard ends before it has more documents or bytes of text (one document at least).
SHARD_DOCS, SHARD_BYTES = 1 << 13, 1 << 23
WORDS = 1 << 17  # words whose bytes are worked on at once
#: Shards that one task searches, and bytes of queries that are searched at once.
SHARDS_A_TASK, QUERY_BYTES = 4, 8_000_000

INDEX = ("shard long, term string, docs int, lasts binary, fronts binary, front_counts binary, "
         "sizes binary, packed binary, doc_ids binary, known binary, lengths binary, terms long")


def _same_words(data, starts, ends, order, first) -> bool:
    """Whether the words of each run of ``order`` are alike, byte by byte."""
    head = np.repeat(order[first], np.diff(np.append(first, len(order))))
    if (ends[order] - starts[order] != ends[head] - starts[head]).any():
        return False
    for at in range(0, len(order), WORDS):
        own, of = starts[order[at:at + WORDS]], starts[head[at:at + WORDS]]
        n = ends[head[at:at + WORDS]] - of
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (data[step + np.repeat(own, n)] != data[step + np.repeat(of, n)]).any():
            return False
    return True


def _term_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word's term, and the terms; words are compared by hash, then bytes."""
    hashes = np.concatenate([
        hash_words(data, starts[a:a + WORDS], ends[a:a + WORDS]) for a in range(0, len(starts), WORDS)])
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    first = np.flatnonzero(new)
    if _same_words(data, starts, ends, order, first):
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return number, [data[a:b].tobytes() for a, b in zip(starts[order[first]].tolist(), ends[order[first]].tolist())]
    known: dict[bytes, int] = {}  # two words share a hash
    words = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64), list(known)


def _widths(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def _binary(values: np.ndarray, counts: np.ndarray):
    """Arrow binaries: ``counts`` values each."""
    import pyarrow as pa

    at = np.r_[0, np.cumsum(counts)] * values.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _lists(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, terms: int) -> dict:
    """Columns of the lists of a shard; postings are sorted by term, then document."""
    count = np.bincount(term, minlength=terms)
    first = np.cumsum(count) - count
    place = np.arange(len(term)) - first[term]
    head = np.flatnonzero(place % BLOCK == 0)  # where blocks start
    size = np.diff(np.append(head, len(term)))
    block = np.repeat(np.arange(len(head)), size)
    blocks = -(-count // BLOCK)
    # gaps to the document before; a block's first counts from the block before
    gap = doc - np.where(place == 0, 0, np.r_[0, doc[:-1]])
    rows = []
    for values in (gap, tf):
        width = _widths(np.maximum.reduceat(values, head))
        rows.append((values, width))
    wide = rows[0][1] + rows[1][1]
    at = np.cumsum(size * wide) - size * wide
    packed = np.zeros(int((size * wide).sum()), np.uint8)
    inside = np.arange(len(term)) - head[block]
    for k, (values, width) in enumerate(rows):
        start = at[block] + (size * rows[0][1] * k)[block]
        own = width[block]
        for byte in range(4):
            there = np.flatnonzero(own > byte)
            packed[start[there] + inside[there] * own[there] + byte] = values[there] >> (8 * byte) & 255
    # pairs that no other of the block beats: by length, those of a frequency above all before
    order = np.lexsort((-tf, length[doc], block))
    key = block[order] << 32 | tf[order]
    most = np.maximum.accumulate(key)
    front = np.r_[True, (key[1:] > most[:-1])]
    kept = order[front]
    return {
        "docs": count.astype(np.int32), "blocks": blocks, "lasts": doc[np.append(head[1:], len(term)) - 1].astype(np.int32),
        "fronts": np.stack([tf[kept], length[doc[kept]]], 1).astype(np.int32), "front_counts": np.bincount(block[kept], minlength=len(head)).astype(np.uint8),
        "sizes": (rows[0][1] << 4 | rows[1][1]).astype(np.uint8), "packed": packed, "bytes": size * wide,
    }


def _shard(shard: int, ids, data: np.ndarray, offsets: np.ndarray):
    """Rows of one shard: its documents first (a null term), then its lists by term."""
    import pyarrow as pa

    data = _FOLD[data]
    starts, ends, doc = find_words(data, offsets, _NOT_TERM)
    length = np.bincount(doc, minlength=len(ids)).astype(np.int64)
    known = np.asarray(ids.is_valid()).astype(np.uint8)
    of = np.asarray(ids.fill_null(0))
    yield _table([shard], [None], [len(ids)], {"doc_ids": (of.astype(np.int64), [len(of)]), "known": (known, [len(of)]),
                                              "lengths": (length.astype(np.int32), [len(of)])}, [int(length.sum())])
    if not len(starts):
        return
    number, terms = _term_numbers(data, starts, ends)
    key, tf = np.unique(number * len(ids) + doc, return_counts=True)
    made = _lists(key // len(ids), key % len(ids), tf.astype(np.int64), length, len(terms))
    edge = np.r_[0, np.cumsum(made["blocks"])]  # blocks of each term
    sums = {"packed": np.add.reduceat(made["bytes"], edge[:-1]),
            "fronts": 2 * np.add.reduceat(made["front_counts"].astype(np.int64), edge[:-1])}
    yield _table([shard] * len(terms), pa.array(terms, pa.binary()).cast(pa.string()), made["docs"], {
        "lasts": (made["lasts"], made["blocks"]), "fronts": (made["fronts"].ravel(), sums["fronts"]),
        "front_counts": (made["front_counts"], made["blocks"]), "sizes": (made["sizes"], made["blocks"]),
        "packed": (made["packed"], sums["packed"])}, None)


def _table(shards, terms, docs, binaries: dict, totals):
    import pyarrow as pa

    n = len(shards)
    columns = [pa.array(shards, pa.int64()), pa.array(terms, pa.string()) if isinstance(terms, list) else terms,
               pa.array(docs, pa.int32())]
    for name in ("lasts", "fronts", "front_counts", "sizes", "packed", "doc_ids", "known", "lengths"):
        columns.append(_binary(binaries[name][0], np.asarray(binaries[name][1])) if name in binaries
                       else pa.nulls(n, pa.binary()))
    columns.append(pa.array(totals, pa.int64()) if totals else pa.nulls(n, pa.int64()))
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all rows' whole texts, written to the shared folder.

    A null text is an empty one.  A text beyond ``shard_bytes`` is a shard of its
    own.  Ids may repeat or be null; every row is a document.  Other columns take no
    part.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        made, waiting, docs_, bytes_ = 0, [], 0, 0

        def flush():
            nonlocal made, waiting, docs_, bytes_
            if docs_:
                ids = pa.concat_arrays([w[0] for w in waiting])
                data = np.concatenate([w[1] for w in waiting])
                lengths = np.concatenate([np.diff(w[2]) for w in waiting])
                yield from _shard(task | made, ids, data, np.r_[0, np.cumsum(lengths)])
                made += 1
            waiting, docs_, bytes_ = [], 0, 0

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                for first, last, data, offsets in chunks(part.column(1), min(shard_bytes, 1 << 20)):
                    while first < last:  # at most shard_docs rows are added
                        if docs_ >= shard_docs or (docs_ and bytes_ + len(data) > shard_bytes):
                            yield from flush()
                        n = min(last - first, shard_docs - docs_)
                        waiting.append((part.column(0).slice(first, n), data[:offsets[n]].copy(), offsets[:n + 1].copy()))
                        docs_, bytes_ = docs_ + n, bytes_ + int(offsets[n])
                        data, offsets, first = data[offsets[n]:], offsets[n:] - offsets[n], first + n
        yield from flush()

    return stored(rows.mapInArrow(run, INDEX), "lexical-index")


@dataclass
class Counts:
    """What a collection's scores depend on: N, L."""

    documents: int
    terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        """m of documents of so many terms."""
        if not len(lengths) or not self.terms:
            return np.full(len(lengths), 10, np.int64)
        if 90 * int(lengths.max()) * self.documents < 1 << 62:
            return 10 + 90 * lengths.astype(np.int64) * self.documents // self.terms
        return np.array([10 + 90 * int(n) * self.documents // self.terms for n in lengths], np.int64)


def impacts(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """A posting's score before the term's weight."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * norms)


class List:
    """A term's list in a shard; blocks are unpacked when they are asked for, once."""

    def __init__(self, docs: int, lasts, block_most, sizes, packed, norms, seen):
        self.docs, self.lasts, self.block_most = docs, lasts, block_most
        self.most = int(block_most.max())
        self.sizes, self.packed, self.norms, self.seen = sizes, packed, norms, seen
        n = len(lasts)
        size = np.full(n, BLOCK, np.int64)
        size[-1] = docs - BLOCK * (n - 1)
        self.stops = np.cumsum(size)
        self.starts = self.stops - size
        wide = (sizes >> 4).astype(np.int64) + (sizes & 15)
        self.at = np.r_[0, np.cumsum(size * wide)]
        # until a block is unpacked all its places hold its last document, so the whole stays sorted
        self.doc = np.repeat(lasts.astype(np.int64), size)
        self.impact = np.zeros(docs, np.int64)
        self.open = np.zeros(n, bool)

    def unpack(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.open[blocks]].tolist():
            start, stop = self.starts[b], self.stops[b]
            n, one, two = stop - start, int(self.sizes[b]) >> 4, int(self.sizes[b]) & 15
            own = self.packed[self.at[b]:self.at[b + 1]]
            gaps = np.frombuffer(own, f"<u{one}", n).astype(np.int64)
            tf = np.frombuffer(own, f"<u{two}", n, n * one)
            doc = np.cumsum(gaps) + (int(self.lasts[b - 1]) if b else 0)
            self.doc[start:stop] = doc
            self.impact[start:stop] = impacts(tf, self.norms[doc])
            self.open[b] = True
            self.seen["unpacked"] += 1

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.open.all():
            self.unpack(np.arange(len(self.lasts)))
        return self.doc, self.impact

    def of(self, docs: np.ndarray) -> np.ndarray:
        """Impacts on these documents, 0 where the term isn't in them."""
        place = np.minimum(np.searchsorted(self.doc, docs), self.docs - 1)
        return np.where(self.doc[place] == docs, self.impact[place], 0)


@dataclass
class Best:
    """The k best documents so far: highest score first, then smallest id, null ids last."""

    k: int
    heap: list = field(default_factory=list)

    def least(self) -> int:
        """A score below which nothing can enter; equal ones may, by their ids."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        item = (score, doc_id is not None, -doc_id if doc_id is not None else 0)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            heapq.heapreplace(self.heap, item)


def _offer(best: Best, docs, scores, ids, known) -> None:
    if len(docs) > best.k:  # only the shard's best, with all that tie with the last of them
        floor = max(best.least(), int(np.partition(scores, len(scores) - best.k)[len(scores) - best.k]))
    else:
        floor = best.least()
    keep = np.flatnonzero(scores >= floor)
    if len(keep) > best.k:  # many ties: the smallest ids are enough
        order = np.lexsort((ids[docs[keep]], 1 - known[docs[keep]], -scores[keep]))
        keep = keep[order[:best.k]]
    for i in keep.tolist():
        d = int(docs[i])
        best.offer(int(scores[i]), int(ids[d]) if known[d] else None)


def search_shard(query: list[tuple[List, int]], best: Best, ids, known, seen: dict) -> None:
    """Bring a query's best up to date with a shard.  ``query``: its lists and their weights."""
    lists = sorted(((w * own.most, w, own) for own, w in query if w * own.most > 0), key=lambda x: x[0])
    if not lists:
        return
    reach = np.cumsum([bound for bound, _, _ in lists])  # of the lists up to each
    if reach[-1] < best.least():
        seen["skipped"] += 1
        return
    # begin with the strongest lists that have k documents, or with the essential ones if those are fewer
    first, held = len(lists) - 1, lists[-1][2].docs
    while first and held < best.k:
        first -= 1
        held += lists[first][2].docs
    first = max(first, int(np.searchsorted(reach, best.least())))
    done = np.zeros(len(ids), bool)
    while True:
        # lists from ``first`` on bring candidates; those before can't reach the least score alone
        total = np.zeros(len(ids), np.int64)
        fresh = np.zeros(len(ids), bool)
        for _, w, own in lists[first:]:
            doc, impact = own.all()
            total[doc] += w * impact
            fresh[doc] = True
        docs = np.flatnonzero(fresh & ~done)
        done |= fresh
        scores = total[docs]
        seen["candidates"] += len(docs)
        for i in range(first - 1, -1, -1):
            least = best.least()
            keep = scores + reach[i] >= least
            docs, scores = docs[keep], scores[keep]
            if not len(docs):
                break
            _, w, own = lists[i]
            block = np.searchsorted(own.lasts, docs)
            there = block < len(own.lasts)
            most = np.where(there, own.block_most[np.minimum(block, len(own.lasts) - 1)], 0)
            keep = scores + w * most + (reach[i - 1] if i else 0) >= least
            docs, scores, block, there = docs[keep], scores[keep], block[keep], there[keep]
            own.unpack(np.unique(block[there]))
            scores = scores + w * own.of(docs)
        if len(docs):
            _offer(best, docs, scores, ids, known)
        essential = int(np.searchsorted(reach, best.least()))
        if essential >= first:
            return
        first = essential  # with the least score of the first pass


def _open_shard(rows: list[dict], counts: Counts, seen: dict):
    """Documents of a shard and its lists by term, from its rows."""
    head = next(r for r in rows if r["term"] is None)
    ids, known = np.frombuffer(head["doc_ids"], np.int64), np.frombuffer(head["known"], np.uint8)
    norms = counts.norms(np.frombuffer(head["lengths"], np.int32).astype(np.int64))
    own = [r for r in rows if r["term"] is not None]
    lists = {}
    if own:
        fronts = np.frombuffer(b"".join(r["fronts"] for r in own), np.int32).reshape(-1, 2)
        per = np.frombuffer(b"".join(r["front_counts"] for r in own), np.uint8).astype(np.int64)
        most = np.maximum.reduceat(impacts(fronts[:, 0], counts.norms(fronts[:, 1].astype(np.int64))), np.cumsum(per) - per)
        at = 0
        for r in own:
            lasts = np.frombuffer(r["lasts"], np.int32)
            lists[r["term"]] = List(r["docs"], lasts, most[at:at + len(lasts)], np.frombuffer(r["sizes"], np.uint8),
                                    r["packed"], norms, seen)
            at += len(lasts)
            seen["blocks"] += len(lasts)
    return ids, known, lists


def terms_of(texts: DataFrame, text_col: str) -> DataFrame:
    """The rows with ``term``, one row for each distinct term."""
    terms = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(TERM_PATTERN), F.lit(0)))
    return texts.withColumn("term", F.explode(terms)).drop(text_col)


def search(index: DataFrame, queries: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "item_id",
           shards_a_task: int = SHARDS_A_TASK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k best documents for every query: the id column, rank, doc_id, score.

    Exact: scores are whole numbers, equal ones by ascending doc_id, null ids last.
    Every row of ``queries`` is a query of its own, alike or not; one without terms,
    or null, finds nothing.  Terms no document holds count for nothing.  Queries are
    searched in blocks of at most ``query_bytes`` bytes (one query at least), whose terms
    and weights are what is broadcast.
    """
    asked = stored(queries.select(
        F.monotonically_increasing_id().alias("query"), queries[f"`{id_col}`"].alias("item"),
        F.coalesce(queries[f"`{text_col}`"].cast("string"), F.lit("")).alias("text")), "lexical-queries")
    totals = index.where("term IS NULL").agg(F.sum("terms").alias("l"), F.count("*").alias("shards")).first()
    found = index.where("term IS NULL").mapInArrow(_filled, "n long").agg(F.sum("n")).first()[0]
    counts, shards = Counts(int(found or 0), int(totals["l"] or 0)), totals["shards"]
    size = asked.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(size["bytes"] or 0) // query_bytes))
    while True:  # until no block is above its bound
        placed = asked.withColumn("_block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        worst = placed.groupBy("_block").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).where(
            f"n > 1 AND b > {2 * query_bytes}").limit(1).count()
        if not worst or blocks > 4 * (size["n"] or 1):
            break
        blocks *= 2
    parts = [_search_block(index, placed.where(F.col("_block") == b), counts, shards, k, shards_a_task)
             for b in range(blocks)]
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    merged = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.join(asked.select("query", "item"), "query").select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def _filled(batches):
    """How many documents have a term."""
    import pyarrow as pa

    for batch in batches:
        own = [int((np.frombuffer(x, np.int32) > 0).sum()) for x in batch.column("lengths").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(own)], pa.int64())], ["n"])


def _search_block(index, asked, counts: Counts, shards: int, k: int, shards_a_task: int) -> DataFrame:
    import pyarrow as pa

    spark = index.sparkSession
    pairs = terms_of(asked.select("query", "text"), "text")
    lists = index.where("term IS NOT NULL").join(F.broadcast(pairs.select("term").distinct()), "term", "left_semi")
    df = {r["term"]: r["df"] for r in lists.groupBy("term").agg(F.sum("docs").cast("long").alias("df")).collect()}
    plan: dict[int, list[tuple[str, int]]] = {}
    for r in pairs.collect():  # bounded by the block's bytes
        if r["term"] in df:
            plan.setdefault(r["query"], []).append((r["term"], counts.weight(df[r["term"]])))
    shared = spark.sparkContext.broadcast(plan)
    columns = ["shard", "term", "docs", "lasts", "fronts", "front_counts", "sizes", "packed", "doc_ids", "known", "lengths"]
    rows = index.where("term IS NULL").select(*columns).unionByName(lists.select(*columns))
    tasks = max(1, -(-shards // shards_a_task))
    rows = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "term")

    def run(batches):
        best = {q: Best(k) for q in shared.value}
        seen = {"blocks": 0, "unpacked": 0, "skipped": 0, "candidates": 0}

        def finish(own):
            ids, known, lists = _open_shard(own, counts, seen)
            for q, terms in shared.value.items():
                search_shard([(lists[t], w) for t, w in terms if t in lists], best[q], ids, known, seen)

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["shard"] != row["shard"]:
                    finish(held)
                    held = []
                held.append(row)
        if held:
            finish(held)
        out = [(q, -x[2] if x[1] else None, x[0]) for q, own in best.items() for x in own.heap]
        if out:
            q, d, s = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query long, doc_id long, score long")
