"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: words, and the heads of longer ones.  Its logit is a bias, a weight per term, and a
product of factor vectors per pair of terms: pairs such as an insult next to the
mention of a group count more than their parts.  Terms are 64-bit hashes; the
model holds those that separate the classes best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from parapet.llm.shared import chunks, find_words, hash_words, held_out, stored

#: Bounds of the model and of the labelled rows it is fitted on.
TERMS = 1 << 13
FACTORS = 4
ROWS_PER_CLASS = 10_000
MIN_DOCS = 5
THRESHOLD = 0.3
#: Besides whole words, their first bytes count, so that inflected and compound forms share a term.
STEMS = (5, 7)

_SLOT_BITS = 20
_BLANK = np.ones(256, bool)
_BLANK[ord("a"):ord("z") + 1] = _BLANK[ord("A"):ord("Z") + 1] = False
_BLANK[0x80:] = False  # letters beyond a-z are made of these bytes
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


@dataclass
class Machine:
    """terms: sorted hashes.  weights[i], factors[i] belong to terms[i]."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(1 << _SLOT_BITS, bool)
        self.seen[(self.terms >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)] = True

    def known(self, hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, number of a term) of the terms in the model, in order."""
        own = self.seen[(hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
        hashes, texts = hashes[own], texts[own]
        if not len(self.terms) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        own = self.terms[at] == hashes
        pairs = np.unique(texts[own].astype(np.int64) * len(self.terms) + at[own])
        return pairs // len(self.terms), pairs % len(self.terms)

    def logits(self, texts: np.ndarray, terms: np.ndarray, count: int) -> np.ndarray:
        linear = np.bincount(texts, self.weights[terms], count)
        squared = cross = 0.0
        for k in range(self.factors.shape[1]):
            v = self.factors[terms, k]
            squared = squared + np.bincount(texts, v, count) ** 2
            cross = cross + np.bincount(texts, v * v, count)
        return self.bias + linear + 0.5 * (squared - cross)


def terms_of(texts) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of an Arrow column, by chunk: hashes, text numbers, first row, rows."""
    for first, last, data, offsets in chunks(texts):
        data = _FOLD[data]
        starts, ends, of = find_words(data, offsets, _BLANK)
        found, rows = [hash_words(data, starts, ends)], [of]
        for size in STEMS:  # the head of a longer word is a term of its own
            long = np.flatnonzero(ends - starts > size)
            found.append(hash_words(data, starts[long], starts[long] + size) ^ np.uint64(size))
            rows.append(of[long])
        yield np.concatenate(found), np.concatenate(rows), first, last - first


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int, seed: int) -> DataFrame:
    """doc_id, toxic and a weight of at most about ``rows_per_class`` rows a class.

    Rows are picked by a hash of the id; the weight undoes the share picked.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {y: min(1.0, rows_per_class / n) for y, n in counts.items()}
    part = (F.xxhash64("doc_id", F.lit(seed)) / F.lit(2.0**64)) + 0.5
    of = F.coalesce(*[F.when(F.col("toxic") == y, F.lit(s)) for y, s in share.items()], F.lit(0.0))
    return known.where(part < of).select(
        F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"), (1 / F.nullif(of, F.lit(0.0))).alias("_weight"))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", terms: int = TERMS,
        factors: int = FACTORS, rows_per_class: int = ROWS_PER_CLASS, min_docs: int = MIN_DOCS,
        epochs: int = 24, seed: int = 5) -> Machine:
    """Fit on labelled rows that are not held out, a bounded sample of each class.

    Without labelled rows of both classes the model is its bias.
    """
    import pyarrow as pa

    picked = training_rows(docs, labels, rows_per_class, seed)
    # at most about 2 * rows_per_class short rows, so the texts needn't be shuffled
    rows = docs.select(docs["doc_id"].alias("_id"), docs[text_col].alias("_text")).join(
        F.broadcast(picked), "_id")

    total = rows.agg(F.count("*").alias("n"), F.sum("_toxic").alias("n1"), F.sum("_weight").alias("w"),
                     F.sum(F.col("_weight") * F.col("_toxic")).alias("w1")).first()
    n, n1 = total["n"], total["n1"] or 0
    rate = (total["w1"] or 0.0) / (total["w"] or 1.0)
    machine = Machine(np.zeros(0, np.uint64), float(np.log((rate + 1e-4) / (1 - rate + 1e-4))),
                      np.zeros(0), np.zeros((0, factors)))
    if not 0 < n1 < n:
        return machine
    chosen = _choose(_term_counts(rows), n, n1, terms, min(min_docs, max(2, n // 200)))
    if not len(chosen):
        return machine
    machine = Machine(chosen, machine.bias, np.zeros(len(chosen)), np.zeros((len(chosen), factors)))
    model = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by ``terms``

    def number(batches):
        for batch in batches:
            out = []
            for hashes, of, _, size in terms_of(batch.column(batch.schema.get_field_index("_text"))):
                texts, at = model.value.known(hashes, of)
                cuts = np.searchsorted(texts, np.arange(size + 1))
                out += [at[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_toxic", "_weight")), pa.array(out, pa.binary())],
                ["id", "toxic", "weight", "terms"])

    # of the bounded sample: a class, a weight and the numbers of its terms a row
    table = rows.mapInArrow(number, "id long, toxic int, weight double, terms binary").toArrow().sort_by("id")
    sets = [np.frombuffer(x, np.int32) for x in table.column("terms").to_pylist()]
    at = np.concatenate(sets).astype(np.int64)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    weights = table.column("weight").to_numpy()
    return _descend(machine, of, at, table.column("toxic").to_numpy().astype(float), weights / weights.mean(), epochs, seed)


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, docs, toxic: texts of the sample with the term, and those of label 1."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            toxic = batch.column(batch.schema.get_field_index("_toxic")).to_numpy()
            for hashes, of, first, size in terms_of(batch.column(batch.schema.get_field_index("_text"))):
                order = np.lexsort((of, hashes))
                h, d = hashes[order], of[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
                h, y = h[new], toxic[first:first + size][d[new]]
                if len(h):
                    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[starts].view(np.int64)), pa.array(np.diff(np.r_[starts, len(h)]).astype(np.int64)),
                         pa.array(np.add.reduceat(y, starts).astype(np.int64))], ["term", "docs", "toxic"])

    return rows.mapInArrow(count, "term long, docs long, toxic long").groupBy("term").agg(
        F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))


def _choose(counts: DataFrame, n: int, n1: int, terms: int, least: int) -> np.ndarray:
    """Hashes of the terms that tell the classes apart best, and of a few frequent ones,
    which tell nothing alone but may in pairs; in order."""
    share = n1 / n
    # root of the chi-square statistic of (term in text, class)
    spread = F.sqrt(F.col("docs") * (n - F.col("docs")) * share * (1 - share) / n)
    scored = stored(counts.where((F.col("docs") >= least) & (F.col("docs") < n)).withColumn(
        "score", F.abs(F.col("toxic") - F.col("docs") * share) / spread), "toxicity-terms")
    best = scored.where("score > 3").orderBy(F.desc("score"), "term").limit(terms - terms // 32)
    often = scored.orderBy(F.desc("docs"), "term").limit(terms // 32)
    both = {r["term"] for part in (best, often) for r in part.select("term").collect()}
    return np.sort(np.array(sorted(both), np.int64).view(np.uint64))


def _descend(m: Machine, of: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray,
             epochs: int, seed: int, batch: int = 256, step: float = 0.3, decay: float = 1e-4) -> Machine:
    """AdaGrad on the weighted log loss with weight decay."""
    rng = np.random.default_rng(seed)
    m.factors = rng.normal(0, 0.02, m.factors.shape)
    starts = np.searchsorted(of, np.arange(len(y) + 1))
    gw, gv, gb = np.full(len(m.terms), 1e-3), np.full(m.factors.shape, 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(order), batch):
            rows = order[low:low + batch]
            lengths = starts[rows + 1] - starts[rows]
            local = np.repeat(np.arange(len(rows)), lengths)
            total = int(lengths.sum())
            within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            ids = at[np.repeat(starts[rows], lengths) + within]
            sums = np.stack([np.bincount(local, m.factors[ids, k], len(rows)) for k in range(m.factors.shape[1])], 1)
            squares = np.bincount(local, (m.factors[ids] ** 2).sum(1), len(rows))
            logit = m.bias + np.bincount(local, m.weights[ids], len(rows)) + 0.5 * ((sums**2).sum(1) - squares)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            error = (p - y[rows]) * weight[rows] / len(rows)
            g = np.bincount(ids, error[local], len(m.terms)) + decay * m.weights
            gw += g * g
            m.weights -= step * g / np.sqrt(gw)
            pull = error[local][:, None] * (sums[local] - m.factors[ids])
            used = np.unique(ids)
            slot = np.searchsorted(used, ids)
            gf = np.stack([np.bincount(slot, pull[:, k], len(used)) for k in range(pull.shape[1])], 1)
            gf += decay * m.factors[used]
            gv[used] += gf * gf
            m.factors[used] -= 0.2 * step * gf / np.sqrt(gv[used])
            b = error.sum()
            gb += b * b
            m.bias -= step * b / np.sqrt(gb)
    return m


def with_score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability of label 1, from the whole text.

    A null, empty or wordless text has the score of the bias.  Other columns are
    kept; one named as the score is replaced.
    """
    import pyarrow as pa

    docs = docs.drop(score_col)
    model = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by TERMS and FACTORS
    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema
    column = docs.columns.index(text_col)

    def score(batches):
        m = model.value
        for batch in batches:
            out = [np.zeros(0)]
            for hashes, of, _, n in terms_of(batch.column(column)):
                texts, terms = m.known(hashes, of)
                out.append(1 / (1 + np.exp(-np.clip(m.logits(texts, terms, n), -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))],
                                             [*batch.schema.names, score_col])

    return docs.mapInArrow(score, schema)
