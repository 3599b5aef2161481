"""Language by prediction by partial matching.

Every language has a tree of byte contexts of up to three bytes with the counts
of the bytes that followed.  A byte that followed its context n times costs
-log2(n / (N + q)) bits, with N the context's count and q its distinct followers;
one that never did costs the escape, -log2(q / (N + q)), and is coded in the
context shorter by one byte, at last as one of 256.  The counts are frozen while
texts are scored, so costs are a table, and a text's language is the one whose
code is shortest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from parapet.llm.shared import chunks, held_out, stored, unused

ORDER = 3
#: Contexts in the model, and bytes it takes (a cost is a 16-bit number of 1/256 bits).
CONTEXTS = 6_000
MODEL_BYTES = 64_000_000
_UNIT = 256.0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


@dataclass
class Model:
    """Costs of each byte in each kept context.

    nodes: sorted codes of contexts (length << 24 | bytes); node 0 is the empty
    one.  costs[node * 256 + byte, language] in 1/256 bits.
    """

    languages: list[str]
    nodes: np.ndarray
    costs: np.ndarray

    def __post_init__(self):
        # the node of the longest kept context that ends before a place, from its three bytes
        if not len(self.nodes):
            return
        used = sorted({int(b) for c in self.nodes for b in _bytes(int(c))})
        self.rank = np.full(256, len(used), np.int32)
        self.rank[used] = np.arange(len(used))
        self.base = base = len(used) + 1
        self.table = np.zeros(base**3, np.int32)
        cube = self.table.reshape(base, base, base)
        for code in sorted(map(int, self.nodes)):  # longer contexts later
            at = [self.rank[b] for b in _bytes(code)]
            node = int(np.searchsorted(self.nodes, code))
            cube[(slice(None),) * (3 - len(at)) + tuple(at)] = node


def _bytes(code: int) -> list[int]:
    return [code >> (8 * i) & 255 for i in range((code >> 24) - 1, -1, -1)]


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, context code, byte, n: over all texts with a language, whole.

    Pre-counted in the tasks, by chunk of text; A-Z count as a-z.
    """
    import pyarrow as pa

    rows = docs.where(docs[lang_col].isNotNull()).select(
        docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    schema = "lang string, context long, byte int, n long"

    def count(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, last, data, offsets in chunks(batch.column(1)):
                own = langs[first:last]
                for lang in sorted(set(own)):
                    mine = np.flatnonzero(own == lang)
                    grams = [_grams(_FOLD[data[offsets[i]:offsets[i + 1]]]) for i in mine]
                    keys, n = np.unique(np.concatenate(grams), return_counts=True)
                    if lang in sums:
                        keys, n = _merged(*sums[lang], keys, n)
                    sums[lang] = keys, n
            if sum(len(k) for k, _ in sums.values()) > 2_000_000:
                yield from _count_batches(sums)
                sums = {}
        yield from _count_batches(sums)

    def _count_batches(sums):
        for lang, (keys, n) in sums.items():
            for a in range(0, len(keys), 100_000):
                k = keys[a:a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k)), pa.array((k >> 8).astype(np.int64)),
                     pa.array((k & 255).astype(np.int32)), pa.array(n[a:a + 100_000].astype(np.int64))],
                    ["lang", "context", "byte", "n"])

    return rows.mapInArrow(count, schema).groupBy("lang", "context", "byte").agg(F.sum("n").alias("n"))


def _merged(k1, n1, k2, n2):
    keys = np.concatenate([k1, k2])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([n1, n2])[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(n, new)


def _grams(text: np.ndarray) -> np.ndarray:
    """(context code << 8 | byte) of every place with its whole context of ORDER bytes,
    and of the first places with what they have.  Shorter contexts are sums of these."""
    b = text.astype(np.int64)
    head = [(i << 24 | int.from_bytes(bytes(text[:i]), "big")) << 8 | int(b[i]) for i in range(min(ORDER, len(b)))]
    if len(b) <= ORDER:
        return np.array(head, np.int64)
    full = (b[:-3] << 16 | b[1:-2] << 8 | b[2:-1] | ORDER << 24) << 8 | b[3:]
    return np.concatenate([np.array(head, np.int64), full])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
        contexts: int = CONTEXTS, model_bytes: int = MODEL_BYTES) -> Model:
    """Count all of ``docs`` and keep the most frequent contexts.

    The number of contexts is bounded (by ``contexts`` and by ``model_bytes`` over
    the languages), so what the driver gets and broadcasts is bounded; places in
    other contexts use the longest kept one.  Hand in training rows only.
    """
    whole = stored(counts(docs, text_col, lang_col), "language-counts")
    languages = sorted(r["lang"] for r in whole.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.int16))
    keep = max(300, min(contexts, model_bytes // (512 * len(languages))))
    # every suffix of a context is a context
    shorter = F.explode(F.array(*[
        F.when(F.shiftright("context", 24) >= k,
               F.col("context").bitwiseAND(F.lit((1 << 8 * k) - 1)) + F.lit(k << 24))
        for k in range(ORDER + 1)]))
    nodes = whole.select("lang", "byte", "n", shorter.alias("node")).where("node IS NOT NULL")
    nodes = nodes.groupBy("lang", "node", "byte").agg(F.sum("n").alias("n"))
    # the share of a language, so that a common one doesn't fill the model
    size = whole.groupBy("lang").agg(F.sum("n").alias("_all")).withColumnRenamed("lang", "_lang")
    weight = nodes.groupBy("lang", "node").agg(F.sum("n").alias("n")).join(
        F.broadcast(size), F.col("lang") == F.col("_lang")).groupBy("node").agg(
            F.sum((F.col("n") * 1e12 / F.col("_all")).cast("long")).alias("w"))  # whole numbers keep that order
    # a context has at least the weight of those it ends, so the kept ones form a tree
    best = weight.orderBy(F.desc("w"), "node").limit(keep).select("node")
    table = nodes.join(F.broadcast(best), "node").toArrow()
    return _model(languages, *(np.array(table.column(c).to_numpy(zero_copy_only=False)) for c in ("lang", "node", "byte", "n")))


def _model(languages, lang, node, byte, n) -> Model:
    nodes = np.unique(node.astype(np.int64))
    if nodes[0] != 0:
        nodes = np.r_[0, nodes]
    of = np.searchsorted(nodes, node.astype(np.int64))
    l_of = np.searchsorted(np.array(languages, object), lang)
    costs = np.zeros((len(nodes), 256, len(languages)), np.float32)
    counts_ = np.zeros((len(nodes), 256, len(languages)), np.float32)
    counts_[of, byte.astype(np.int64), l_of] = n
    for i, code in enumerate(nodes):  # by length: a parent comes before what extends it
        length = int(code) >> 24
        if length:
            up = (length - 1) << 24 | int(code) & ((1 << 8 * (length - 1)) - 1)
            below = costs[int(np.searchsorted(nodes, up))]
        else:
            below = np.full((256, len(languages)), 8.0, np.float32)
        c = counts_[i]
        total, kinds = c.sum(0), (c > 0).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(c / (total + kinds))
        costs[i] = np.where(c > 0, own, escape + below)
    whole = np.minimum(np.round(costs * _UNIT), 2**15 - 1).astype(np.int16)
    return Model(languages, nodes, whole.reshape(-1, len(languages)))


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text's code in each language."""
    n = len(offsets) - 1
    out = np.zeros((n, len(model.languages)))
    if not len(data):
        return out
    data = _FOLD[data]
    rank = model.rank[data]
    rest = model.base - 1
    # places 1 to 3 of a text have shorter contexts
    parts = []
    for back in (3, 2, 1):
        r = np.full(len(data), rest, np.int32)
        r[back:] = rank[:-back]
        for k in range(back):
            early = offsets[:-1] + k
            r[early[early < offsets[1:]]] = rest
        parts.append(r)
    context = (parts[0].astype(np.int64) * model.base + parts[1]) * model.base + parts[2]
    node = model.table[context]
    rows = np.take(model.costs, node.astype(np.int64) * 256 + data, axis=0)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    out[full] = np.add.reduceat(rows, offsets[:-1][full], axis=0, dtype=np.int64) / _UNIT
    return out


def with_language(docs: DataFrame, model: Model, text_col: str = "text",
                  lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the language with the shortest code, and its share of the likelihood.

    The share is taken at one eighth of the bits, so it isn't always 1.  A null
    text, or one without any letter, is ``und`` with score 0; so is every text
    when no language was learned.  Equal codes: the first language by name.
    Other columns are kept; columns named as the result are replaced.
    """
    import pyarrow as pa

    docs = docs.drop(lang_col, score_col)
    spoken = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.withColumn(unused("_spoken", docs), spoken)
    schema = docs.select("*", F.lit("").alias(lang_col), F.lit(0.0).alias(score_col)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by model_bytes
    column = docs.columns.index(text_col)

    def predict(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            told = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            best = np.full(len(told), len(m.languages))
            score = np.zeros(len(told))
            if m.languages:
                for first, last, data, offsets in chunks(batch.column(column)):
                    bits = code_lengths(m, data, offsets)
                    best[first:last] = bits.argmin(1)
                    less = bits.min(1)[:, None] - bits
                    score[first:last] = 1 / np.exp2(np.maximum(less / 8, -60)).sum(1)
            best[~told], score[~told] = len(m.languages), 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                [*batch.schema.names[:-1], lang_col, score_col])

    return rows.mapInArrow(predict, schema)


def training_part(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.where(~held_out(F.col("doc_id")))
