"""Approximate nearest neighbours by adaptive dimension scans of inverted lists.

Vectors are put into the lists of their nearest centroids.  A query probes the
lists nearest to it.  There, vectors are rotated at random and scanned in blocks
of columns: the partial distance tells, by a hypothesis test, whether the whole
distance can still be among the best, and candidates that can't are abandoned.
What is left is measured exactly, on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from parapet.llm.shared import stored

#: The centroids are fitted on a sample of at most about so many vectors.
SAMPLE = 20_000
LISTS = 1_024  # at most
PER_LIST = 200  # vectors a list, below that bound
TARGET = 0.98  # share of true neighbours the probes are to reach, on the sample
COLUMNS = 16  # of a block
DOUBT = 3.0  # deviations of the test; larger: fewer candidates are abandoned
BLOCK = 4_096  # vectors, and queries, that meet in one group
PILOT = 256  # vectors of a group that are measured first, and bound the distances of the others


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    counts: np.ndarray  # vectors of each list
    probes: int


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Arrow lists of doubles of one length."""
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    parts = [_squares(x[a:a + 1_000], centroids).argmin(1) for a in range(0, len(x), 1_000)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        of = _nearest(x, centroids)
        n = np.bincount(of, minlength=len(centroids))
        sums = np.stack([np.bincount(of, x[:, j], len(centroids)) for j in range(x.shape[1])], 1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def fit(rows: DataFrame, k: int = 10, seed: int = 3) -> Index | None:
    """rows: id, vector.  None if there are no vectors.

    Centroids and the number of probes come from a sample of bounded size.
    """
    n = rows.count()
    if not n:
        return None
    part = F.xxhash64("id", "vector", F.lit(seed)) / F.lit(2.0**64) + 0.5
    table = rows.where(part < min(1.0, SAMPLE / n)).orderBy("id").toArrow() if n > SAMPLE else rows.orderBy("id").toArrow()
    if not table.num_rows:
        table = rows.limit(SAMPLE).toArrow()
    x = _matrix(table.column("vector").combine_chunks())
    centroids = _lloyd(x, max(1, min(LISTS, n // PER_LIST)), 8, seed)
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    # ranks of the lists that hold the neighbours of some vectors
    tried = np.random.default_rng(seed + 1).permutation(len(x))[:300]
    near = _squares(x[tried], x)
    near[np.arange(len(tried)), tried] = np.inf
    best = np.argsort(near, axis=1, kind="stable")[:, :min(k, max(1, len(x) - 1))]
    rank = np.argsort(np.argsort(_squares(x[tried], centroids), axis=1), axis=1)
    of = _nearest(x, centroids)
    ranks = np.sort(np.take_along_axis(rank, of[best], axis=1).ravel())
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))]) + 1
    return Index(centroids, rotation, np.zeros(len(centroids), np.int64), probes)


def _scan(q: np.ndarray, bound: float, rotated: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Numbers of the candidates that aren't abandoned; ``bound`` on the squared distance."""
    d = rotated.shape[1]
    left = np.arange(len(rotated))
    partial = np.zeros(len(rotated))
    for a in range(0, d, COLUMNS):
        b = min(d, a + COLUMNS)
        gap = rotated[left, a:b] - turned[a:b]
        partial = partial[left] if len(partial) != len(left) else partial
        partial = partial + np.einsum("ij,ij->i", gap, gap)
        slack = (1 + DOUBT / np.sqrt(b)) ** 2 if b < d else 1 + 1e-9
        on = partial <= bound * (b / d) * slack + 1e-12
        left, partial = left[on], partial[on]
        if not len(left):
            break
    return left


def search(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each row that ``query`` picks.

    Candidates are all rows but those with the query's own id; equal distances
    rank by id.  Rows with a null id, and vectors that are null, zero, of another
    length than the most frequent one, or hold null or non-finite components take
    no part.  A query with fewer candidates gets all of them.  An empty table
    gives no rows.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    fine = vectors.where(F.col(id_col).isNotNull() & usable(vector)).select(
        F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(query, F.lit(False)).alias("asks"))
    length = fine.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is not None:
        fine = fine.where(F.size("vector") == length["d"])
    index = fit(fine.select("id", "vector"), k)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(index)  # bounded by LISTS

    def place(batches):
        m = model.value
        for batch in batches:
            if batch.num_rows:
                of = _nearest(_matrix(batch.column(1)), m.centroids)
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), *batch.columns],
                                                 ["list", "id", "vector", "asks"])

    placed = stored(fine.mapInArrow(place, "list int, id long, vector array<double>, asks boolean"), "neighbour-lists")
    for r in placed.groupBy("list").count().collect():  # one row a list
        index.counts[r["list"]] = r["count"]
    sizes = spark.sparkContext.broadcast(index)

    def ask(batches):
        m = sizes.value
        for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            q, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            order = np.argsort(_squares(q, m.centroids), axis=1, kind="stable")
            held = np.cumsum(m.counts[order], axis=1)
            # enough probes for the target, and for k candidates besides rows of the query's own id
            copies = batch.column(2).to_numpy()
            need = (held < np.maximum(3 * k + 2, k + copies)[:, None]).sum(1) + 1
            probes = np.minimum(np.maximum(need, m.probes), len(m.centroids))
            many = np.repeat(np.arange(len(q)), probes)
            lists = np.concatenate([order[i, :p] for i, p in enumerate(probes)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists.astype(np.int32)), batch.column(0).take(pa.array(many)),
                 batch.column(1).take(pa.array(many))], ["list", "id", "vector"])

    queries = placed.where("asks").select("id", "vector")
    copies = placed.join(queries.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("copies"))
    asked = queries.join(copies, "id").select("id", "vector", "copies").mapInArrow(
        ask, "list int, id long, vector array<double>")
    # lists and their queries in blocks, so that a large list or a popular one is many groups
    asking = asked.groupBy("list").agg(F.count("*").alias("n"))
    blocks = F.broadcast(placed.groupBy("list").count().join(asking, "list").select(  # one row a list
        "list", F.ceil(F.col("count") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("n") / BLOCK).cast("int").alias("cols")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["list", "row", "col", "role", "id", "vector"]
    as_rows = placed.join(blocks, "list").withColumn("col", each("cols")).select(
        "list", F.pmod(F.xxhash64("id"), "rows").cast("int").alias("row"), "col", F.lit(1).alias("role"), "id", "vector")
    as_cols = asked.join(blocks, "list").withColumn("row", each("rows")).select(
        "list", "row", F.pmod(F.xxhash64("id"), "cols").cast("int").alias("col"), F.lit(0).alias("role"), "id", "vector")
    met = as_rows.select(*columns).unionByName(as_cols.select(*columns)).repartition("list", "row", "col")
    met = met.sortWithinPartitions("list", "row", "col", "role", "id")

    def scan(batches):
        from parapet.llm.near_dedup import _groups

        rotation = model.value.rotation
        for group in _groups(batches, 3):
            role = group.column(3).to_numpy()
            n = int(np.searchsorted(role, 1))
            if not n or n == len(role):
                continue
            ids = group.column(4).to_numpy()
            x = _matrix(group.column(5).combine_chunks())
            rows, row_ids = x[n:], ids[n:]
            rotated, turned = rows @ rotation, x[:n] @ rotation
            largest = (rows * rows).sum(1).max()
            out = [[], [], []]
            for i in range(n):
                # a group gives k of its candidates, or all: the bound is theirs
                left = np.flatnonzero(row_ids[:PILOT] != ids[i])
                first = ((rows[left] - x[i]) ** 2).sum(1)
                # the scan's distances are rounded: a bound must not be too small
                bound = np.partition(first, k - 1)[k - 1] + 1e-9 * ((x[i] * x[i]).sum() + largest) if len(first) >= k else np.inf
                left = np.concatenate([left, PILOT + _scan(x[i], bound, rotated[PILOT:], turned[i])])
                left = left[row_ids[left] != ids[i]]
                if not len(left):
                    continue
                exact = np.sqrt(((rows[left] - x[i]) ** 2).sum(1))
                best = np.lexsort((row_ids[left], exact))[:k]
                out[0] += [ids[i]] * len(best)
                out[1] += row_ids[left][best].tolist()
                out[2] += exact[best].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                ["query_id", "vec_id", "score"])

    found = met.mapInArrow(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
