"""Near duplicates by SetSketch registers.

A document is the set of its word shingles.  Every shingle throws points on a
line for each register, the same ones wherever it occurs; a register holds the
least point, on an exponential scale, so sketches merge register by register and
equal registers tell of similar sets.  Bands of registers propose pairs, a
likelihood of the registers' order drops pairs that can't be similar, and full
sets confirm the rest.

Copies count once.  A bucket of a band first compares its members with one of
them, its hub.  Where many stay apart, for some rounds the members apart from the
bucket's largest component are compared with a new hub, another member of that
component: what is apart shrinks by a share each round, and a round costs its size.  Components
still apart, and that may be linked by their sketches, form families; there the
members apart from the largest component meet all others, in blocks, with their
full sets, each made once.  So a large group of near copies costs its size, and no
link between components is lost.  Texts with the same 128-bit digest of their sets
count as copies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from parapet.llm.shared import BLANKS, chunks, find_words, hash_words, mix64, stored

BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
BASE = 1.001  # of the register scale
RATE = 20.0  # of a shingle's points; scales all points alike
LIMIT = 2**16 - 2  # registers are 0 to LIMIT + 1
#: A pair is dropped unseen only if its registers are e**DOUBT times likelier below the
#: threshold than at or above it.
DOUBT = 18.0
BLOCK = 256  # members of a bucket that meet at once
HUB_ROUNDS = 4  # new hubs for what is apart, before blocks
HUB_MEMBERS = 2_000  # members that are compared with one hub in one task
BROADCAST_ROWS = 500_000  # ids and hubs, 32 bytes each; more are joined by shuffling

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80


def shingle_sets(texts, words: int):
    """Of an Arrow column of texts, by chunk: distinct shingle hashes, and offsets.

    A text with fewer words is one shingle of all its words; one without words
    has none.
    """
    with np.errstate(over="ignore"):
        for _, _, data, offsets in chunks(texts):
            data = _FOLD[data]
            starts, ends, of = find_words(data, offsets, _BLANK)
            word = hash_words(data, starts, ends)
            first = np.searchsorted(of, np.arange(len(offsets)))
            count = np.diff(first)
            rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
            for k in range(words):
                rolled += mix64(word[k:k + len(rolled)] + np.uint64(k + 1) * _GOLD) * np.uint64(2 * k + 3)
            sets, sizes = [], np.zeros(len(count), np.int64)
            for i in range(len(count)):
                if count[i] >= words:
                    own = np.sort(rolled[first[i]:first[i + 1] - words + 1])
                    own = own[np.r_[True, own[1:] != own[:-1]]]
                elif count[i]:
                    short = np.uint64(count[i])
                    for w in word[first[i]:first[i + 1]]:
                        short = mix64(np.array([short * _GOLD + w]))[0]
                    own = np.array([short])
                else:
                    continue
                sets.append(own)
                sizes[i] = len(own)
            whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield whole, np.concatenate([[0], np.cumsum(sizes)])


def registers(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sketches, one row of REGISTERS 16-bit numbers a set.

    A shingle's points fall on the registers as a Poisson process, which is an
    exponential point of its own per register; drawing stops where a set of this
    size has filled its registers (but for one set in 20,000, which leaves one
    register truncated at 0).
    """
    n = np.diff(offsets)
    least = np.full(len(n) * REGISTERS, np.inf)
    stop = (np.log(REGISTERS) + 10.0) / np.maximum(n, 1)
    of = np.repeat(np.arange(len(n)), n)
    seed, at = shingles, np.zeros(len(shingles))
    turn, ahead = 0, 2
    with np.errstate(over="ignore"):
        while len(seed):
            steps = np.arange(turn + 1, turn + ahead + 1, dtype=np.uint64) * _GOLD
            r = mix64(seed[:, None] ^ mix64(steps)[None, :])
            gaps = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / REGISTERS
            points = np.cumsum(gaps, axis=1) + at[:, None]
            cell = ((mix64(r) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
            row, col = np.nonzero(points < stop[of][:, None])
            np.minimum.at(least, of[row] * REGISTERS + cell[row, col], points[row, col])
            on = points[:, -1] < stop[of]
            seed, of, at = seed[on], of[on], points[on, -1]
            turn, ahead = turn + ahead, min(32, ahead * 2)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(k, 0, LIMIT + 1).astype(np.uint16).reshape(-1, REGISTERS)


def sketch(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), d1 and d2 (digest of the set), sketch (null for an empty set)."""
    import pyarrow as pa

    def make(batches):
        for batch in batches:
            parts = [([], [], [], [])]
            for shingles, offsets in shingle_sets(batch.column(1), words):
                n = np.diff(offsets)
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                some = np.flatnonzero(n)
                with np.errstate(over="ignore"):
                    if len(some):
                        d1[some] = np.add.reduceat(mix64(shingles), offsets[:-1][some])
                        d2[some] = np.bitwise_xor.reduceat(mix64(shingles + _GOLD), offsets[:-1][some])
                own = registers(shingles, offsets)
                parts.append((n.tolist(), d1.view(np.int64).tolist(), d2.view(np.int64).tolist(),
                              [own[i].tobytes() if n[i] else None for i in range(len(n))]))
            n, d1, d2, s = ([x for p in parts for x in p[k]] for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()),
                 pa.array(d2, pa.int64()), pa.array(s, pa.binary())], ["id", "n", "d1", "d2", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "id long, n long, d1 long, d2 long, sketch binary")


def bands(reps: DataFrame) -> DataFrame:
    """key, rep, n: a row for each band of each sketch."""
    import pyarrow as pa

    def make(batches):
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(count, BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, (count, BANDS)).copy()
            with np.errstate(over="ignore"):
                for j in range(ROWS):
                    key = mix64(key + own[:, :, j].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            many = np.repeat(np.arange(count), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64).ravel()), batch.column(0).take(pa.array(many)),
                 batch.column(1).take(pa.array(many))], ["key", "rep", "n"])

    return reps.select("rep", "n", "sketch").mapInArrow(make, "key long, rep long, n long")


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sketches can be of sets as similar as ``percent``.

    Joint estimate: the registers that are larger, smaller and equal have
    probabilities given by the similarity and the two sizes, which are known.
    """
    threshold = percent / 100
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    fits = most >= threshold - 1e-12

    def likelihood(j):
        def p(x):
            return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        pu, pd = p(u - v * j), p(v - u * j)
        logs = [np.log(np.maximum(x, 1e-12)) for x in (pu, pd, 1 - pu - pd)]
        return up * logs[0] + down * logs[1] + same * logs[2]

    best = np.max([likelihood(most * f) for f in np.linspace(0, 1, 41)], axis=0)
    high = np.max([likelihood(threshold + np.maximum(most - threshold, 0) * f) for f in np.linspace(0, 1, 9)], axis=0)
    return fits & (high >= best - DOUBT)


def _groups(batches, keys: int):
    """Consecutive rows with equal values in the first ``keys`` columns, as Arrow tables."""
    import pyarrow as pa

    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table]).combine_chunks()
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in range(keys):
            x = table.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield table.slice(a, b - a)
        kept = table.slice(cuts[-1])
    if kept is not None and kept.num_rows:
        yield kept


class _Forest:
    """Which components of a block are joined so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while x in self.up:
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _candidates(side, comp, n, own, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a block that may link: i apart from the main component, j of
    another component; likeliest first."""
    zero, one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    t, m = percent / 100, own.shape[1]
    least = t * m - 6.5 * np.sqrt(m * t * (1 - t))  # equal registers, a loose bound before the likelihood
    left, right, same = [], [], []
    for i in zero:
        j = one[(comp[one] != comp[i]) & (100 * np.minimum(n[one], n[i]) >= percent * np.maximum(n[one], n[i]))]
        if len(j):
            equal = (own[j] == own[i]).sum(1)
            j, equal = j[equal >= least], equal[equal >= least]
            left.append(np.full(len(j), i))
            right.append(j)
            same.append(equal)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right, same = np.concatenate(left), np.concatenate(right), np.concatenate(same)
    fine = [may_link(own[left[k:k + 5000]], own[right[k:k + 5000]], n[left[k:k + 5000]], n[right[k:k + 5000]], percent)
            for k in range(0, len(left), 5000)]
    fine = np.concatenate([np.zeros(0, bool), *fine])
    order = np.argsort(-same[fine], kind="stable")
    return left[fine][order], right[fine][order]


def _estimated(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components that may be linked: of each block a forest.

    rows: key, left, right (block numbers), side (0: apart from the main
    component, 1: any), rep, comp, n, sketch.
    """
    import pyarrow as pa

    def meet(batches):
        for group in _groups(batches, 3):
            side = group.column(3).to_numpy()
            if side[0] == side[-1]:
                continue
            comp, n = group.column(5).to_numpy(), group.column(6).to_numpy()
            own = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint16).reshape(len(side), -1)
            forest = _Forest()
            pairs = [(int(comp[i]), int(comp[j])) for i, j in zip(*_candidates(side, comp, n, own, percent))
                     if forest.join(int(comp[i]), int(comp[j]))]
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    spread = rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "side")
    return spread.mapInArrow(meet, "a long, b long").distinct()


def _settled(docs: DataFrame, rows: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between components, confirmed on full sets: of each block a forest.

    rows: key, left, right, side, rep, comp.  Every pair of different components
    that may link is compared, until they are joined.
    """
    import pyarrow as pa

    rows = stored(rows.select("key", "left", "right", "side", "rep", "comp"), "near-meetings")
    met = rows.select("rep").distinct()
    if rows.count() <= BROADCAST_ROWS:
        met = F.broadcast(met)
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))

    def sets(batches):
        for batch in batches:
            shingles, sketches = [], []
            for whole, offsets in shingle_sets(batch.column(1), rule.words):
                sketches += [r.tobytes() for r in registers(whole, offsets)]
                shingles += [whole[offsets[i]:offsets[i + 1]].tobytes() for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sketches, pa.binary()), pa.array(shingles, pa.binary())],
                ["rep", "sketch", "shingles"])

    def meet(batches):
        for group in _groups(batches, 3):
            side = group.column(3).to_numpy()
            if side[0] == side[-1]:
                continue
            comp = group.column(4).to_numpy()
            own = np.frombuffer(b"".join(group.column(5).to_pylist()), np.uint16).reshape(len(side), -1)
            full = [np.frombuffer(x, np.uint64) for x in group.column(6).to_pylist()]
            n = np.array([len(x) for x in full])
            forest, pairs = _Forest(), []
            for i, j in zip(*_candidates(side, comp, np.maximum(n, 1), own, rule.percent)):
                a, b = int(comp[i]), int(comp[j])
                if forest.root(a) == forest.root(b):
                    continue
                both = _shared(full[i], full[j])
                if both and 100 * both >= rule.percent * (n[i] + n[j] - both):
                    forest.join(a, b)
                    pairs.append((a, b))
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held = stored(texts.join(met, "rep", "left_semi").mapInArrow(
        sets, "rep long, sketch binary, shingles binary"), "near-sets")
    made = rows.join(held, "rep").select("key", "left", "right", "side", "comp", "sketch", "shingles")
    dealt = made.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "side")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def confirmed(docs: DataFrame, pairs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """The pairs (hub, rep) whose full sets are similar enough.

    Each hub's set goes to its members' tasks, at most HUB_MEMBERS members a task.
    """
    import pyarrow as pa

    wide = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("_parts"))
    placed = pairs.join(wide, "hub").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int"))
    roles = placed.select("hub", "part", F.lit(1).alias("role"), F.col("rep").alias("_id"))
    roles = roles.unionByName(roles.select("hub", "part", F.lit(0).alias("role"), F.col("hub").alias("_id")).distinct())
    roles = stored(roles, "near-roles")
    if roles.count() <= BROADCAST_ROWS:
        roles = F.broadcast(roles)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))

    def sets(batches):
        for batch in batches:
            out = []
            for shingles, offsets in shingle_sets(batch.column(4), rule.words):
                out += [shingles[offsets[i]:offsets[i + 1]].tobytes() for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())],
                                             ["hub", "part", "role", "id", "shingles"])

    def compare(batches):
        at, hubs = None, []
        for batch in batches:
            hub, part, role, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            linked = []
            for i in range(batch.num_rows):
                if at != (hub[i], part[i]):
                    at, hubs = (hub[i], part[i]), []
                mine = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if role[i] == 0:
                    hubs.append(mine.copy())
                    continue
                for other in hubs:
                    both = _shared(mine, other)
                    if 100 * both >= rule.percent * (len(mine) + len(other) - both):
                        linked.append(i)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(hub[linked]), pa.array(own[linked])], ["hub", "rep"])

    made = texts.join(roles, "_id").select("hub", "part", "role", "_id", "text").mapInArrow(
        sets, "hub long, part int, role int, id long, shingles binary")
    dealt = made.repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    return dealt.mapInArrow(compare, "hub long, rep long")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of the nodes in ``edges`` (a, b).

    Alternating stars: every node hands its larger, then its smaller neighbours to
    the least of them, until only stars are left; the rounds grow with the logarithm
    of the longest path.
    """
    edges = stored(edges.where("a <> b").select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "near-edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least("v", F.min("u")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lower, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(
            lower.select("v", F.col("m").alias("u")))
        edges = stored(small.where("v <> u").distinct(), "near-edges")
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is no larger end itself."""
    ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("u").alias("x"), F.lit(0).alias("up")))
    mixed = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where(
        "ups > 1 OR (ups = 1 AND least = 0)")
    return mixed.isEmpty()


def _apart(placed: DataFrame) -> DataFrame:
    """The rows of ``placed`` (key, rep, n, comp) whose key has more than a block of
    members outside its largest component, ``main``.  Others cost their size in blocks."""
    each = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = each.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("x"), F.sum("c").alias("all"))
    wide = mixed.where(F.col("all") - F.col("x.c") > BLOCK).select("key", F.col("x.comp").alias("main"))
    return placed.join(wide, "key")


def _new_hubs(apart: DataFrame, turn: int, percent: int) -> DataFrame:
    """(rep, hub): what is apart with a member of its buckets' largest components.

    The member is picked by a hash, so buckets that share members mostly share it; a
    document takes the one it shares most buckets with.
    """
    pick = F.min(F.struct(F.xxhash64("rep", F.lit(turn)), "rep", "n")).alias("x")
    hubs = apart.where("comp = main").groupBy("key").agg(pick).select(
        "key", F.col("x.rep").alias("hub"), F.col("x.n").alias("hub_n"))
    near = apart.where("comp <> main").join(hubs, "key").where(
        100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    near = near.groupBy("rep", "hub").agg(F.count("*").alias("bands"))
    return near.groupBy("rep").agg(F.max(F.struct("bands", "hub")).alias("x")).select("rep", "x.hub")


def _meetings(placed: DataFrame) -> DataFrame:
    """placed (key, rep, comp, ...) with left, right and side, where a key has several components.

    Of each key, the members apart from its largest component meet all members, in
    blocks: a large component costs its size for every BLOCK others.
    """
    each = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    whole = each.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"),
                                    F.count("*").alias("kinds")).where("kinds > 1")
    whole = whole.select("key", F.col("main.comp").alias("main"), F.ceil(F.col("all") / BLOCK).alias("rights"),
                         F.ceil((F.col("all") - F.col("main.c")) / BLOCK).alias("lefts"))
    rows = placed.join(whole, "key").withColumn("other", F.col("comp") != F.col("main"))
    left = F.pmod(F.xxhash64("rep"), F.col("lefts"))
    right = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rights"))
    as_any = rows.withColumn("left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1))).withColumn(
        "right", right).withColumn("side", F.lit(1))
    as_other = rows.where("other").withColumn("right", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1))).withColumn(
        "left", left).withColumn("side", F.lit(0))
    columns = ["key", "left", "right", "side", *[c for c in placed.columns if c != "key"]]
    return as_any.select(*columns).unionByName(as_other.select(*columns))


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Every row with n_shingles, component_id (smallest id reachable) and kept.

    A null, empty or blank text has an empty set and is linked with nothing.  Rows
    that share an id are one document.  A null id is linked with nothing and kept.
    Only A-Z are lower-cased.  Other columns play no part.  An empty table gives
    an empty result.
    """
    sketches = stored(sketch(docs, rule.words, id_col, text_col), "near-sketches")
    sets = sketches.where("n > 0 AND id IS NOT NULL")
    reps = stored(sets.groupBy("d1", "d2").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-reps")
    rows = bands(reps)
    shared = rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("_first"), F.max("rep").alias("_last"))
    shared = shared.where("_first.rep < _last").select("key", F.col("_first.rep").alias("hub"), F.col("_first.n").alias("hub_n"))
    buckets = stored(rows.join(shared, "key"), "near-buckets")

    # every document with the hub it shares most bands with
    near = buckets.where("rep <> hub").where(
        100 * F.least("n", "hub_n") >= rule.percent * F.greatest("n", "hub_n"))
    near = near.groupBy("rep", "hub").agg(F.count("*").alias("bands"))
    star = near.groupBy("rep").agg(F.max(F.struct("bands", "hub")).alias("x")).select("rep", "x.hub")
    links = stored(confirmed(docs, stored(star, "near-star"), rule, id_col, text_col), "near-links")
    same = sets.join(reps.select("d1", "d2", "rep"), ["d1", "d2"])
    same = stored(same.select("id", "rep"), "near-copies")
    twice = same.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    edges = links.select(F.col("hub").alias("a"), F.col("rep").alias("b")).unionByName(twice)
    comps = stored(components(edges), "near-components")

    placed = wide = buckets.select("key", "rep", "n")
    for turn in range(1, HUB_ROUNDS + 1):
        named = wide.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        apart = stored(_apart(named), "near-apart")
        if apart.isEmpty():
            break
        wide = apart.select("key", "rep", "n")
        star = stored(_new_hubs(apart, turn, rule.percent), "near-star")
        links = stored(confirmed(docs, star, rule, id_col, text_col), "near-links")
        comps = stored(components(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(
            links.select(F.col("hub").alias("a"), F.col("rep").alias("b")))), "near-components")

    # buckets whose members are in several components: similar sizes are in the same
    # or neighbouring classes
    level = F.floor(F.log("n") / F.lit(-np.log(rule.percent / 100 - 1e-9)))
    placed = placed.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.withColumn("level", F.explode(F.array(level, level + 1))).select(
        F.xxhash64("key", "level").alias("key"), "rep", F.coalesce("component", "rep").alias("comp"), "n")
    rows = _meetings(placed).join(reps.select("rep", "sketch"), "rep").select(
        "key", "left", "right", "side", "rep", "comp", "n", "sketch")
    families = components(_estimated(rows, rule.percent))  # of components that may be linked
    own = reps.select("rep").distinct().join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("comp"))
    members = own.join(families.select(F.col("node").alias("comp"), F.col("component").alias("key")), "comp")
    more = _settled(docs, _meetings(members.select("key", "rep", "comp")), rule, id_col, text_col)
    comps = components(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    found = same.join(comps.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(
        F.min(F.coalesce("component", "rep")).alias("component_id"))
    return sketches.select("id", "n").join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id."""
    found = near_duplicates(docs, rule, id_col, text_col)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti").select(*docs.columns)
