"""Exact seeded splits and samples that neither sort nor shuffle the rows.

Rows are ordered by a seeded hash of their id.  The hash values at which the
order is to be cut are found by counting hash prefixes; the cut itself is then
a plain filter over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from parapet import fixed_values as fv
from parapet.functions.picks import shuffle_key

_PREFIX_STEP = 3          # hex digits looked at per pass: at most 4,096 counts
_SMALL_BUCKET = 4096      # few enough keys to read them one by one
_KEY_LENGTH = 32


@dataclass(frozen=True)
class Cut:
    """Keys below ``key`` are in; of the rows at ``key`` itself, ``ties`` are."""

    key: str
    ties: int
    rows_at_key: int

    @property
    def exact(self) -> bool:
        return self.ties == self.rows_at_key


def find_cuts(keys: DataFrame, key: str, ranks: list[int]) -> dict[int, Cut]:
    """For each rank r, the cut that takes the r smallest keys.

    ``keys`` holds the key column only.  Every pass is one aggregation that
    returns at most 4,096 counts per rank to the driver.
    """
    cuts: dict[int, Cut] = {}
    open_ranks = {rank: ("", rank) for rank in ranks if rank > 0}
    for rank in ranks:
        if rank <= 0:
            cuts[rank] = Cut("", 0, 0)
    for depth in range(_PREFIX_STEP, _KEY_LENGTH + _PREFIX_STEP, _PREFIX_STEP):
        if not open_ranks:
            break
        scope = keys
        prefixes = sorted({prefix for prefix, _ in open_ranks.values()})
        if prefixes != [""]:
            scope = keys.where(F.substring(key, 1, depth - _PREFIX_STEP).isin(prefixes))
        counts = sorted(
            (row["prefix"], row["n"])
            for row in scope.groupBy(F.substring(key, 1, depth).alias("prefix"))
            .agg(F.count("*").alias("n")).collect()
        )
        small = []
        for rank, (prefix, rest) in list(open_ranks.items()):
            inside = [c for c in counts if c[0].startswith(prefix)]
            for value, n in inside:
                if rest <= n:
                    break
                rest -= n
            else:
                # fewer rows than asked for: everything is in
                cuts[rank] = Cut("g", 0, 0)
                del open_ranks[rank]
                continue
            open_ranks[rank] = (value, rest)
            if depth >= _KEY_LENGTH:
                cuts[rank] = Cut(value, rest, n)
                del open_ranks[rank]
            elif n <= _SMALL_BUCKET:
                small.append(rank)
        if small:
            wanted = sorted({open_ranks[rank][0] for rank in small})
            found = sorted(
                row[0] for row in
                keys.where(F.substring(key, 1, depth).isin(wanted)).select(key).collect()
            )
            for rank in small:
                prefix, rest = open_ranks.pop(rank)
                inside = [k for k in found if k.startswith(prefix)]
                value = inside[rest - 1]
                first = inside.index(value)
                cuts[rank] = Cut(value, rest - first, inside.count(value))
    return cuts


def take_smallest(df: DataFrame, key: Column, count: int) -> DataFrame:
    """Exactly ``count`` rows, those with the smallest keys."""
    keyed = df.withColumn("_key", key)
    cut = find_cuts(keyed.select("_key"), "_key", [count])[count]
    if cut.exact:
        return keyed.where(F.col("_key") <= cut.key).drop("_key")
    below = keyed.where(F.col("_key") < cut.key)
    if cut.key == "g":
        return below.drop("_key")
    # copies of one id share a key: any of them will do
    tied = keyed.where(F.col("_key") == cut.key).limit(cut.ties)
    return below.unionByName(tied).drop("_key")


def split_sizes(
    rows: int,
    train: float = fv.TRAIN_RATIO,
    validation: float = fv.VALIDATION_RATIO,
    test: float = fv.TEST_RATIO,
) -> dict[str, int]:
    """Sizes of the parts: the test part is cut off the end first, the ratios
    for training and validation then apply to what is left."""
    n_test = int(rows * test)
    rest = rows - n_test
    n_train = int(rest * train)
    n_validation = int(rest * validation)
    return {
        "train": n_train,
        "validation": n_validation,
        "unused": rest - n_train - n_validation,
        "test": n_test,
    }


def split_ratio(
    df: DataFrame,
    id_column: str = "message_id",
    seed: str = "42",
    train: float = fv.TRAIN_RATIO,
    validation: float = fv.VALIDATION_RATIO,
    test: float = fv.TEST_RATIO,
) -> DataFrame:
    """Add ``split`` (train, validation, unused, test), with exact part sizes.

    Ids are expected to be unique; copies of one id stay in one part.
    """
    keyed = df.withColumn("_key", shuffle_key(F.col(id_column), seed))
    sizes = split_sizes(df.count(), train, validation, test)
    ends, total = {}, 0
    for part in ["train", "validation", "unused"]:
        total += sizes[part]
        ends[part] = total
    cuts = find_cuts(keyed.select("_key"), "_key", sorted(set(ends.values())))
    part = F.lit("test")
    for name in ["unused", "validation", "train"]:
        part = F.when(F.col("_key") <= cuts[ends[name]].key, F.lit(name)).otherwise(part)
    return keyed.withColumn("split", part).drop("_key")


def split_hashed(
    df: DataFrame, id_column: str = "message_id", seed: str = "42",
    train: float = fv.TRAIN_RATIO, validation: float = fv.VALIDATION_RATIO,
    test: float = fv.TEST_RATIO,
) -> DataFrame:
    """The same parts in expectation, in a single pass and usable on a stream."""
    digits = F.substring(shuffle_key(F.col(id_column), seed), 1, 12)
    place = F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** 12))
    rest = 1.0 - test
    return df.withColumn(
        "split",
        F.when(place < rest * train, "train")
        .when(place < rest * (train + validation), "validation")
        .when(place < rest, "unused")
        .otherwise("test"),
    )


def blend_sources(
    base: DataFrame,
    extra: DataFrame,
    ratio: float = fv.BLEND_RATIO,
    id_column: str = "message_id",
    seed: str = "42",
    columns: list[str] | None = None,
) -> DataFrame:
    """Base rows plus so many extra rows that these make up ``ratio`` of all.

    Adds ``shuffle_key``; ordering by it gives the shuffled dataset.
    """
    from parapet.operators.prepare import fill_missing_columns
    from parapet.schemas import DATASET_COLUMNS

    columns = columns or DATASET_COLUMNS
    wanted = int(base.count() * ratio / (1.0 - ratio))
    take = min(wanted, extra.count())
    blended = base.select(*columns)
    if take > 0:
        drawn = take_smallest(extra, shuffle_key(F.col(id_column), seed), take)
        blended = blended.unionByName(fill_missing_columns(drawn, columns).select(*columns))
    return blended.withColumn("shuffle_key", shuffle_key(F.col(id_column), f"{seed}-order"))
