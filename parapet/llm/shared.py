"""What several operators need: shared files, and texts as arrays of bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from parapet.operators.lineage import shared_dir

#: Words of the contracts: runs of bytes other than space and the controls 9 to 13.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts are worked on in chunks of about so many bytes, which bounds the memory of a task.
CHUNK_BYTES = 1_000_000


def shared_folder(spark, name: str) -> str:
    """A new folder name below the session's shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as a table in the shared folder and read from there.

    What follows doesn't depend on executors that made the rows.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables like those of ``stored`` that are removed once nothing reads them any more.

    Shuffles of the job that writes a table are freed as it ends, so that disk is
    that of one job and of the tables that are still needed.
    """

    FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark):
        self.spark, self.folders = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(self.FREED, None)
        self.spark.conf.set(self.FREED, "true")
        path = shared_folder(self.spark, name)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(self.FREED) if before is None else self.spark.conf.set(self.FREED, before)
        self.folders.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def removed(self, *names: str) -> None:
        """Remove the tables of these names."""
        for name in names:
            for folder in self.folders.pop(name, []):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, df: DataFrame) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is.

    Texts of one-byte characters take the quick path; both give the same.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def held_out(doc_id: Column) -> Column:
    """Whether labels of this row are for evaluation only; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chunks(texts, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """An Arrow column of texts as (first row, row after the last, bytes, offsets).

    The offsets count from the chunk's first byte.  A null is an empty text.  A
    text longer than ``size`` is a chunk of its own.
    """
    import pyarrow as pa

    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with all bits mixed (the splitmix64 finish)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_PLACES = 1 << 12
_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, _PLACES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def find_words(
    data: np.ndarray, offsets: np.ndarray, blank: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words; ``blank[b]``: byte b is in no word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, finishes = inside.copy(), inside
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a random multilinear form of its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(total, dtype=np.int64)
    place -= np.repeat(first, lengths)
    own = data[place + np.repeat(starts, lengths)]
    value = _BYTE[own] * _PLACE[place & (_PLACES - 1)]
    if lengths.max() > _PLACES:  # further places get other factors
        value *= (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(1)
    found = np.add.reduceat(value, first)
    return mix64(found + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
