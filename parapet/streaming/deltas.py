"""State of a stream as small tables: what a micro-batch adds, and merges of it.

Every table is split by a hash of its key, and a micro-batch reads only the
splits of its own keys and writes only its own rows.  Tables of about the same age
are merged when there are several (four of a level become one of the next), so
there are few, and each row is rewritten a logarithmic number of times.  Version N
lists the tables that hold after micro-batch N.  A batch that is repeated reads
version N - 1 again and overwrites version N; what neither of the two needs any more
is removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BUCKETS = 32
MERGE_AT = 4
_HEADS = "name string, version int, level int"


@dataclass
class DeltaState:
    """The state in ``folder`` before micro-batch ``batch``, and what it adds."""

    spark: SparkSession
    folder: str
    batch: int
    buckets: int = BUCKETS
    merge_at: int = MERGE_AT

    def __post_init__(self):
        rows = []
        if self.batch > 0:
            rows = self.spark.read.schema(_HEADS).parquet(f"{self.folder}/heads/version={self.batch - 1}").collect()
        self.before: dict[str, list[tuple[int, int]]] = {}
        for r in rows:  # a few a table
            self.before.setdefault(r["name"], []).append((r["version"], r["level"]))
        self.after = {name: list(own) for name, own in self.before.items()}

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def _table(self, name: str, versions: list[int], only: list[int] | None = None) -> DataFrame | None:
        if not versions:
            return None
        base = f"{self.folder}/{name}"
        rows = self.spark.read.option("basePath", base).parquet(*[f"{base}/version={v}" for v in sorted(versions)])
        return rows if only is None else rows.where(F.col("bucket").isin(only))

    def read(self, name: str, key: str, keys: DataFrame) -> DataFrame | None:
        """The rows before this batch whose ``key`` is among ``keys`` (one column, the
        batch's own); of several with the same key and version-wise order, all."""
        own = keys.toDF(key).distinct()
        only = [r["b"] for r in own.select(self._bucket(key).alias("b")).distinct().collect()]  # at most all buckets
        rows = self._table(name, [v for v, _ in self.before.get(name, [])], only)
        if rows is None:
            return None
        named = own.withColumnRenamed(key, "_key")
        return rows.join(named, rows[key].eqNullSafe(named["_key"]), "left_semi").drop("bucket")

    def newest(self, name: str, key: str, keys: DataFrame) -> DataFrame | None:
        """As ``read``, of each key the row written last."""
        rows = self.read(name, key, keys)
        return None if rows is None else _latest(rows, key)

    def add(self, name: str, key: str, rows: DataFrame, replace: bool = False) -> None:
        """Write rows of this batch; with ``replace`` a row takes the place of an older
        one of its key, without it is one more."""
        live = self.before.get(name, [])
        merged, level = [], 0
        while True:
            same = [v for v, own in live if own == level]
            if len(same) + 1 < self.merge_at:
                break
            merged += same
            level += 1
        placed = rows.withColumn("bucket", self._bucket(key))
        older = self._table(name, merged)
        if older is not None:
            placed = placed.withColumn("version", F.lit(self.batch)).unionByName(older.select(*placed.columns, "version"))
            if replace:
                placed = _latest(placed, key)
            placed = placed.drop("version")
        # a file for each split
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.folder}/{name}/version={self.batch}")
        self.after[name] = [x for x in live if x[0] not in merged] + [(self.batch, level)]

    def commit(self) -> None:
        """Name the tables that hold now, and remove those that no repeat can need."""
        rows = [(name, *x) for name, own in self.after.items() for x in own]
        self.spark.createDataFrame(rows, _HEADS).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/heads/version={self.batch}")
        if self.after == self.before:  # a batch that adds nothing makes nothing superfluous
            return
        needed = {(name, v) for held in (self.before, self.after) for name, own in held.items() for v, _ in own}
        needed |= {("heads", self.batch), ("heads", self.batch - 1)}
        for name in [*self.after, "heads"]:
            for path, version in self._versions(name):
                if version <= self.batch and (name, version) not in needed:
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _versions(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return
        for status in system.listStatus(path):
            found = status.getPath().getName()
            if found.startswith("version="):
                yield status.getPath(), int(found.split("=")[1])


def _latest(rows: DataFrame, key: str) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc("version"))
    return rows.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")
