"""A table changed in place by key (K01, D01-D07): key buckets as partitions, of which a change rewrites only those that it alters.

A row's bucket is a hash of its key. A change is first reduced to the rows that differ from what is stored, its buckets are
listed (a bounded number of them), and only these are read, merged and written with partitionOverwriteMode=dynamic; files
of all other buckets stay the same, and a change that has been made already writes nothing. Each bucket's merge is a task
of its own, so its size is the bound of a task: choose `buckets` for some 100 MB each.

One writer at a time. Buckets are replaced one by one when the write commits: after a crash between them, making the same
change again completes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET, HOLDER, MOST_BUCKETS = "key_bucket", "bucket_holder", 65_536


def newest(rows: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """One row of each key, null too: the first by `order`, and by a hash of the whole row among equals."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(order or []), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])))
    return rows.withColumn("place_of_key", place).filter("place_of_key = 1").drop("place_of_key")


def all_equal(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[f"`{c}`"].eqNullSafe(right[f"`{c}`"]) for c in columns])


class KeyedTable:
    """A table at a path that all executors reach. Columns of map type can't be compared and aren't allowed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.key, buckets, self.schema = spark.read.text(f"{path}/about").first()[0].split("\t")
        self.buckets = int(buckets)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str = "id", buckets: int = 64, order: list[Column] | None = None) -> KeyedTable:
        """A new table; of rows with one key the first by `order` stays."""
        if not 0 < buckets <= MOST_BUCKETS:
            raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        rows.sparkSession.createDataFrame([(f"{key}\t{buckets}\t{ddl}",)], "value string").coalesce(1).write.text(f"{path}/about")
        table = cls(rows.sparkSession, path)
        table._write(table._bucketed(newest(rows, key, order)), list(range(buckets)))
        return table

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _stored(self, touched: list[int] | None = None) -> DataFrame:
        found = self.spark.read.schema(f"{self.schema}, {HOLDER} boolean, {BUCKET} int").parquet(f"{self.path}/rows").filter(f"NOT {HOLDER}").drop(HOLDER)
        return found.filter(F.col(BUCKET).isin(touched)) if touched is not None else found

    @property
    def rows(self) -> DataFrame:
        """The rows as they are now."""
        return self._stored().drop(BUCKET)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # MOST_BUCKETS numbers

    def _write(self, rows: DataFrame, touched: list[int]) -> None:
        """Put rows in place of all that the touched buckets held; a holder row keeps a bucket that has lost all of its own."""
        holders = self.spark.createDataFrame([(b, True) for b in touched], f"{BUCKET} int, {HOLDER} boolean")
        whole = rows.withColumn(HOLDER, F.lit(False)).unionByName(holders, allowMissingColumns=True)
        dealt = whole.repartition(len(touched), BUCKET).sortWithinPartitions(BUCKET, self.key)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")

    def upsert(self, new: DataFrame, order: list[Column] | None = None) -> int:
        """Insert rows, or put them in place of those with their keys; the number of buckets written.

        Of new rows with one key the first by `order` counts. A null key is a key like others.
        """
        new = self._bucketed(newest(new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.rows.schema]), self.key, order)).persist()
        try:
            stored = self._stored(self._touched(new))
            changed = new.join(stored, all_equal(new, stored, new.columns), "left_anti").persist()
            if touched := self._touched(changed):
                stored = self._stored(touched)
                kept = stored.join(changed.select(F.col(f"`{self.key}`").alias("changed_key")), stored[f"`{self.key}`"].eqNullSafe(F.col("changed_key")), "left_anti")
                self._write(kept.unionByName(changed), touched)
            changed.unpersist()
            return len(touched)
        finally:
            new.unpersist()

    def update(self, where: Column, values: dict[str, Column]) -> int:
        """Set columns of the rows for which a condition holds."""
        return self.upsert(self.rows.filter(where).withColumns(values))

    def delete(self, where: Column) -> int:
        """Remove the rows for which a condition is true (unknown ones stay); the number of buckets written."""
        gone = F.coalesce(where, F.lit(False))
        if touched := self._touched(self._stored().filter(gone)):
            self._write(self._stored(touched).filter(~gone), touched)
        return len(touched)
