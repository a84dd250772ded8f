"""Running sums of a stream kept in a keyed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyed import KeyedTable

KEY, BATCH = "rollup_key", "last_batch"


def rollup_table(stream: DataFrame, path: str, by: dict[str, Column], sums: dict[str, Column], buckets: int = 64) -> KeyedTable:
    """An empty table for the sums of a frame: rollup_key, the columns of `by` and `sums`, last_batch."""
    spark = stream.sparkSession
    kinds = stream.select(*[c.alias(k) for k, c in by.items()]).schema
    ddl = ", ".join([f"{KEY} string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), *(f"`{c}` bigint" for c in sums), f"{BATCH} bigint"])
    return KeyedTable.create(spark.createDataFrame([], ddl), path, KEY, buckets)


def batch_adder(table: KeyedTable, by: dict[str, Column], sums: dict[str, Column]) -> Callable[[DataFrame, int], None]:
    """What a stream does with each of its batches: whole-number sums are added to the table.

    Each row names the last batch that was added to it, and a batch isn't added to rows that name it or a later one. So a
    batch that is replayed adds nothing, nor does it where only some buckets were replaced before a crash. The table
    belongs to one stream with one checkpoint, whose batch numbers only grow.
    """

    def add(rows: DataFrame, batch: int) -> None:
        groups = [c.alias(k) for k, c in by.items()]
        delta = rows.groupBy(*groups).agg(*[F.sum(c).cast("long").alias(f"added_{k}") for k, c in sums.items()])
        delta = delta.withColumn(KEY, F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(by)]), {"ignoreNullFields": "false"}))
        old = table.rows.select(KEY, BATCH, *[F.col(f"`{k}`").alias(f"old_{k}") for k in sums])
        fresh = delta.join(old, KEY, "left").filter(F.coalesce(F.col(BATCH) < batch, F.lit(True)))
        total = [(F.coalesce(F.col(f"old_{k}"), F.lit(0)) + F.coalesce(F.col(f"added_{k}"), F.lit(0))).alias(k) for k in sums]
        table.upsert(fresh.select(KEY, *[F.col(f"`{k}`") for k in by], *total, F.lit(batch).cast("long").alias(BATCH)))

    return add


def add_stream(stream: DataFrame, table: KeyedTable, by: dict[str, Column], sums: dict[str, Column], checkpoint: str) -> StreamingQuery:
    """Add what has arrived, batch by batch, and end; run it again for more."""
    return stream.writeStream.foreachBatch(batch_adder(table, by, sums)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
