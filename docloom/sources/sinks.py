"""Sinks (K01-K09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import newest


def upserted(stored: DataFrame, new: DataFrame, key: str = "id", order: list[Column] | None = None) -> DataFrame:
    """Stored rows with new ones; of a key on both sides the new row stays, of several new ones the first by `order`.

    The result is written as a whole, or not at all; `keyed.KeyedTable` changes a table in place.
    """
    return stored.join(new.select(key), key, "left_anti").unionByName(newest(new, key, order))


def write_texts(texts: DataFrame, path: str, key: str = "material_id") -> None:
    """Texts by material. An id that could leave the folder, or none, stops the write with an error before anything is written."""
    safe = F.coalesce(F.col(key).cast("string").rlike(r"^[A-Za-z0-9_-]+$"), F.lit(False))
    bad = texts.filter(~safe).select(F.col(key).cast("string")).head(3)
    if bad:
        raise ValueError(f"unsafe values of {key}: {[r[0] for r in bad]}")
    texts.write.mode("append").parquet(path)


def write_records(rows: DataFrame, path: str) -> None:
    """One JSON record a line; no task gathers them all."""
    rows.write.mode("overwrite").json(path)


def records_with_header(rows: DataFrame, name: str, order: str) -> DataFrame:
    """One document with header and records, for exports small enough for one value."""
    each = F.struct(*rows.columns)
    return rows.agg(F.to_json(F.struct(F.struct(F.lit(name).alias("collection"), F.count("*").alias("count")).alias("meta"), F.transform(F.sort_array(F.collect_list(F.struct(order, each.alias("r")))), lambda x: x["r"]).alias("records"))).alias("json"))


def write_export(rows: DataFrame, path: str, name: str, order: str, per_document: int = 5000) -> None:
    """Documents with header and records, as files of some `per_document` records each, dealt by hash; no task gathers more.

    Each is a document of its own, as records_with_header makes it, with its number among them in `meta`.
    """
    parts = max(1, -(-rows.count() // per_document))
    each = rows.select(F.pmod(F.xxhash64(order), F.lit(parts)).cast("int").alias("part"), F.struct(F.col(f"`{order}`").alias("o"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r")).alias("x"))
    records = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"])
    meta = F.struct(F.lit(name).alias("collection"), F.count("*").alias("count"), F.col("part"), F.lit(parts).alias("parts")).alias("meta")
    documents = each.groupBy("part").agg(meta, records.alias("records")).select("part", F.to_json(F.struct("meta", "records")).alias("json"))
    documents.repartition(parts, "part").write.mode("overwrite").partitionBy("part").text(path)


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A Parquet side-car."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def conversation_rows(turns: DataFrame) -> DataFrame:
    """A user row and an assistant row for each turn; only the latter carries metadata."""
    user = turns.select("session_id", "turn", F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("text"), F.lit(None).cast("string").alias("meta"))
    return user.unionByName(turns.select("session_id", "turn", F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("text"), "meta"))


def block_rows(messages: DataFrame, blocks: Column, key: str = "message_id", most: int = 5000) -> DataFrame:
    """Numbered blocks of each message, cut."""
    return messages.select(key, F.posexplode(blocks).alias("block_index", "block")).select(key, "block_index", F.substring("block", 1, most).alias("text"))


def append(rows: DataFrame, path: str) -> None:
    """An append-only log."""
    rows.write.mode("append").parquet(path)
