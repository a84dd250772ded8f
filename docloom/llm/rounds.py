"""Rounds of question and answer between groups of documents ("chunks") and hash ranges ("buckets").

A chunk holds about CHUNK_BYTES of text, dealt by doc_id. In each round every chunk asks every bucket about the distinct
hashes it holds (one packed row for each pair, so a key that fills the corpus counts once for each chunk), and each bucket
answers the chunk. Spark deals, shuffles and recomputes all of it; the number of chunks, of buckets and of tasks follows
the bytes of text, so that a task's memory and input stay the same at every size. A chunk never sends more letters than it
has distinct hashes; where there are more buckets than that, a letter is a row of one hash with some forty bytes beside it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text for each chunk, bucket and shuffle task; up to SPREAD chunks or buckets are smaller where the input is small.
CHUNK_BYTES, BUCKET_BYTES, SPREAD, SMALL_BYTES, TASK_BYTES = 4_000_000, 8_000_000, 48, 100_000, 16_000_000
MAIL = "receiver int, sender int, body binary"
MAIL_ARROW = pa.schema([("receiver", pa.int32()), ("sender", pa.int32()), ("body", pa.binary())])
NO_ID = np.iinfo(np.int64).max


def sealed(arrays: tuple[np.ndarray, ...]) -> bytes:
    """Flat arrays end to end, each after its type and its number of bytes."""
    return b"".join(x for a in arrays for x in (struct.pack("<2sI", a.dtype.str[1:].encode(), a.nbytes), np.ascontiguousarray(a).tobytes()))


def opened(body: bytes) -> tuple[np.ndarray, ...]:
    out, at = [], 0
    while at < len(body):
        kind, size = struct.unpack_from("<2sI", body, at)
        out.append(np.frombuffer(body, kind.decode(), offset=at + 6, count=size // int(kind[1:])))
        at += 6 + size
    return tuple(out)


def mail(rows: list[tuple[int, int, tuple[np.ndarray, ...]]]) -> pa.Table:
    return pa.Table.from_pydict({"receiver": [r[0] for r in rows], "sender": [r[1] for r in rows], "body": [sealed(r[2]) for r in rows]}, schema=MAIL_ARROW)


def letters(table: pa.Table) -> list[tuple[int, int, tuple[np.ndarray, ...]]]:
    """(receiver, sender, arrays) in the order of senders."""
    got = zip(table["receiver"].to_pylist(), table["sender"].to_pylist(), table["body"].to_pylist(), strict=True)
    return [(to, by, opened(body)) for to, by, body in sorted(got, key=lambda x: (x[0], x[1]))]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit hash, from its upper half."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def split_at(sorted_buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.flatnonzero(np.diff(sorted_buckets)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_buckets)], strict=True):
        if b > a:
            yield int(sorted_buckets[a]), slice(a, b)


def in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows in the order of doc_id (null last), then text, so that each pass over it numbers alike."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table["doc_id"], NO_ID).to_numpy().astype(np.int64)


def dealt(docs: DataFrame, keep: list[str], *by: str) -> tuple[DataFrame, int, int, int]:
    """docs as (doc_id, text, columns to keep, chunk by hash of `by`), and the numbers of chunks, buckets and tasks."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    chunks, buckets = (max(1, min(SPREAD, size // SMALL_BYTES), -(-size // most)) for most in (CHUNK_BYTES, BUCKET_BYTES))
    kept = [F.col(c).alias(f"kept_column_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    return rows.withColumn("chunk", F.pmod(F.xxhash64(*by), F.lit(chunks)).cast("int")), int(chunks), int(buckets), int(tasks)


def back(kind: Callable[[list], list]) -> Callable[[tuple, pa.Table], pa.Table]:
    """A bucket's replies to the letters it got; a letter to a receiver below 0 returns to its sender unread."""

    def reply(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return pa.Table.from_arrays([table["sender"], table["receiver"], table["body"]], schema=MAIL_ARROW)
        return mail(kind(letters(table)))

    return reply


def one_round(
    docs: DataFrame,
    marked: DataFrame,
    ask: Callable[[pa.Table, int, int], pa.Table],
    answer: Callable[[list], list],
    decide: Callable[[pa.Table, list, int], pa.Table],
    schema: str,
) -> DataFrame:
    """ask -> answer -> decide. The doc_ids of `marked` go to the chunks of their documents, as rows whose `mark` is true."""
    named = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))  # no mark is for a null
    rows, chunks, buckets, tasks = dealt(docs.select("doc_id", "text", named.alias("named")), ["named"], "kept_column_0")
    marks = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(chunks)).cast("int").alias("chunk"))
    rows = rows.drop("kept_column_0").withColumn("mark", F.lit(False)).unionByName(marks.filter("doc_id IS NOT NULL").withColumn("mark", F.lit(True)))

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return ask(in_order(table), key[0].as_py(), buckets)

    def last(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        return decide(in_order(table), letters(got), buckets)

    by_chunk = rows.repartition(tasks, "chunk").groupBy("chunk")
    post = lambda sent: sent.repartition(tasks, "receiver").groupBy("receiver")
    answered = post(by_chunk.applyInArrow(first, MAIL)).applyInArrow(back(answer), MAIL)
    return by_chunk.cogroup(post(answered)).applyInArrow(last, schema)


def two_rounds(
    docs: DataFrame,
    ask: Callable[[pa.Table, int, int], pa.Table],
    answer: Callable[[list], list],
    ask_again: Callable[[pa.Table, list, int, int], pa.Table],
    answer_again: Callable[[list], list],
    decide: Callable[[pa.Table, list, int], pa.Table],
    schema: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """ask -> answer -> ask_again -> answer_again -> decide.

    Columns of docs named in `keep` are handed to the result, beside those that decide gives.
    """
    keep = keep or []
    rows, _, buckets, tasks = dealt(docs, keep, "doc_id", "text")  # rows that share or lack a doc_id spread by text

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return ask(in_order(table), key[0].as_py(), buckets)

    def second(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        return ask_again(in_order(table), letters(got), key[0].as_py(), buckets)

    def last(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        table = in_order(table)
        out = decide(table, letters(got), buckets)
        for c in (c for c in table.column_names if c.startswith("kept_column_")):
            out = out.append_column(c, table[c])
        return out

    by_chunk = rows.repartition(tasks, "chunk").groupBy("chunk")
    post = lambda sent: sent.repartition(tasks, "receiver").groupBy("receiver")
    answered = post(by_chunk.applyInArrow(first, MAIL)).applyInArrow(back(answer), MAIL)
    asked = by_chunk.cogroup(post(answered)).applyInArrow(second, MAIL)
    answered = post(asked).applyInArrow(back(answer_again), MAIL)
    extra = "".join(f", kept_column_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    decided = by_chunk.cogroup(post(answered)).applyInArrow(last, schema + extra)
    return decided.withColumnsRenamed({f"kept_column_{i}": c for i, c in enumerate(keep)})
