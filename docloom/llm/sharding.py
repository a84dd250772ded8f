"""Sharding by histogram sort: documents fall into key ranges of near equal bytes.

A document's key is a hash of its text, then a hash of its doc_id, so that equal texts are neighbours. Splitters are found
in rounds: candidate boundaries are laid into the range that each splitter can still be in, every partition counts the exact
bytes of its keys between the candidates, and the ranges shrink to the candidates that enclose the targets. A splitter stays
between two texts if that leaves it within `whole` of a shard of its target; else it goes between two documents of the text
that lies across the target, so that no group of copies, however large, makes shards unequal, and at most one group for
each splitter is parted. Then the rows are exchanged once.

Keys and sizes are written once (24 bytes a row), and rounds read only that; a round sends at most PROBES counts for each
splitter to the driver. A shard is written by as many tasks as its bytes ask for: it is cut into slices by hash whose rows are
counted beforehand, so slots run from 0 without gaps although no task sees the whole shard.

Empty cases: a null text counts as empty (its bytes are the fixed OVERHEAD of a row); a null doc_id has the key of an empty
string; rows equal in text and doc_id have one key and stay together; texts longer than a shard make the shard that holds
them longer; of an empty table, or one of few rows, some shards are empty; columns named like the new ones are replaced.
The input must give the same rows each time that it is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pipeline_io import shared_folder

OVERHEAD, SLICE_BYTES, PROBES, BROADCAST_ROWS = 16, 16_000_000, 64, 1_000_000
TOP = 1 << 60
Key = tuple[int, int]
COUNTS = "place int, bytes long, least_text long, most_text long, least_doc long, most_doc long"


def hash_60(c: Column) -> Column:
    """A number below 2**60 of a string; null as the empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def size_of(text: Column) -> Column:
    """Bytes of a text and of what goes with each row."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + OVERHEAD


class Probes:
    """Candidate boundaries, sorted; each stands before its key."""

    def __init__(self, keys: list[Key]) -> None:
        self.texts = np.array([k[0] for k in keys], np.int64)
        parted = {k[0] for k in keys if k[1]}
        self.docs = {x: np.array([k[1] for k in keys if k[0] == x], np.int64) for x in parted}

    def place(self, text_key: np.ndarray, doc_key: np.ndarray) -> np.ndarray:
        """For each key the number of candidates that are not above it."""
        place = np.searchsorted(self.texts, text_key, side="right")
        for text, docs in self.docs.items():  # at most one for each splitter
            at = np.flatnonzero(text_key == text)
            place[at] += np.searchsorted(docs, doc_key[at], side="right") - len(docs)
        return place


def counted(keys: DataFrame, candidates: list[Key]) -> list[tuple[int, int, int, int, int, int]]:
    """Exact bytes, and the least and greatest keys, between each two neighbours of the candidates: at most one row more than these."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's histogram."""
        probes, n = Probes(candidates), len(candidates) + 1
        total, least, most = np.zeros(n, np.int64), np.full((2, n), TOP, np.int64), np.full((2, n), -1, np.int64)
        for batch in batches:
            text_key, doc_key, size = (batch[c].to_numpy(zero_copy_only=False) for c in ("text_key", "doc_key", "size"))
            place = probes.place(text_key, doc_key)
            np.add.at(total, place, size)
            for k, key in enumerate((text_key, doc_key)):
                np.minimum.at(least[k], place, key)
                np.maximum.at(most[k], place, key)
        have = np.flatnonzero(total)
        cells = [have.astype(np.int32), total[have], least[0][have], most[0][have], least[1][have], most[1][have]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=[c.split()[0] for c in COUNTS.split(", ")])

    found = keys.mapInArrow(local, COUNTS).groupBy("place")
    whole = found.agg(F.sum("bytes"), F.min("least_text"), F.max("most_text"), F.min("least_doc"), F.max("most_doc"))
    return sorted(tuple(r) for r in whole.collect())


def evenly(low: int, high: int, probes: int) -> list[int]:
    """low, high + 1 and up to `probes` numbers between them, evenly laid."""
    return sorted({low, high + 1} | {low + (high + 1 - low) * i // (probes + 1) for i in range(1, probes + 1)})


class Splitter:
    """The target of one splitter in bytes, and the range of keys, both ends included, that lies around it."""

    def __init__(self, target: float, slack: float, tolerance: float) -> None:
        self.target, self.slack, self.tolerance = target, slack, tolerance
        self.text: int | None = None  # the text that lies across the target, once its documents are parted
        self.low, self.high = 0, TOP - 1
        self.at: Key | None = None

    def range(self) -> tuple:
        return self.text, self.low, self.high

    def asks(self, probes: int) -> list[Key]:
        inner = evenly(self.low, self.high, probes)
        return [(x, 0) for x in inner] if self.text is None else [(self.text, x) for x in inner]

    def learns(self, own: list[tuple[int, Key]], below: list[int], cells: dict[int, tuple]) -> None:
        """own: this splitter's candidates with their places among all; below: the bytes under each of all; cells: what lies under each and not under the one before."""
        j = next(j for j, (i, _) in enumerate(own) if below[i] >= self.target)
        if j == 0:  # nothing is under the target: the table is empty
            self.at = (0, 0)
            return
        merged = [cells[i] for i in range(own[j - 1][0] + 1, own[j][0] + 1) if i in cells]
        least_text, most_text, least_doc, most_doc = (f(c[k] for c in merged) for f, k in ((min, 2), (max, 3), (min, 4), (max, 5)))
        first, after_last = ((least_text, 0), (most_text + 1, 0)) if self.text is None else ((self.text, least_doc), (self.text, most_doc + 1))
        miss, at = min((abs(below[i] - self.target), key) for i, key in ((own[j - 1][0], first), (own[j][0], after_last)))
        if miss <= self.tolerance:
            self.at = at
        elif self.text is not None:
            self.low, self.high = least_doc, most_doc
            self.at = at if least_doc == most_doc else None
        elif least_text < most_text:
            self.low, self.high = least_text, most_text
        elif miss <= self.slack or least_doc == most_doc:
            self.at = at
        else:
            self.text, self.low, self.high = least_text, least_doc, most_doc


def splitters(keys: DataFrame, shards: int, whole: float, tolerance: float, probes: int = PROBES) -> list[Key]:
    """shards - 1 keys; a shard begins with the first row that is not under its splitter."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    each = total / shards
    found = [Splitter(each * k, whole * each, tolerance * each) for k in range(1, shards)]
    while moving := [s for s in found if s.at is None]:
        sharing = Counter(s.range() for s in moving)
        asked = {r: s.asks(probes * sharing[r]) for s in moving if (r := s.range())}
        candidates = sorted({key for keys_ in asked.values() for key in keys_})
        place = {key: i for i, key in enumerate(candidates)}
        cells, below, upto = {r[0]: r for r in counted(keys, candidates)}, [], 0
        for i in range(len(candidates)):
            upto += cells[i][1] if i in cells else 0
            below.append(upto)
        for s in moving:
            s.learns([(place[key], key) for key in asked[s.range()]], below, cells)
    return sorted(s.at for s in found)


def shard_of(found: list[Key]) -> Column:
    """The number of splitters that are not above the row's key."""
    text, doc = F.col("text_key"), F.col("doc_key")
    not_under = lambda k: (text > k[0]) | ((text == k[0]) & (doc >= k[1])) if k[1] else text >= k[0]
    return sum((not_under(k).cast("int") for k in found), F.lit(0))


def shard(docs: DataFrame, shards: int = 40, whole: float = 0.01, tolerance: float = 0.0) -> DataFrame:
    """docs with size, shard (0 to shards - 1) and slot (from 0, gapless in each shard), exchanged so that a slice of a shard is one task.

    whole: a splitter may miss its target by this share of a shard to keep equal texts together. tolerance: it stops at a
    candidate that is this near; 0 refines until no boundary is nearer, and so gives splitters that depend on the rows alone.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    old = [F.col(f"`{c}`").alias(f"old_{i}") for i, c in enumerate(kept)]
    keyed = [hash_60(F.col("text")).alias("text_key"), hash_60(F.col("doc_id")).alias("doc_key"), size_of(F.col("text")).alias("size")]
    path = f"{shared_folder(spark)}/keys"
    docs.select(*keyed).write.parquet(path)
    keys = spark.read.parquet(path)
    found = splitters(keys, shards, whole, tolerance)

    sized = keys.withColumn("shard", shard_of(found))
    slices = sized.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / SLICE_BYTES)).cast("int").alias("slices")).collect()  # one row a shard
    count = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in slices for x in r]), F.col("shard")), F.lit(1)) if slices else F.lit(1)
    sliced = F.pmod(F.col("text_key") + F.col("doc_key"), count).cast("int").alias("slice")
    # rows of each slice, and of those before it in its shard: one row for each 16 MB of text
    ahead = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.select("shard", sliced).groupBy("shard", "slice").agg(F.count("*").alias("rows"))
    first = rows.select(F.col("shard").alias("in_shard"), F.col("slice").alias("in_slice"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    tasks = sum(r["slices"] for r in slices)
    first = F.broadcast(first) if tasks <= BROADCAST_ROWS else first

    whole_rows = docs.select(*old, *keyed).withColumn("shard", shard_of(found)).withColumn("slice", sliced)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)
    own = Window.partitionBy("shard", "slice").orderBy("text_key", "doc_key")
    placed = whole_rows.repartition(width, "shard", "slice").withColumn("in_order", F.row_number().over(own) - 1)
    # each slice is there; an inner join would hash every text again to test that its shard isn't null
    placed = placed.join(first, (F.col("shard") == F.col("in_shard")) & (F.col("slice") == F.col("in_slice")), "left")
    return placed.select(*[F.col(f"old_{i}").alias(c) for i, c in enumerate(kept)], "size", "shard", (F.col("ahead") + F.col("in_order")).cast("long").alias("slot"))
