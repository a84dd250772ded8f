"""A scan of a keyed store page by page (S23, S24): `spark.read.format("paged")`, one partition for each key range.

The store is behind a client with two methods, so that anything that answers by key range can be scanned: `ranges()` lists
(low, high, owners) on the driver, and `page(low, high, owner, after, limit)` gives a task the next records after a key.
Bounds of the key and the owners may be given, or taken from the filters that Spark pushes down: ranges that can't meet them
are no partitions, and the client is asked for one owner's records only. A task holds one page.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from typing import NamedTuple, Protocol
from urllib.parse import urlparse

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Range(NamedTuple):
    """Keys from low to high, both included; owners is None where they aren't known."""

    low: int
    high: int
    owners: tuple[str, ...] | None = None


class Store(Protocol):
    def ranges(self) -> list[Range]: ...

    def page(self, low: int, high: int, owner: str | None, after: int | None, limit: int) -> list[dict]:
        """The first `limit` records with low <= key <= high, and over `after` if given, by rising key; no key twice."""


class KeyRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, scan: dict, schema: StructType) -> None:
        self.store, self.key, self.owner, self.limit = (scan[k] for k in ("store", "key", "owner", "limit"))
        self.low, self.high, self.owners, self.schema = scan["low"], scan["high"], scan["owners"], schema

    def partitions(self) -> list[KeyRange]:
        out = []
        for r in self.store.ranges():
            low, high = max(r.low, self.low if self.low is not None else r.low), min(r.high, self.high if self.high is not None else r.high)
            if low <= high and (self.owners is None or r.owners is None or set(self.owners) & set(r.owners)):
                out.append(KeyRange(low, high))
        return out or [KeyRange(1, 0)]  # an empty range: no partition at all isn't allowed

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        one = self.owners[0] if self.owners is not None and len(self.owners) == 1 else None
        names, after = [f.name for f in self.schema], None
        while partition.low <= partition.high:
            records = self.store.page(partition.low, partition.high, one, after, self.limit)
            for r in records:
                yield tuple(r.get(n) for n in names)
            if len(records) < self.limit:
                return
            after = records[-1][self.key]


class PushedReader(Reader):
    """A reader that also takes bounds from filters (Spark refuses one that could, where the setting is off)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes bounds of the key and the owner; Spark applies the rest, and also an `In`, of which only ranges are pruned."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == self.key and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                lows = {EqualTo: f.value, GreaterThan: f.value + 1, GreaterThanOrEqual: f.value}
                highs = {EqualTo: f.value, LessThan: f.value - 1, LessThanOrEqual: f.value}
                self.low = max(x for x in (self.low, lows.get(type(f))) if x is not None) if (self.low, lows.get(type(f))) != (None, None) else None
                self.high = min(x for x in (self.high, highs.get(type(f))) if x is not None) if (self.high, highs.get(type(f))) != (None, None) else None
            elif name == self.owner and isinstance(f, EqualTo) and (self.owners is None or self.owners == (f.value,)):
                self.owners = (f.value,)
            else:
                if name == self.owner and isinstance(f, In) and self.owners is None:
                    self.owners = tuple(f.value)
                yield f


class Paged(DataSource):
    """The option `scan` has what scan() was called with, as text."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> Reader:
        about = cloudpickle.loads(bytes.fromhex(self.options["scan"]))  # made by scan(), in this session
        return (PushedReader if about["pushdown"] else Reader)(about, schema)


def scan(spark: SparkSession, store: Store, schema: str, key: str = "id", owner: str = "user_id", limit: int = 5000, low: int | None = None, high: int | None = None, owners: tuple[str, ...] | None = None, pushdown: bool = False) -> DataFrame:
    """The records of a store as a frame: those with low <= key <= high, and of the given owners.

    pushdown: bounds are also taken from the frame's filters. Spark keeps what it pushes down with the source, so filter such
    a frame in one place only, and scan anew for another filter.
    """
    spark.dataSource.register(Paged)
    if pushdown:
        spark.conf.set(PUSHDOWN, "true")
    about = {"store": store, "key": key, "owner": owner, "limit": limit, "low": low, "high": high, "owners": owners, "pushdown": pushdown}
    found = spark.read.format("paged").schema(schema).option("scan", cloudpickle.dumps(about).hex()).load()
    return found.filter(F.col(owner).isin(*owners)) if owners is not None and len(owners) > 1 else found


class FolderStore:
    """Records as JSON lines in folders of a key range each, on a file system that every node has mounted.

    write() lets Spark make it: folder `range=k` holds the keys from k * width on, `owners` the owners of each range.
    """

    def __init__(self, path: str, key: str, owner: str, width: int) -> None:
        self.path, self.key, self.owner, self.width = path, key, owner, width

    @classmethod
    def write(cls, rows: DataFrame, path: str, key: str = "id", owner: str = "user_id", width: int = 10_000) -> FolderStore:
        at = F.floor(F.col(key) / width).cast("long")
        ranged = rows.withColumn("range", at)
        ranged.repartition("range").sortWithinPartitions("range", key).write.partitionBy("range").option("ignoreNullFields", "false").json(f"{path}/records")
        owners = ranged.groupBy("range").agg(F.collect_set(F.col(owner).cast("string")).alias("owners"))
        owners.coalesce(1).write.json(f"{path}/owners")  # one row a range
        return cls(urlparse(path).path or path, key, owner, width)

    def ranges(self) -> list[Range]:
        found = []
        for name in glob.glob(f"{self.path}/owners/part-*"):
            with open(name, encoding="utf-8") as lines:
                found += [json.loads(x) for x in lines]
        return [Range(r["range"] * self.width, (r["range"] + 1) * self.width - 1, tuple(r["owners"])) for r in sorted(found, key=lambda r: r["range"])]

    def page(self, low: int, high: int, owner: str | None, after: int | None, limit: int) -> list[dict]:
        out = []
        for k in range(low // self.width, high // self.width + 1):
            for name in sorted(glob.glob(f"{self.path}/records/range={k}/part-*"), key=os.path.basename):
                with open(name, encoding="utf-8") as lines:
                    for line in lines:
                        r = json.loads(line)
                        key = r[self.key]
                        if low <= key <= high and (after is None or key > after) and (owner is None or str(r.get(self.owner)) == owner):
                            out.append(r)
                            if len(out) == limit:
                                return out
        return out
