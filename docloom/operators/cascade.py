"""Deletes that go on to what depends on the deleted rows, over any number of levels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Link(NamedTuple):
    """Rows of `child` whose `column` holds the key of a row of `parent` go with it."""

    child: str
    column: str
    parent: str


def doomed(tables: dict[str, DataFrame], keys: dict[str, str], links: list[Link], first: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """The keys (`key`) of all rows that go with those whose keys are in `first`, by table.

    Each round joins the newest keys of every parent with its children and writes the children's keys that are new to the
    folder, which all executors reach; it ends with a round without any. So links may form trees of any depth and rings. The
    number of rounds is the depth; what is read again in a round is children's keys and columns of links, never whole rows.
    """
    spark = next(iter(tables.values())).sparkSession
    found: dict[str, DataFrame] = {}
    newest: dict[str, DataFrame] = {}
    for name, frame in first.items():
        path = f"{folder}/round=0/{name}"
        frame.select(F.col(f"`{frame.columns[0]}`").alias("key")).filter("key IS NOT NULL").distinct().write.parquet(path)
        found[name] = newest[name] = spark.read.parquet(path)
    turn = 0
    while newest:
        turn, reached = turn + 1, {}
        for link in links:
            if link.parent in newest:
                child = tables[link.child].select(F.col(f"`{keys[link.child]}`").alias("key"), F.col(f"`{link.column}`").alias("up"))
                hit = child.join(newest[link.parent].select(F.col("key").alias("up")), "up", "left_semi").select("key").filter("key IS NOT NULL")
                reached[link.child] = reached[link.child].unionByName(hit) if link.child in reached else hit
        newest = {}
        for name, hit in reached.items():
            fresh = hit.distinct()
            fresh = fresh.join(found[name], "key", "left_anti") if name in found else fresh
            path = f"{folder}/round={turn}/{name}"
            fresh.write.parquet(path)
            fresh = spark.read.parquet(path)
            if not fresh.isEmpty():
                newest[name] = fresh
                found[name] = found[name].unionByName(fresh) if name in found else fresh
    return found


def cascaded(tables: dict[str, DataFrame], keys: dict[str, str], links: list[Link], first: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Each table without the rows of `first` and all that depends on them; rows without a key or a parent stay."""
    gone = doomed(tables, keys, links, first, folder)
    return {name: rows.join(gone[name].withColumnRenamed("key", keys[name]), keys[name], "left_anti").select(rows.columns) if name in gone else rows for name, rows in tables.items()}
