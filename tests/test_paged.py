"""The paged scan: what it reads, and what it doesn't ask for."""

import pytest
from pyspark.sql import functions as F

from docloom.sources import paged
from docloom.sources.paged import FolderStore, Range

SCHEMA = "id long, user_id string, text string"


@pytest.fixture
def store(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i // 30}" if i % 7 else None, f"t{i}" if i % 5 else None) for i in range(0, 1000, 2)], SCHEMA)
    return FolderStore.write(rows, f"{tmp_path}/store", width=100), rows


def watched(store, folder):
    """The store, writing down what it is asked."""

    class Watched:
        def ranges(self):
            return store.ranges()

        def page(self, *asked):
            import uuid
            from pathlib import Path

            Path(folder).mkdir(exist_ok=True)
            Path(folder, uuid.uuid4().hex).write_text(repr(asked))
            return store.page(*asked)

    return Watched()


def asked(folder):
    return [eval(p.read_text()) for p in folder.iterdir()] if folder.exists() else []


def test_all_rows_in_pages(spark, store, tmp_path):
    folder, rows = store
    found = paged.scan(spark, watched(folder, f"{tmp_path}/asked"), SCHEMA, limit=7)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, rows.collect()))
    pages = asked(tmp_path / "asked")
    assert len({p[:2] for p in pages}) == 10 and len(pages) == 10 * 8 and all(p[4] == 7 for p in pages)


def test_filters_prune_ranges(spark, store, tmp_path):
    folder, rows = store
    for k, (where, ranges) in enumerate(
        [("id >= 250 AND id < 400", 2), ("id = 512", 1), ("id > 990 AND id < 5", 0), ("user_id = 'u5'", 1), ("user_id IN ('u0', 'u32')", 2), ("user_id = 'u5' AND id > 165", 1), ("text = 't12'", 10), ("user_id IS NULL", 10), ("id + 1 = 13", 10)]
    ):
        found = paged.scan(spark, watched(folder, f"{tmp_path}/asked{k}"), SCHEMA, pushdown=True).filter(where)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, rows.filter(where).collect())), where
        pages = asked(tmp_path / f"asked{k}")
        assert len({p[:2] for p in pages}) == ranges, (where, pages)
    assert {p[2] for p in asked(tmp_path / "asked3")} == {"u5"}


def test_ranges_are_partitions(spark, store):
    folder, _ = store
    assert folder.ranges()[3] == Range(300, 399, tuple(folder.ranges()[3].owners)) and len(folder.ranges()) == 10
    assert paged.scan(spark, folder, SCHEMA).select(F.spark_partition_id()).distinct().count() == 10


def test_bounds_without_pushdown(spark, store, tmp_path):
    folder, rows = store
    found = paged.scan(spark, watched(folder, f"{tmp_path}/asked"), SCHEMA, low=150, high=420, owners=("u5", "u9"))
    both = found.filter("user_id = 'u5'").unionByName(found)  # one frame, two filters
    want = rows.filter("id BETWEEN 150 AND 420 AND user_id IN ('u5', 'u9')")
    assert sorted(map(repr, both.collect())) == sorted(map(repr, want.filter("user_id = 'u5'").unionByName(want).collect()))
    assert {p[:2] for p in asked(tmp_path / "asked")} <= {(150, 199), (200, 299)}


def test_preview_of_a_parquet_table(spark, tmp_path):
    from docloom.sources.readers import parquet_preview

    spark.range(100).selectExpr("id", "cast(id AS string) AS `a.b`").coalesce(1).write.parquet(f"{tmp_path}/t")
    got = sorted(map(tuple, parquet_preview(spark, f"{tmp_path}/t", 3).collect()))
    assert got == [("a.b", "string", 1, ["0", "1", "2"]), ("id", "bigint", 0, ["0", "1", "2"])]
    spark.range(0).write.parquet(f"{tmp_path}/e")
    assert [tuple(r) for r in parquet_preview(spark, f"{tmp_path}/e").collect()] == [("id", "bigint", 0, [])]


def test_preview_begins_with_the_first_file_not_the_largest(spark, tmp_path):
    from docloom.sources.readers import parquet_preview

    spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/p/k=1")
    spark.range(10, 5000).coalesce(1).write.parquet(f"{tmp_path}/p/k=2")
    got = {r["column"]: r["samples"] for r in parquet_preview(spark, f"{tmp_path}/p", 4).collect()}
    assert got == {"id": ["0", "1", "10", "11"], "k": ["1", "1", "2", "2"]}
