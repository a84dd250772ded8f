"""How vectors and queries meet: no group grows with equal vectors, and no vector is sent once for each block of queries."""

import numpy as np

import docloom.llm.vector_search as vs
from docloom.llm.vector_search import nearest


def test_equal_vectors_and_many_queries(spark, monkeypatch):
    monkeypatch.setattr(vs, "SHARD_ROWS", 500)
    monkeypatch.setattr(vs, "QUERY_ROWS", 50)
    rows = spark.range(8000).selectExpr("id AS vec_id", "CASE WHEN id < 6000 THEN array(1d, 2d, 3d) ELSE array(cast(id AS double), 1d, id % 7 / 1d) END AS embedding")
    got = {}
    for r in nearest(rows, rows.filter("vec_id % 400 = 0"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    points = {r["vec_id"]: np.array(r["embedding"]) for r in rows.collect()}
    for q in range(0, 8000, 400):
        want = sorted((float(np.sqrt(((points[q] - v) ** 2).sum())), i) for i, v in points.items() if i != q)[:5]
        assert [(a, b) for a, b, _ in sorted(got[q])] == [(n, i) for n, (_, i) in enumerate(want, 1)]


def test_parts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(vs, "SHARD_ROWS", 500)
    seen = vs.runs
    rows = spark.range(40_000).selectExpr("id AS vec_id", "array(1d, 2d) AS embedding")

    def measured(batches):
        import pyarrow as pa

        total = {}
        for key, asks, some in seen(batches):
            total[key, asks] = total.get((key, asks), 0) + some.num_rows
        n = [x for (_, asks), x in total.items() if not asks]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(n, pa.int64()), pa.array([0.0] * len(n))], names=["query_id", "vec_id", "score"])

    monkeypatch.setattr(vs, "answered", lambda batches, k, factor: measured(batches))
    found = nearest(rows, rows.filter("vec_id % 100 = 0")).collect()
    sizes = [r["query_id"] for r in found]
    assert sizes and max(sizes) <= 2 * 500


def test_turns_of_very_many_queries(spark, monkeypatch):
    rows = spark.range(600).selectExpr("id AS vec_id", "array(cast(id * 37 % 101 AS double), cast(id % 13 AS double)) AS embedding")
    asked = rows.filter("vec_id % 3 = 0")
    plain = sorted(map(tuple, nearest(rows, asked).collect()))
    monkeypatch.setattr(vs, "TURN_ROWS", 20)
    monkeypatch.setattr(vs, "SHARD_ROWS", 100)
    assert sorted(map(tuple, nearest(rows, asked).collect())) == plain
