"""Inverted lists against brute force, and what a search reads of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import vector_index
from docloom.operators.vector_index import VectorIndex

SCHEMA = "vec_id long, embedding array<float>, label int, `a.b` string"


def clustered(seed, n, centers=20, width=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, width))
    at = rng.integers(0, centers, n)
    at[: n // 3] = 0  # a third in one cluster
    return [(i, [float(x) for x in middle[c] + 0.05 * rng.normal(size=width)], int(c % 3), "y") for i, c in enumerate(at)]


def brute(rows, queries, k, keep=lambda r: True):
    rows = [r for r in rows if keep(r)]
    matrix = np.array([r[1] for r in rows], np.float32).astype(float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    out = set()
    for q, v in queries:
        v = np.array(v, np.float32).astype(float)
        sims = np.round(matrix @ (v / np.linalg.norm(v)), 9)
        order = sorted(range(len(rows)), key=lambda i: (-sims[i], rows[i][0]))[:k]
        out |= {(q, rows[i][0], rank) for rank, i in enumerate(order, 1)}
    return out


def answers(found):
    return {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()}


@pytest.fixture
def built(spark, tmp_path):
    rows = clustered(1, 1500)
    bad = [(9001, None, 0, "y"), (9002, [0.0] * 16, 0, "y"), (9003, [float("nan")] + [1.0] * 15, 0, "y"), (9004, [None] + [1.0] * 15, 0, "y")]
    index = VectorIndex.build(spark.createDataFrame(rows + bad, SCHEMA), f"{tmp_path}/index", lists=20, owner=["label"])
    queries = [(r[0], r[1]) for r in rows if r[0] % 20 == 0]
    return rows, index, queries, spark.createDataFrame(queries, "query_id long, query array<float>")


def test_exact_search_is_brute_force(built):
    rows, index, queries, asked = built
    assert answers(index.search(asked, 10, probes=1, exact=True)) == brute(rows, queries, 10)
    mine = index.search(asked, 10, probes=2, where=F.col("label") == 2, exact=True)
    assert answers(mine) == brute(rows, queries, 10, lambda r: r[2] == 2) and mine.columns == ["query_id", "vec_id", "embedding", "label", "a.b", "similarity", "rank"]
    assert index.lists.count() == 1500  # vectors without a direction aren't there


def test_recall_of_few_probes(built):
    rows, index, queries, asked = built
    found, want = answers(index.search(asked, 10, probes=3)), brute(rows, queries, 10)
    share = len({x[:2] for x in found} & {x[:2] for x in want}) / len(want)
    assert share >= 0.9


def scans(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    if hasattr(plan, "plan") and "QueryStage" in plan.getClass().getSimpleName():
        plan = plan.plan()
    if "FileSourceScan" in plan.getClass().getSimpleName():
        yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from scans(children.apply(i))


def files_read(frame):
    frame.collect()
    return sum(s.metrics().apply("numFiles").value() for s in scans(frame._jdf.queryExecution().executedPlan()))


def test_only_probed_lists_are_read(spark, built):
    rows, index, queries, asked = built
    whole = files_read(index.lists.select("vec_id"))
    one = asked.filter("query_id = 0").withColumn("query", vector_index.unit(F.col("query"))).withColumn("reach", F.lit(-1.0))
    found = index.probed(index.probes(one, 2), F.col("label") == 1).select("vec_id")
    assert files_read(found) <= whole / 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "EqualTo(label,1)" in plan


def test_equal_vectors_meet_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 100)
    rows = [(i, [1.0, 2.0, 3.0], 0, "y") for i in range(3000)] + [(5000 + i, [3.0, float(i), -1.0], 0, "y") for i in range(50)]
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/index", lists=5)
    parts = index.lists.groupBy("list", "part").count().collect()
    assert max(r["count"] for r in parts) <= 200 and len(parts) >= 30
    asked = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, None)], "query_id long, query array<float>")
    assert answers(index.search(asked, 5, probes=1)) == {(1, i, i + 1) for i in range(5)}


def test_added_vectors_are_found(built, spark):
    rows, index, queries, asked = built
    more = [(20_000 + i, v, label, "y") for i, v, label, _ in clustered(2, 300)]
    wider = index.add(spark.createDataFrame(more, SCHEMA))
    assert wider.lists.count() == 1800 and (wider.radii >= index.radii).all()
    assert answers(wider.search(asked, 10, probes=2, exact=True)) == brute(rows + more, queries, 10)


def test_blocks_of_queries(built, monkeypatch):
    rows, index, queries, asked = built
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 20)
    assert answers(index.search(asked, 10, probes=1, exact=True)) == brute(rows, queries, 10)


def test_nothing_to_index(spark, tmp_path):
    index = VectorIndex.build(spark.createDataFrame([(1, None, 0, "y")], SCHEMA), f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query array<float>")
    assert index.search(asked, 3).collect() == [] and index.search(asked, 3, exact=True).collect() == []


def test_a_query_goes_once_to_each_cell(built):
    rows, index, queries, asked = built
    ready = asked.select("query_id", vector_index.unit(F.col("query")).alias("query"), F.lit(-1.0).alias("reach"))
    dealt = index.dealt(ready, 12, 3).collect()
    assert len(dealt) <= 3 * len(queries) and len({(r["query_id"], r["cell"]) for r in dealt}) == len(dealt)
    pairs = {(r["query_id"], r["list"]) for r in index.probes(ready, 12).collect()}
    assert {(r["query_id"], x) for r in dealt for x in r["lists"]} == pairs and len(pairs) == 12 * len(queries)


def test_only_wanted_columns_are_found(built):
    rows, index, queries, asked = built
    found = index.search(asked, 10, probes=1, exact=True, columns=["label"])
    assert found.columns == ["query_id", "vec_id", "label", "similarity", "rank"] and answers(found) == brute(rows, queries, 10)


def test_a_length_is_computed_once_for_a_vector(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, None],), ([1.0, float("inf")],)], "v array<double>").select(vector_index.unit(F.col("v")).alias("u"))
    assert [r.u for r in rows.collect()] == [[0.6, 0.8], None, None, None, None]
    assert "/ SQRT" not in rows._jdf.queryExecution().analyzed().toString()
