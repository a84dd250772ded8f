"""Tables changed by key, and the streams that keep state."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import jobs
from docloom.sources import sinks
from docloom.sources.keyed import BUCKET, KeyedTable, newest
from docloom.streaming import limits, reorder, rollup

SCHEMA = "id long, name string, at long, `a.b` string"


def files(table):
    return {str(p): p.read_bytes() for p in Path(table.path, "rows").rglob("*.parquet")}


def contents(table):
    return sorted(map(repr, (tuple(r) for r in table.rows.collect())))


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, f"n{i}", 0, "x") for i in range(500)] + [(None, "nobody", 0, None), (7, "again", 1, "x")]
    return KeyedTable.create(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/t", buckets=16, order=[F.desc("at")])


def test_create_keeps_one_row_of_a_key(table):
    assert table.rows.count() == 501 and table.rows.filter("id = 7").first()["name"] == "again"
    assert table.rows.columns == ["id", "name", "at", "a.b"] and len(files(table)) == 16


def test_upsert_rewrites_only_what_changes(spark, table):
    before = files(table)
    new = spark.createDataFrame([(3, "three", 5, "x"), (3, "older", 4, "x"), (9000, "new", 5, None), (4, "n4", 0, "x"), (None, "still nobody", 1, None)], SCHEMA)
    assert table.upsert(new, order=[F.desc("at")]) <= 3  # row 4 is as it was
    after = files(table)
    same = {p for p in before if before[p] == after.get(p)}
    assert len(same) >= 13 and len({Path(p).parent for p in set(after) - same}) <= 3
    got = {r["id"]: r["name"] for r in table.rows.collect()}
    assert got[3] == "three" and got[9000] == "new" and got[None] == "still nobody" and len(got) == 502
    assert table.upsert(new, order=[F.desc("at")]) == 0 and files(table) == after  # once more: nothing
    assert table.upsert(spark.createDataFrame([], SCHEMA)) == 0


def test_scan_reads_touched_buckets_only(table):
    plan = table._stored([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [{BUCKET}" in plan and "IN (3,5)" in plan


def test_delete_and_update(spark, table):
    before = files(table)
    assert table.delete(F.col("id") == 11) == 1 and table.delete(F.col("id") == 11) == 0
    assert len({p for p in before if before[p] == files(table).get(p)}) == 15
    assert table.update(F.col("id").isin(20, 21), {"name": F.lit("set")}) <= 2
    assert {r["name"] for r in table.rows.filter("id IN (20, 21)").collect()} == {"set"}
    table.delete(F.lit(True))  # buckets that lose all rows
    assert table.rows.count() == 0
    assert table.upsert(spark.createDataFrame([(1, "one", 0, "x")], SCHEMA)) == 1 and table.rows.count() == 1


def test_claims_as_changes(spark, tmp_path):
    rows = [(i, "a" if i % 2 else "b", "pending", 100 - i, 0) for i in range(40)]
    queue = KeyedTable.create(spark.createDataFrame(rows, "id long, job_type string, status string, created_at long, updated_at long"), f"{tmp_path}/q", buckets=8)
    for _ in range(2):
        picked = jobs.oldest_pending(queue.rows).withColumns({"status": F.lit("processing"), "updated_at": F.lit(7).cast("long")})
        assert queue.upsert(picked) <= 2
    assert {r["id"] for r in queue.rows.filter("status = 'processing'").collect()} == {39, 38, 37, 36}


def test_ties_have_one_answer(spark):
    rows = [(1, "a", 5, "x"), (1, "b", 5, "x"), (1, "c", 4, "x")]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, SCHEMA).coalesce(1)
        assert jobs.latest(frame, "id", "at", "name").first()["name"] == "a"
        assert sinks.upserted(frame.limit(0), frame, "id", [F.desc("at"), F.desc("name")]).collect()[0]["name"] == "b"
    assert newest(spark.createDataFrame(rows, SCHEMA), "id").collect() == newest(spark.createDataFrame(rows[::-1], SCHEMA), "id").collect()


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def fed(spark, folder, batches, schema):
    """A stream with one file for each batch."""
    Path(folder).mkdir()
    for i, rows in enumerate(batches):
        path = Path(folder, f"{i:03}.json")
        path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def played(frame, folder, name):
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name).collect(), query


def test_rollup_adds_each_batch_once(spark, tmp_path):
    batches = [[{"user": i % 3 if i % 4 else None, "n": i} for i in range(k, k + 10)] for k in (0, 10, 20, 30)]
    stream = fed(spark, f"{tmp_path}/in", batches, "user long, n long")
    by, sums = {"user": F.col("user")}, {"n": F.col("n"), "requests": F.lit(1)}
    table = rollup.rollup_table(stream, f"{tmp_path}/sums", by, sums, buckets=4)
    rollup.add_stream(stream, table, by, sums, f"{tmp_path}/state").awaitTermination()
    want = {}
    for r in sum(batches, []):
        n, c = want.get(r["user"], (0, 0))
        want[r["user"]] = n + r["n"], c + 1
    read = lambda: {r["user"]: (r["n"], r["requests"]) for r in table.rows.collect()}
    assert read() == want
    add, before = rollup.batch_adder(table, by, sums), files(table)
    add(spark.createDataFrame([(r["user"], r["n"]) for r in batches[3]], "user long, n long"), 3)  # replayed
    assert read() == want and files(table) == before
    # only some buckets were replaced before a crash: the replay adds to the others
    some = table.rows.filter("user = 1").withColumns({"n": F.col("n") - 100, "last_batch": F.lit(2).cast("long")})
    table.upsert(some)
    add(spark.createDataFrame([(1, 100), (2, 100)], "user long, n long"), 3)
    assert read()[2] == want[2] and read()[1][0] == want[1][0]


def test_reorder_releases_in_order(spark, tmp_path, state_store):
    at = lambda s: f"2024-01-01T00:{s // 60:02}:{s % 60:02}Z"
    row = lambda session, i, s: {"session_id": session, "index": i, "at": at(s), "text": f"t{i}"}
    batches = [
        [row("a", 2, 1), row("a", 0, 1), row("b", 1, 1)],
        [row("a", 1, 5), row("a", 1, 5), row("a", 4, 5), {"session_id": None, "index": 1, "at": at(5)}],
        [row("c", 0, 120)],
        [row("c", 1, 121)],  # time has gone on: b's 0 and a's 3 are given up
        [row("a", 3, 121), row("a", 5, 122), row("b", 2, 122)],
    ]
    stream = fed(spark, f"{tmp_path}/in", batches, "session_id string, index long, at timestamp, text string")
    got, _ = played(reorder.in_order(stream, patience=30), tmp_path, "ordered")
    by = lambda s: [(r["index"], r["place"], r["after_gap"], r["row"]["text"]) for r in got if r["session_id"] == s]
    assert by("a") == [(0, 0, False, "t0"), (1, 1, False, "t1"), (2, 2, False, "t2"), (4, 3, True, "t4"), (5, 4, False, "t5")]
    assert by("b") == [(1, 0, True, "t1"), (2, 1, False, "t2")] and by("c") == [(0, 0, False, "t0"), (1, 1, False, "t1")]


def test_any_arrival_gives_one_order(spark, tmp_path, state_store):
    import random

    for seed in (1, 2):
        rng = random.Random(seed)
        rows = [{"session_id": s, "index": i, "at": "2024-01-01T00:00:00Z", "text": ""} for s in "xyz" for i in range(25)]
        rng.shuffle(rows)
        stream = fed(spark, f"{tmp_path}/in{seed}", [rows[i::5] for i in range(5)], "session_id string, index long, at timestamp, text string")
        got, query = played(reorder.in_order(stream), tmp_path, f"order{seed}")
        assert all([r["index"] for r in got if r["session_id"] == s] == list(range(25)) for s in "xyz")
        assert all(r["index"] == r["place"] and not r["after_gap"] for r in got)


def test_limiter_forgets_quiet_keys(spark, tmp_path, state_store):
    import random

    rng = random.Random(4)
    times = sorted(rng.randrange(0, 400) for _ in range(300))
    rows = [{"key": f"u{i % 3}", "kind": rng.choice(["chat", "generation"]), "request_id": i, "ts": f"2024-01-01T00:{s // 60:02}:{s % 60:02}Z"} for i, s in enumerate(times)]
    clock = {"key": "clock", "kind": "auth", "request_id": 1000, "ts": "2024-01-01T05:00:00Z"}
    schema = "key string, kind string, request_id long, ts timestamp"
    stream = fed(spark, f"{tmp_path}/in", [rows[:100], rows[100:200], rows[200:], [clock], [clock | {"ts": "2024-01-01T09:00:00Z", "request_id": 1001}]], schema)
    got, query = played(limits.limited_stream(stream), tmp_path, "limited")
    batch = limits.limited(spark.createDataFrame([(r["key"], r["kind"], r["request_id"], r["ts"]) for r in [*rows, clock]], "key string, kind string, request_id long, ts string").withColumn("ts", F.to_timestamp("ts")))
    cells = lambda rows: sorted((r["request_id"], r["allowed"], r["remaining"], r["retry_after"]) for r in rows if r["request_id"] < 1000)
    assert cells(got) == cells(batch.collect())
    # six keys were known; after the quiet hours only the clock's newest request is
    progress = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) >= 7
    assert spark.read.format("statestore").option("stateVarName", "log").load(f"{tmp_path}/limited").count() <= 1


def test_quartiles_of_heavy_tails(spark):
    import numpy as np

    from docloom.operators import profile

    rng = np.random.default_rng(1)
    columns = {
        "tail": [*rng.normal(size=3000), 1e300, -1e200],
        "infinite": [*rng.normal(size=3000), float("inf"), float("-inf")],
        "cluster": [*(1e6 + rng.normal(size=3000) / 1000), 1e12, 0.0],
        "same": [7.0] * 3002,
        "two": [0.0, 1.0] * 1501,
    }
    rows = spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns))
    got = {(r["column"], r["stat"]): float(r["value"]) for r in profile.describe(rows).filter("stat LIKE '%\\%'").collect()}
    for c, values in columns.items():
        for q in (25, 50, 75):
            assert got[c, f"{q}%"] == pytest.approx(float(np.quantile(values, q / 100)), rel=1e-12), (c, q)


def test_one_keys_runs_are_dealt(spark):
    from docloom.streaming.limits import limited

    rows = [("only", "chat", i, 100_000 * (i // 5) + i) for i in range(500)]
    frame = spark.createDataFrame(rows, "key string, kind string, request_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = limited(frame)
        parts = found.select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1 and found.filter("NOT allowed").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_key_of_the_limiter_makes_few_calls_to_its_state():
    """One value, and one timer that goes on as long as requests come."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    value, timers = [None], []
    state = SimpleNamespace(get=lambda: value[0], update=lambda x: value.__setitem__(0, x), clear=lambda: value.__setitem__(0, None))
    limiter = limits.Limiter()
    limiter.init(SimpleNamespace(getValueState=lambda name, kind: state, registerTimer=timers.append))
    for at in (5_000_000, 50_000_000):
        said = list(limiter.handleInputRows(("a", "auth"), iter([Row(at=at + 1, request_id=2), Row(at=at, request_id=1)]), None))
        assert [r["request_id"] for r in said] == [1, 2]
    assert timers == [65_001]
    list(limiter.handleExpiredTimer(("a", "auth"), None, SimpleNamespace(getExpiryTimeInMs=lambda: 65_001)))
    assert timers == [65_001, 110_001] and value[0] is not None
    list(limiter.handleExpiredTimer(("a", "auth"), None, SimpleNamespace(getExpiryTimeInMs=lambda: 110_001)))
    assert len(timers) == 2 and value[0] is None
