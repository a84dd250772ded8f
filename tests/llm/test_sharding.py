import hashlib
import random

import pytest

from docloom.llm import sharding
from docloom.llm.sharding import shard

SCHEMA = "doc_id long, text string, size string, `a.b` string"


def key(value):
    return int(hashlib.md5(("" if value is None else str(value)).encode()).hexdigest()[:15], 16)


def rows(seed, n):
    """A third of the rows share one text; nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    out = [(None, None, "x", "y"), (None, "é" * 50, "x", "y"), (10_000, "", "x", "y"), (10_001, "w " * 4000, "x", "y")]
    for i in range(n):
        out.append((i, "the hot text of a third of all rows" if i % 3 == 0 else "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 300))), "x", "y"))
    return [*out, out[-1], out[-1]]


def brute(data, shards, whole):
    """(shard of each key): every splitter at the nearest boundary of texts, or of documents where that is too far."""
    size = lambda x: len((x or "").encode()) + 16
    classes = {}
    for doc_id, text, *_ in data:
        classes[key(text), key(doc_id)] = classes.get((key(text), key(doc_id)), 0) + size(text)
    order = sorted(classes)
    under, upto = {}, 0
    for k in order:
        under[k], upto = upto, upto + classes[k]
    after = {k: under[k] + classes[k] for k in order}
    docs = {0, *after.values()}
    texts = {0, *{k[0]: after[k] for k in order}.values()}
    cuts = []
    for i in range(1, shards):
        target = upto / shards * i
        cut = min(texts, key=lambda b: (abs(b - target), b))
        cuts.append(cut if abs(cut - target) <= whole * (upto / shards) else min(docs, key=lambda b: (abs(b - target), b)))
    return {k: sum(c <= under[k] for c in cuts) for k in order}


@pytest.mark.parametrize("probes", [2, 64])
def test_shards_are_those_of_the_nearest_boundaries(spark, monkeypatch, probes):
    monkeypatch.setattr(sharding, "SLICE_BYTES", 2000)
    monkeypatch.setattr(sharding.splitters, "__defaults__", (probes,))
    data = rows(probes, 600)
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = shard(docs, 12).collect()
    assert len(got) == len(data) and got[0]["a.b"] == "y" and {type(r["size"]) for r in got} == {int}
    want = brute(data, 12, 0.01)
    assert all(r["shard"] == want[key(r["text"]), key(r["doc_id"])] for r in got)
    for s in range(12):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    total = [sum(r["size"] for r in got if r["shard"] == s) for s in range(12)]
    assert max(total) - min(total) <= 2 * 8016
    again = shard(docs.repartition(2), 12).collect()
    cell = lambda r: (str(r["doc_id"]), str(r["text"]), r["size"], r["shard"], r["slot"])
    assert sorted(map(cell, got)) == sorted(map(cell, again))


def test_tolerance_stops_earlier(spark, monkeypatch):
    data = [(i, f"text {i} " * 5, "x", "y") for i in range(3000)]
    docs = spark.createDataFrame(data, SCHEMA)
    rounds = []
    counted = sharding.counted
    monkeypatch.setattr(sharding, "counted", lambda *a: rounds.append(len(a[1])) or counted(*a))
    got = shard(docs, 10, tolerance=0.05).collect()
    loose = len(rounds)
    shard(docs, 10).count()
    assert loose < len(rounds) - loose
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(10)]
    assert max(sizes) / min(sizes) < 1.25


def test_copies_stay_together_where_shards_allow(spark):
    data = [(i, f"text {i // 3}", "x", "y") for i in range(3000)]
    got = shard(spark.createDataFrame(data, SCHEMA), 10).collect()
    homes = {}
    for r in got:
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(x) > 1 for x in homes.values()) == 0


def test_few_rows_and_none(spark):
    assert shard(spark.createDataFrame([], SCHEMA), 5).collect() == []
    got = shard(spark.createDataFrame([(1, "a", "x", "y"), (1, "a", "x", "y"), (None, None, None, None)], SCHEMA), 5).collect()
    assert len(got) == 3 and all(0 <= r["shard"] < 5 and r["size"] in (16, 17) for r in got)
