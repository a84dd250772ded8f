import random
import re

import pytest

from docloom.llm.mixing import MOST, SCHEDULES, WEIGHTS, in_training_order, mix

SCHEMA = "doc_id long, text string, lang string, source string, size string, slice int"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= MOST * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = MOST * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def rows(seed, n):
    rng = random.Random(seed)
    out = [(1000, None, None, "a", "x", 1), (1001, " ", None, "zero", "x", 1), (1002, "one two", None, None, "x", 1), (None, "a b c", None, "b", "x", 1)]
    for i in range(n):
        source = "a" if rng.random() < 0.4 else rng.choice("bcdefgé")
        out.append((i, " ".join("w" for _ in range(rng.randrange(1, 90))), "en", source, "x", 1))
    return [*out, out[-1]]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_order(spark, seed):
    data = rows(seed, 300)
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = mix(docs).collect()
    assert len(got) == len(data) and {"lang", "slice"} <= set(got[0].asDict())
    sizes = {}
    for _, text, _, source, *_ in data:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^ \t-\r]+", text or ""))
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= MOST * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], r["position"] or -1)
    assert sorted(map(key, got)) == sorted(map(key, mix(docs.repartition(2)).collect()))
    order = [r["position"] for r in in_training_order(mix(docs)).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1


def test_positions_invert_the_schedule(spark):
    data = [(i, "w " * 10, "en", s, "x", 1) for i in range(600) for s in "abc"]
    got = mix(spark.createDataFrame(data, SCHEMA)).collect()
    for rank, s in enumerate("abc"):
        mine, knots = [r for r in got if r["source"] == s and r["taken"]], SCHEDULES[rank]
        first = [r for r in mine if r["position"] <= 0.5]
        half = sum((t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in [((0, knots[0][1]), (0.5, 1.0))])
        demand = min(1, mine[0]["target"] / mine[0]["source_size"])
        if demand == 1:  # positions of first readings cover source_size / target of the demand
            continue
        assert len(first) / len(mine) == pytest.approx(half, abs=0.02)


def test_every_reading_has_its_place(spark):
    """A small heavy source is read three times, all through its schedule."""
    data = [(i, "w " * 10, "en", "a", "x", 1) for i in range(100)] + [(1000 + i, "w " * 10, "en", s, "x", 1) for i in range(400) for s in "bc"]
    mixed = mix(spark.createDataFrame(data, SCHEMA))
    docs, read = mixed.collect(), in_training_order(mixed).collect()
    assert {r["taken"] for r in docs if r["source"] == "a"} == {MOST * 10}
    assert sum(r["words"] for r in read) == sum(r["taken"] for r in docs)
    for s, knots in zip("abc", SCHEDULES, strict=True):
        mine = [r for r in read if r["source"] == s]
        words, upto = sum(r["words"] for r in mine), 0.0
        for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False):  # every part of the time has the schedule's share of words
            upto += (t1 - t0) * (m0 + m1) / 2
            assert sum(r["words"] for r in mine if r["position"] < t1) / words == pytest.approx(upto, abs=0.01)
        assert sum(r["words"] for r in mine if r["position"] < 0.5) / words == pytest.approx({"a": 0.625, "b": 0.5, "c": 0.375}[s], abs=0.01)
        firsts = [r["position"] for r in docs if r["source"] == s and r["taken"]]
        assert sorted(r["position"] for r in mine)[: len(firsts)] == sorted(firsts)


def test_query_follows_the_positions(spark):
    from docloom.llm.queries import op2_mixing

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    where = {r["doc_id"]: r["position"] for r in mix(docs.select("doc_id", "text", "source")).collect()}
    got = [where[r["doc_id"]] for r in op2_mixing(spark, sf).collect()]
    taken = [p for p in got if p is not None]
    assert len(got) == docs.count() and taken == sorted(taken) == got[: len(taken)]


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r["taken"] for r in mix(spark.createDataFrame([(1, None, None, "a", "x", 1)], SCHEMA)).collect()] == [0]


def test_very_long_text_and_one_huge_source(spark):
    rows = [(i, "a b c d", "en", "hot") for i in range(500)] + [(900, "w " * 100_000, "en", "big"), (901, "x", "en", None)]
    got = {r.doc_id: r for r in mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[900].size == 100_000 and 0 < got[900].taken <= 300_000
    assert abs(sum(r.taken for r in got.values() if r.source == "hot") - got[0].target) <= 4
    assert sum(r.taken for r in got.values()) <= 102_001 + 5
