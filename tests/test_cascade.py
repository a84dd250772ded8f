import random

import pytest

from docloom.operators.cascade import Link, cascaded, doomed


def frames(spark, tables):
    return {n: spark.createDataFrame(r, s) for n, (s, r) in tables.items()}


def brute(tables, keys, links, first):
    gone = {n: set(x) for n, x in first.items()}
    while True:
        size = sum(map(len, gone.values()))
        for child, column, parent in links:
            names = [c.split()[0] for c in tables[child][0].split(", ")]
            for r in tables[child][1]:
                row = dict(zip(names, r, strict=True))
                if row[column] is not None and row[column] in gone.get(parent, ()) and row[keys[child]] is not None:
                    gone.setdefault(child, set()).add(row[keys[child]])
        if sum(map(len, gone.values())) == size:
            return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_the_loop(spark, tmp_path, seed):
    rng = random.Random(seed)
    some = lambda n: rng.choice([None, *range(n)])
    tables = {
        "users": ("id long, boss long", [(i, some(20)) for i in range(20)]),  # a graph with rings
        "books": ("book long, owner long", [(i, some(20)) for i in range(40)]),
        "notes": ("note long, book long, author long", [(some(200), some(40), some(20)) for _ in range(120)]),
        "apart": ("id long, x long", [(i, i) for i in range(5)]),
    }
    keys = {"users": "id", "books": "book", "notes": "note", "apart": "id"}
    links = [Link("users", "boss", "users"), Link("books", "owner", "users"), Link("notes", "book", "books"), Link("notes", "author", "users")]
    start = {"users": [rng.randrange(20)], "books": [3]}
    first = {n: spark.createDataFrame([(x,) for x in v], "any long") for n, v in start.items()}
    got = cascaded(frames(spark, tables), keys, links, first, f"{tmp_path}/c")
    want = brute(tables, keys, links, start)
    for n, (s, rows) in tables.items():
        at = [c.split()[0] for c in s.split(", ")].index(keys[n])
        assert sorted(map(repr, map(tuple, got[n].collect()))) == sorted(repr(r) for r in rows if r[at] not in want.get(n, ()))


def test_three_levels_and_a_ring(spark, tmp_path):
    tables = {"t": ("id long, up long", [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 5), (7, 7), (8, None)])}
    found = doomed(frames(spark, tables), {"t": "id"}, [Link("t", "up", "t")], {"t": spark.createDataFrame([(2,)], "id long")}, f"{tmp_path}/c")
    assert sorted(r["key"] for r in found["t"].collect()) == [1, 2, 3, 4, 5, 6]


def test_nothing_to_delete(spark, tmp_path):
    tables = frames(spark, {"t": ("id long, up long", [(1, None)])})
    assert cascaded(tables, {"t": "id"}, [Link("t", "up", "t")], {"t": spark.createDataFrame([], "id long")}, f"{tmp_path}/c")["t"].count() == 1
