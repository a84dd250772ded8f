import random
import re

import xxhash

from docloom.llm.simhash import simhash

SCHEMA = "doc_id long, text string, source string, fp string"


def brute(rows):
    fps = {}
    for doc_id, text in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps[doc_id] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    comp = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return {d: (f"{fps[d]:016x}", comp[d]) for d in fps}


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(900, None), (901, ""), (902, "  "), (903, "One"), (904, "ONE"), (905, "a b c É"), (906, "A B C É"), (907, "a b c é")]
    for i in range(25):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 300))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(rng.randrange(5)):
            w = list(w)
            w[rng.randrange(len(w))] = "new"
            rows.append((len(rows), " ".join(w)))
    want = brute(rows)
    df = spark.createDataFrame([(a, b, None, "x") for a, b in rows], SCHEMA)
    got = simhash(df.repartition(3)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(rows) - 20


def test_parts_and_chains(spark):
    """Trees dealt in small parts give the same links."""
    from pyspark.sql import functions as F

    from docloom.llm.components import components
    from docloom.llm.simhash import links

    rng = random.Random(1)
    base = rng.getrandbits(63)
    fps = [base ^ sum(1 << rng.randrange(60) for _ in range(rng.randrange(6))) for _ in range(80)] + [rng.getrandbits(63) for _ in range(40)]
    fps = sorted(set(fps))
    df = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    comp = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            comp[a] = min(comp[b] for b in range(len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 4)
    for part in (3, 1000):
        got = {r[0]: r[1] for r in components(spark, links(df, part=part)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == comp


def test_empty(spark):
    assert simhash(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {tuple(r) for r in simhash(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")).select("doc_id", "component_id").collect()} == {(None, None)}


def test_repeated_rows_long_texts_and_unlike_rows_of_one_doc_id(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(50_000))
    rows = [(4, long), (5, long), (5, "entirely other words in this one"), (None, long), (None, ""), (9, None), (4, long)]
    got = simhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 7 and {r.component_id for r in got if r.doc_id == 4} == {4}
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {9}
    assert len({r.group_key for r in got}) == 3 and len({r.group_key for r in got if r.doc_id == 5}) == 2


def test_trees_visit_few_nodes():
    """Families of fingerprints about centres: a search sees its family and the way to it, not the whole tree."""
    import numpy as np

    from docloom.llm.simhash import Forest

    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) for _ in range(5)]))
    tree = Forest(fps, np.zeros(len(fps), np.int64))
    found = list(tree.near(fps, np.zeros(len(fps), np.int64), 2))
    pairs = {(int(a), int(b)) for q, n in found for a, b in zip(q, n, strict=True)}
    want = {(i, int(j)) for i, f in enumerate(fps) for j in np.flatnonzero(np.bitwise_count(fps ^ f) <= 2)}
    assert pairs == want
    assert tree.visited < 0.6 * len(fps) ** 2
