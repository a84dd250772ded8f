import random
import re

from docloom.llm.decontaminate import decontaminate


def ws(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=10):
    wins = {}
    for i, t in items:
        w = ws(t)
        for p in range(len(w) - min(n, len(w)) + 1):
            if w and i is not None:
                wins.setdefault(tuple(w[p : p + min(n, len(w))]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, who = ws(t), set(), set()
        for size in {len(k) for k in wins}:
            for p in range(len(w) - size + 1):
                if (k := tuple(w[p : p + size])) in wins:
                    hit |= set(range(p, p + size))
                    who |= wins[k]
        out.append((d, len(w), len(hit), tuple(sorted(who))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: f"{rng.choice(['a', 'Bé', 'É', 'c9'])}{rng.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(10, 40)))) for i in range(20)]
    items += [(30, "Short one here"), (31, "the only"), (32, ""), (33, None), (34, "--- ..."), (0, items[0][1]), (35, items[3][1]), (None, "q " * 12), (36, "la " * 25)]
    docs = [(900, None), (901, ""), (None, "the only"), (902, "THE-only!"), (903, "la " * 200), (904, items[1][1]), (905, "short, one; HERE" * 2)]
    for i in range(80):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            t = items[rng.randrange(20)][1].split()
            a = rng.randrange(len(t))
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[a : a + rng.randrange(5, 30)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 7 == 0 else " ".join(w)))
    docs.append((5, docs[20][1]))
    d = spark.createDataFrame([(a, b, "x", "y") for a, b in docs], "doc_id long, text string, n string, words string")
    b = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r.item_ids))) for r in decontaminate(d, b).collect()), key=str)
    assert got == brute(docs, items)
    assert sum(r[2] > 0 for r in got) > 20
    none = decontaminate(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit for r in none)
    assert decontaminate(d.limit(0), b).collect() == []


def test_clashing_columns_long_texts_repeats_and_many_lengths(spark):
    rng = random.Random(2)
    long = [f"v{rng.randrange(50)}" for _ in range(20_000)]
    items = [(k, " ".join(long[100 * k : 100 * k + n])) for k, n in enumerate((1, 2, 3, 5, 6, 9, 10, 11, 30))] + [(3, " ".join(long[300:305])), (None, "v1 v2")]
    docs = [(1, " ".join(long)), (1, "nothing of it"), (1, " ".join(long[600:640])), (None, " ".join(long[795:850])), (None, "other"), (2, None), (3, " ".join(long[600:609]))]
    frame = spark.createDataFrame([(*r, 7, 8, "mine") for r in docs], "doc_id long, text string, n_words int, n_hit int, item_ids string")
    got = decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "n_words", "n_hit", "item_ids"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r.item_ids)) for r in got.collect()), key=key) == sorted(((d, n, h, sorted(w)) for d, n, h, w in brute(docs, items)), key=key)
    assert decontaminate(frame, spark.createDataFrame([], "item_id long, text string")).filter("n_hit = 0").count() == len(docs)
