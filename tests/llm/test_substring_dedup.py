import random
import re

from docloom.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, source string, chunk string"


def brute(rows, span):
    seen, out = set(), {}
    for doc_id, text in sorted((r[0], r[1] or "") for r in rows):
        w = re.findall(r"[^ \t-\r]+", text)
        gone = set()
        for p in range(len(w) - span + 1):
            key = tuple(w[p : p + span])
            if key in seen:
                gone |= set(range(p, p + span))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), kept)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    passages = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    rows = [(1000, None, None, "x"), (1001, "", "s", "x"), (1002, " \n ", "s", "x"), (1003, "la " * 70, "s", "x"), (1004, "la " * 19, "s", "x")]
    for i in range(120):
        w = [f"w{rng.randrange(200)}é" for _ in range(rng.randrange(0, 50))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w), "s", "x"))
    rows += [(200 + i, rows[8][1], "s", "x") for i in range(5)]
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows, 20)
    assert sum(x[1] for x in got.values()) > 500


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert substring_dedup(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).count() == 2


def test_repeated_ids_long_texts_and_clashing_columns(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    long, passage = " ".join(words), " ".join(words[100:140])
    rows = [(7, long, 1), (7, passage, 2), (7, passage, 3), (None, passage + " end", 4), (None, passage + " end", 5), (9, None, 6)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert sorted((r.n_words, r.n_removed) for r in got if r.doc_id == 7)[-1][0] == 60_000
    # the passage stays in one of the rows with doc_id 7, and goes everywhere else
    assert sum(r.n_removed for r in got if r.doc_id == 7) == 80 and [r.n_removed for r in got if r.doc_id is None] == [40, 40] or sorted(r.n_removed for r in got if r.doc_id is None) == [40, 41]
    assert [r.n_words for r in got if r.doc_id == 9] == [0]


def test_a_passage_in_every_document(spark):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(25)]
    rows = [(i, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(20)), *passage, *(f"w{rng.randrange(10**6)}" for _ in range(20))]), "s", "x") for i in range(400)]
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == brute(rows, 20)
