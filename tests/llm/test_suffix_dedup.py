import random

from docloom.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, source string, chunk string"


def brute(rows, width):
    first, out = {}, {}
    texts = sorted((r[0], (r[1] or "").encode()) for r in rows)
    for doc_id, t in texts:
        for p in range(len(t) - width + 1):
            first.setdefault(t[p : p + width], doc_id)
    for doc_id, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] < doc_id:
                gone[p : p + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


def make(seed, letters, n):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(30, 200))) for _ in range(8)]
    rows = [(1000, None, "s", "x"), (1001, "", "s", "x"), (1002, "a" * 300, "s", "x"), (1003, "a" * 60 + "b", "s", "x"), (1004, "ab" * 70, "s", "x")]
    for i in range(n):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 150)))
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(t) + 1), rng.choice(passages)
            a = rng.randrange(20)
            t = t[:at] + p[a : len(p) - rng.randrange(20)] + t[at:]
        rows.append((i, t, "s", "x"))
    rows += [(n + i, rows[9][1], "s", "x") for i in range(5)]
    return rows


def test_against_brute_force(spark):
    for seed, letters in ((1, "abcdefghijklmnop éßñ"), (2, "ab")):
        rows = make(seed, letters, 150)
        got = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), as_text=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "source", "chunk").collect()
        want = brute(rows, 50)
        assert {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in got} == want
        assert all(r[6:] == ("s", "x") for r in got)
        assert all(bytes(r[4]).decode(errors="ignore") == r[5] for r in got)
        assert sum(x[1] for x in want.values()) > 2000


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert suffix_dedup(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).count() == 2


def test_a_line_that_very_many_texts_hold(spark):
    """A template's line with varying text beside it: its pieces are dealt on by window, over chunks as well."""
    rng = random.Random(4)
    line = "Permission is hereby granted, free of charge, to all who read these lines of text"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = [(i, f"{' '.join(word() for _ in range(30))} {line} {' '.join(word() for _ in range(rng.randrange(40)))}", "s", "x") for i in range(300)]
    rows += [(1000 + i, rows[i][1][5:], "s", "x") for i in range(0, 40, 4)]
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(rows, 50)
    assert {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in got} == want
    assert all(want[i][1] >= len(line) for i in range(1, 300))


def test_slices_of_a_long_text(spark, monkeypatch):
    from docloom.llm import suffix_dedup as module

    monkeypatch.setattr(module, "SLICE", 1_000)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdef ") for _ in range(200_000))
    rows = [(1, long[150_000:150_400], "s", "x"), (2, long, "s", "x"), (3, long[990:1_100] + "z" * 30, "s", "x"), (4, long[77_000:79_100], "s", "x")]
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in got} == brute(rows, 50)


def test_a_very_long_text(spark):
    """30 MB in slices of the usual size; nothing else depends on a text's length."""
    from pyspark.sql import functions as F

    block = "".join(random.Random(9).choices("abcdefghijklmnop ", k=3_000_000))
    small = spark.createDataFrame([(1, block[5_000:5_200]), (2, block)], "doc_id long, text string")
    docs = small.withColumn("text", F.when(F.col("doc_id") == 2, F.repeat("text", 10)).otherwise(F.col("text")))
    got = {r.doc_id: r for r in suffix_dedup(docs).drop("kept").collect()}
    assert got[1].n_removed == 0 and got[2].n_bytes == 30_000_000 and got[2].n_removed == 10 * 200 and got[2].n_spans == 10


def test_rows_that_share_or_lack_a_doc_id(spark):
    text = "these words stand here, in this order, and in no other, some fifty bytes and more of them"
    rows = [(5, text), (5, text), (None, text + " x"), (None, text + " y"), (3, "before " + text)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed >= len(text)) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 3, False), (False, 5, True), (False, 5, True), (True, 0, True), (True, 0, True)]
    alone = suffix_dedup(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert [r.n_removed for r in alone] == [0, 0]
