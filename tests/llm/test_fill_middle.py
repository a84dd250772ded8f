import hashlib
import random
import re

from docloom.llm.fill_middle import fill_middle, restored

SCHEMA = "doc_id long, text string, n string, `a.b` string"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", prefix, middle, suffix, f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    rng = random.Random(5)
    alphabet = ["a", "B", "word", " ", "\n", "é", "\U0001f600", "\x01", "\x02", "\x020", "0", "1", "<", ">", "S", "<P", "M>", "$0", "\\", "\x00"]
    out = [(None, None), (1, ""), (2, "x"), (3, "\x01"), (4, "has <M> inside"), (None, "no id here"), (5, "\x02\x01\x021\x020a")]
    out += [(6, "ab " * 700_000), (7, "\x01" * 100_000)]
    out += [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    return [(i, x, "own", "y") for i, x in [*out, out[-1]]]


def test_like_the_loop_and_restored(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(4)
    from pyspark.sql import functions as F

    got = fill_middle(docs).withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(data) and got[0]["a.b"] == "y"
    cells = lambda r: (str(r["doc_id"]), r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"], r["again"])
    want = [(str(i), *brute(i, x), x or "") for i, x, *_ in data]
    assert sorted(map(repr, map(cells, got))) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    assert fill_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_need_nothing_from_each_other(spark):
    docs = spark.createDataFrame(rows()[:20], SCHEMA)
    plan = fill_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
