"""Tokens of a public vocabulary against a plain merge loop."""

import base64
import os
import random

import pytest
import regex
from pyspark.sql import functions as F

from docloom.functions import tokens
from docloom.operators import retrieve

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def vocabulary(spark):
    return tokens.Vocabulary(spark, PATH)


def loop(text, ranks, known={}):  # noqa: B006
    """Merging by scans, word by word."""
    out = []
    for word in regex.findall(tokens.PATTERN, text):
        if word not in known:
            parts = [bytes([b]) for b in word.encode()]
            while len(parts) > 1:
                best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            known[word] = [ranks[p] for p in parts]
        out += known[word]
    return out


def test_a_whole_table(spark, vocabulary, ranks):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.withColumns({"n": vocabulary.count(F.col("text")), "tokens": vocabulary.encoded(F.col("text"))}).withColumn("again", vocabulary.decoded(F.col("tokens"))).collect()
    for r in rows:
        assert r["tokens"] == loop(r["text"], ranks) and r["n"] == len(r["tokens"]) and r["again"] == r["text"]


def test_odd_texts(spark, vocabulary, ranks):
    rng = random.Random(3)
    texts = ["", " ", "\n\n  x", "don't we'll", "naïve 日本語 \U0001f600", "<|endoftext|>", "a" * 5000, "ab" * 3000 + " end", " " * 4000 + "x", "".join(rng.choice("abcé日 \n1!") for _ in range(3000))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, text string")
    got = {r["i"]: r for r in rows.withColumns({"n": vocabulary.count(F.col("text")), "tokens": vocabulary.encoded(F.col("text")), "cut": vocabulary.cut(F.col("text"), 3)}).collect()}
    for i, x in enumerate(texts):
        want = loop(x, ranks)
        assert got[i]["tokens"] == want and got[i]["n"] == len(want)
        assert x.startswith(got[i]["cut"]) and len(loop(got[i]["cut"], ranks)) <= 3
    assert got[len(texts)]["n"] == 0 and got[len(texts)]["tokens"] is None


def test_long_words_in_good_time(ranks):
    import time

    began, words = time.perf_counter(), {v: k for k, v in ranks.items()}
    long = ("abcdefgh" * 50_000).encode()
    assert b"".join(words[t] for t in tokens.merged(long, ranks)) == long
    assert time.perf_counter() - began < 20


def test_budgets_by_tokens(spark, vocabulary, ranks):
    rows = spark.createDataFrame([("a", i, 10 - i, f"some words for row {i}") for i in range(8)], "owner string, pos int, score int, text string")
    n = len(loop("some words for row 0", ranks))
    kept = retrieve.within_budget(rows, 3 * n, "owner", count=vocabulary.count).collect()
    assert [r["pos"] for r in sorted(kept, key=lambda r: r["pos"])] == [0, 1, 2] and "own_tokens" not in kept[0].asDict()
    texts = ["One short text.", "A. B. C. D. " + "more words follow here. " * 30, "Never reached because of the budget, long as it is."]
    frame = spark.createDataFrame([(texts,)], "texts array<string>")
    got = frame.select(retrieve.budget_with_summaries(F.col("texts"), 18, vocabulary.count_each).alias("kept")).first()["kept"]
    assert got[0] == texts[0] and len(got) == 2 and got[1] != texts[1] and texts[1].startswith(got[1][:2])


def test_too_large_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_BYTES", 10)
    (tmp_path / "v").write_text("YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError, match="at most"):
        tokens.Vocabulary(spark, str(tmp_path / "v"))
