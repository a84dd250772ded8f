import random
import re
from collections import Counter

import pytest

from docloom.llm import collocations as module
from docloom.llm.collocations import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string"


def brute(data, least, top):
    counts, words, out = {}, Counter(), []
    for _, text, lang, _ in data:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    for lang, f in counts.items():
        found, kept = {p: a for p, a in f.items() if a >= least and len(p) > 1}, []
        for p, a in found.items():
            score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and found[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in found):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, left, right, words[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ünü", "é", "a", "b'c", "x-y", "New", "york", "city", "日本"]
    sentence = lambda: rng.choice([" ", "  ", "\t"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))
    out = [(None, None, None, "x"), (1, "", "en", "x"), (2, " . \n!", "en", "x"), (3, "the end", None, "x")]
    for i in range(500):
        text = ". ".join(sentence() for _ in range(rng.randrange(0, 6))) + rng.choice(["", "!\nAll rights reserved by new york city", "\r\nsame line"])
        out.append((i, text, "en" if i % 3 else rng.choice(["de", "", None]), "x"))
    out.append((9000, "long words in one piece " * 4000, "en", "x"))
    return [*out, *out[-3:]]


@pytest.mark.parametrize("seed, block, segment", [(1, 400_000, 200_000), (2, 100, 50)])
def test_like_the_loop(spark, monkeypatch, seed, block, segment):
    monkeypatch.setattr(module, "BLOCK_WORDS", block)
    monkeypatch.setattr(module, "SEGMENT_WORDS", segment)
    data = rows(seed)
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    for least, top in ((20, 2000), (8, 15)):
        got = [tuple(r) for r in collocations(docs, least=least, top=top).collect()]
        assert sorted(got) == brute(data, least, top) and got


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    data = rows(3)
    docs = spark.createDataFrame(data, SCHEMA)
    monkeypatch.setattr(module, "bitmap_of", lambda counts: module.np.full(module.BITS // 8, 255, module.np.uint8))
    assert sorted(map(tuple, collocations(docs, least=20).collect())) == brute(data, 20, 2000)


def test_numbers_over_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a", 0, 4 * 10**12, 1), ("en", "b", 0, 3 * 10**12, 1), ("en", "a b", 0, 10**12 + 1, 2)], "lang string, phrase string, mark long, n long, width int")
    sizes = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")
    r = module.scored(phrases, sizes).first()
    assert r["score"] == 1000 * (10**12 + 1) * 9 * 10**13 // (12 * 10**24) and r["l"] == 4 * 10**12


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
