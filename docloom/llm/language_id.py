"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of lower-cased 1- to 3-grams come from a sample of about `per_language` documents of each language (those with the
least 64-bit hashes of doc_id); the matrix of log probabilities has a fixed number of columns and is broadcast. Every value
of lang is learned; if their matrix would be over MATRIX_BYTES (1,024 languages), learning stops with an error before
anything is gathered, and `most_languages` must say how many, those with most documents, are meant. Scoring gathers and sums
the matrix in numpy over whole texts.

Empty cases: a null text, or one without a letter, is `und` with score 0, and so is every text when nothing can be learned;
documents with null lang or text teach nothing; equal likelihoods go to the language first by code point; rows that repeat
(or lack) a doc_id are predicted each by itself; texts of any length are read whole; an empty table gives an empty result;
columns named lang_pred or score are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U, mix

ORDERS, BUCKETS, PER_LANGUAGE, MATRIX_BYTES, SMOOTHING, PORTION = (1, 2, 3), 1 << 16, 4_000, 1 << 29, 0.5, 500_000
LETTER = regex.compile(r"\p{L}")


def portions(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts, about PORTION characters together."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= PORTION:
            yield some
            some, size = [], 0
    if some:
        yield some


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed n-grams of the texts, and the text of each."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    value = codes
    for n in ORDERS:
        if len(codes) < n:
            return
        if n > 1:
            value = value[:-1] * U(0x100000001B3) + codes[n - 1 :]
        inside = doc[: len(value)] == doc[n - 1 :]
        yield (mix(value[inside], n) % U(BUCKETS)).astype(np.int64), doc[: len(value)][inside]


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int | None = None) -> tuple[list[str], np.ndarray]:
    """The languages and their log probabilities (languages x BUCKETS) from (doc_id, text, lang)."""
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").count()
    if most_languages is not None:
        sizes = sizes.orderBy(F.desc("count"), "lang").limit(most_languages)
    if (n := sizes.count()) * BUCKETS * 8 > MATRIX_BYTES:
        raise ValueError(f"{n} values of lang are too many for one matrix; say how many are meant by most_languages")
    # a language's documents with the least hashes: a bound on the hash, never none of them, however many there are
    bound = F.when(F.col("count") <= per_language, F.lit((1 << 63) - 1)).otherwise((F.lit(float(per_language)) / F.col("count") * F.lit(2.0**64) - F.lit(2.0**63)).cast("long"))
    bounds = sizes.select("lang", bound.alias("bound"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                total = np.zeros(BUCKETS, np.int64)
                for some in portions([texts[i] for i in np.flatnonzero(langs == lang)]):
                    for feature, _ in grams(some):
                        total += np.bincount(feature, minlength=BUCKETS)
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(total[found])], names=["lang", "feature", "n"])

    # coalesce: without doc_id, by text
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    sample = usable.join(F.broadcast(bounds), "lang").filter(hashed <= F.col("bound")).select("text", "lang")
    counts = sample.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()  # what the sample holds, MATRIX_BYTES / 8 rows at most
    langs = sorted(counts["lang"].unique())
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    table[np.searchsorted(langs, counts["lang"]), counts["feature"]] += counts["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, langs: list[str], log_p: np.ndarray) -> DataFrame:
    """docs with lang_pred and score (the posterior of an even prior)."""
    model = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(log_p)))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(column: pa.Array) -> pa.Array:
        names, table = model.value
        pred, score = [], []
        for some in portions([t or "" for t in column.to_pylist()]):
            total = np.zeros((len(some), len(names)))
            for feature, doc in grams(some):
                for k in range(len(names)):
                    total[:, k] += np.bincount(doc, weights=table[k][feature], minlength=len(some))
            if not names:
                pred, score = pred + ["und"] * len(some), score + [0.0] * len(some)
                continue
            best = total.argmax(axis=1)
            sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for text, b, s in zip(some, best.tolist(), sure.tolist(), strict=True):
                letter = LETTER.search(text)
                pred.append(names[b] if letter else "und")
                score.append(s if letter else 0.0)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    found = docs.select(*[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(kept)], predict(F.col("text").cast("string")).alias("found"))
    return found.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept)], "found.lang_pred", "found.score")
