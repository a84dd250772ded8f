"""Toxicity: a factorization machine over hashed terms.

A text's score is a logistic function of a bias, the weights of its terms and the products of their factors for every
pair of terms, so that a pair can say more than its two terms. It is fitted to a sample of the labelled documents, about
`per_class` of each class (those with the least 64-bit hashes of doc_id). Every hashed term that `LEAST_DOCS` of the
sample's documents hold, and whose chi-square with the class is at least `EVIDENCE` (chance in one of a thousand terms), has a
weight and factors. So has a term without such an effect of its own that has it among the documents that hold one of the
others: it can matter in a pair. There is no cap on the number of terms.

Empty cases: a null or wordless text scores the bias alone; labels that are null or of unknown documents teach nothing;
without labels of both classes every score is 0; an empty table of documents gives an empty result; rows that repeat (or
lack) a doc_id are scored each by itself, and each of them teaches; of labels that contradict each other the higher holds;
a text of any length is read whole, a term counts once in it; columns named score or predicted are replaced, all others
stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import text_bytes

PER_CLASS, HASHED, FACTORS, LEAST_DOCS, EVIDENCE, ROUNDS = 6_000, 1 << 20, 4, 5, 10.83, 150
#: ASCII letters in lower case, digits and bytes from 128 stay; all other bytes part terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[int]:
    """The distinct hashed terms of a text."""
    return sorted({crc32(w) % HASHED for w in set(text.translate(FOLD).split())})


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(r) for r in rows]
    return np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)


@dataclass
class Machine:
    ids: np.ndarray  # hashed terms, sorted
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, term: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums of factors; term: indices into ids."""
        v = self.factor[term]
        sums = np.stack([np.bincount(doc, weights=v[:, k], minlength=n) for k in range(v.shape[1])], axis=1)
        own = np.bincount(doc, weights=(v * v).sum(axis=1), minlength=n)
        return self.bias + np.bincount(doc, weights=self.weight[term], minlength=n) + ((sums**2).sum(axis=1) - own) / 2, sums

    def score(self, rows: list[list[int]]) -> np.ndarray:
        hashed, doc = flat([np.array(r, dtype=np.int64) for r in rows])
        at = np.minimum(np.searchsorted(self.ids, hashed), max(len(self.ids) - 1, 0))
        known = self.ids[at] == hashed if len(self.ids) else np.zeros(len(hashed), bool)
        raw, _ = self.raw(at[known], doc[known], len(rows))
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def telling(at: np.ndarray, doc: np.ndarray, y: np.ndarray, among: np.ndarray, terms: int) -> np.ndarray:
    """Which terms tell the classes apart in the documents `among`, by the chi-square of their two-by-two tables."""
    here = among[doc]
    seen = np.bincount(at[here], minlength=terms)
    toxic = np.bincount(at[here], weights=y[doc[here]], minlength=terms)
    n = among.sum()
    rate = y[among].mean() if n else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (toxic - seen * rate) ** 2 / (seen * rate * (1 - rate)) * n / (n - seen)
    return (seen >= LEAST_DOCS) & (seen < n) & (np.nan_to_num(chi, posinf=0.0) >= EVIDENCE)


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 1) -> Machine:
    """Full-batch Adam on the weighted logistic loss; `weight` undoes the sampling of classes."""
    term, doc = flat(rows)
    ids, at = np.unique(term, return_inverse=True)
    n = len(rows)
    alone = telling(at, doc, y, np.ones(n, dtype=bool), len(ids))
    beside = np.bincount(doc, weights=alone[at], minlength=n) > 0
    best = np.flatnonzero(alone | telling(at, doc, y, beside, len(ids)))
    keep = np.isin(at, best)
    at, doc = np.searchsorted(best, at[keep]), doc[keep]
    rng = np.random.default_rng(seed)
    m = Machine(ids[best], 0.0, np.zeros(len(best)), rng.normal(0, 0.05, (len(best), FACTORS)))
    first, second = ([np.zeros(()), np.zeros(len(best)), np.zeros((len(best), FACTORS))] for _ in range(2))
    weight = weight / weight.sum()
    for step in range(1, ROUNDS + 1):
        raw, sums = m.raw(at, doc, n)
        err = weight * (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - y)
        e = err[doc]
        g_w = np.bincount(at, weights=e, minlength=len(best)) + 1e-4 * m.weight
        pull = e[:, None] * (sums[doc] - m.factor[at])
        g_v = np.stack([np.bincount(at, weights=pull[:, k], minlength=len(best)) for k in range(FACTORS)], axis=1) + 1e-3 * m.factor
        moves = []
        for k, g in enumerate((err.sum(), g_w, g_v)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            moves.append(0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8))
        m.bias -= float(moves[0])
        m.weight -= moves[1]
        m.factor -= moves[2]
    return m


def share_of(hashed: Column, wanted: int, of: int) -> Column:
    """Whether a 64-bit hash is among the least ones that make `wanted` of `of` rows; never none of them, however many there are."""
    return hashed <= F.lit(-(1 << 63) + min((1 << 64) - 1, (wanted << 64) // max(of, 1)))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | None:
    """From docs (doc_id, text) and labels (doc_id, toxic)."""
    usable = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    hashed = F.xxhash64("doc_id")
    sample = usable.filter(F.when(F.col("toxic") == 1, share_of(hashed, per_class, sizes[1])).otherwise(share_of(hashed, per_class, sizes[0])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            raw = data.tobytes()
            found = [terms(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    taught = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    got = taught.mapInArrow(read, "doc_id long, toxic int, terms array<int>").toArrow()
    if len(set(got["toxic"].to_pylist())) < 2:
        return None
    rows = sorted(zip(got["doc_id"].to_pylist(), got["toxic"].to_pylist(), got["terms"].to_pylist(), strict=True))
    y = np.array([r[1] for r in rows], dtype=float)
    rate = np.array([min(1, per_class / sizes[k]) for k in (0, 1)])
    return fit([np.array(r[2], dtype=np.int64) for r in rows], y, 1 / rate[y.astype(int)])


def toxicity(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """docs with score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    kept = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw, m = data.tobytes(), model.value
            found = [terms(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            score = m.score(found) if m is not None else np.zeros(len(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(each, f"{fields}, score double, predicted int")
