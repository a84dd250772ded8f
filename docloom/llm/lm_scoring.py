"""Language-model scoring by cross-entropy difference.

A target and a background bigram model with the same order, smoothing and vocabulary are counted over the whole corpus: the
target over documents that the labels call good, the background over all others. A document's score is the mean over its
words of (target loss - background loss): below 0, the target model expects it better. Its own words are left out of the
counts of the model that counted them, so that a document is judged by what all others hold.

Words are ASCII-lower-cased. The vocabulary is every distinct word of the corpus, and every word, context and pair of words
has its exact count on either side, so the tables grow with the corpus; they never leave the executors. Each chunk of
documents sends the counts of its distinct words, contexts and pairs to the buckets of their hashes (a key is known by its
bucket and 48 more bits); a bucket adds them up over all chunks and returns the sums that the chunk asked for. A word that
fills the corpus costs one entry for each chunk. All words together are one more key; the driver gets only the number of
distinct words.

Empty cases: a null or blank text has no words and losses of 0; null labels or doc_ids count as background; without target
documents the target model is the smoothing alone; rows that repeat a doc_id are scored each by itself; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import bucket_of, mail, one_round, split_at
from .textbytes import U, doc_blocks, mix, text_bytes, word_hashes, words

SHARE, SMOOTHING = 0.7, 0.1
#: Keys of the start of a text and of all words.
START, ALL = U(0x5BD1E995), U(0x2545F4914F6CDD1D)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def packed(numbers: np.ndarray) -> np.ndarray:
    """64-bit numbers as bytes: how many, then their bytes of equal weight together, so that small ones compress well."""
    planes = numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return np.frombuffer(len(numbers).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True), np.uint8)


def unpacked(body: np.ndarray) -> np.ndarray:
    size = int.from_bytes(body[:4].tobytes(), "little")
    planes = np.frombuffer(pa.decompress(body[4:].tobytes(), 8 * size, "zstd"), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def vocabulary_size(docs: DataFrame) -> int:
    """Number of distinct words of the corpus."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, U)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in doc_blocks(offsets, 2_000_000):
                part = LOWER[data[offsets[a] : offsets[b]]]
                known = np.union1d(known, word_hashes(part, *words(part, offsets[a : b + 1] - offsets[a])[:2]))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64))], names=["word"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(distinct, "word long").distinct().count()


def own_times(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each token's key occurs in its document."""
    _, number, times = np.unique(doc * (int(key.max()) + 1 if len(key) else 1) + key, return_inverse=True, return_counts=True)
    return times[number]


class Grams:
    """A chunk's documents as numbers: for each token its distinct word, context and pair."""

    def __init__(self, table: pa.Table) -> None:
        mark = table["mark"].to_numpy(zero_copy_only=False).astype(bool)
        self.docs = table.filter(pa.array(~mark))
        known = table.filter(pa.array(mark))["doc_id"].combine_chunks().drop_null()
        good = pc.is_in(self.docs["doc_id"], value_set=known).to_numpy(zero_copy_only=False).astype(bool)
        data, offsets = text_bytes(self.docs["text"])
        data = LOWER[data]
        starts, ends, self.doc = words(data, offsets)
        h = word_hashes(data, starts, ends)
        vocabulary, word = np.unique(h, return_inverse=True)
        n, first = len(vocabulary), np.diff(self.doc, prepend=-1) != 0
        context = np.concatenate([np.full(1, n), word[:-1]])[: len(word)]
        context[first] = n  # the start of a text
        pairs, pair = np.unique(context * (n + 1) + word, return_inverse=True)
        before = np.append(vocabulary, START)
        keys = [mix(vocabulary, 1), mix(before, 2), mix(before[pairs // (n + 1)] * U(0x9E3779B97F4A7C15) ^ vocabulary[pairs % (n + 1)], 3), np.full(1, ALL)]
        self.keys = np.concatenate(keys) if n else np.zeros(0, U)
        self.side = good
        self.token = (word, context + n, pair + 2 * n + 1, np.full(len(word), len(self.keys) - 1))  # keys of each token's word, context, pair and of all words
        side = good[self.doc]
        self.counts = [sum(np.bincount(x[side == wanted], minlength=len(self.keys)) for x in self.token).astype(np.int64) for wanted in (True, False)]

    def dealt(self, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, numbers of its keys, their 48 bits in rising order)."""
        bucket, low = bucket_of(self.keys, buckets), (self.keys & U((1 << 48) - 1)).astype(np.int64)
        order = np.lexsort((low, bucket))
        return [(b, order[s], low[order[s]]) for b, s in split_at(bucket[order])] if len(order) else []


def cross_entropy_difference(docs: DataFrame, good: DataFrame, share: float = SHARE, smoothing: float = SMOOTHING) -> DataFrame:
    """For each of docs (doc_id, text): n_tokens, target_loss and background_loss (means over words), score (their difference).

    good: doc_ids of the target's documents.
    """
    distinct = vocabulary_size(docs)

    def ask(table: pa.Table, chunk: int, buckets: int) -> pa.Table:
        g = Grams(table)
        return mail([(b, chunk, (packed(np.diff(low, prepend=0)), *(packed(c[x]) for c in g.counts))) for b, x, low in g.dealt(buckets)])

    def answer(letters: list) -> list:
        """Each key's counts of the whole corpus."""
        held = [np.cumsum(unpacked(x[2][0])) for x in letters]
        cuts = np.cumsum([0, *map(len, held)])
        keys, number = np.unique(np.concatenate(held), return_inverse=True)
        sums = []
        for k in (1, 2):
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, number, np.concatenate([unpacked(x[2][k]) for x in letters]))
            sums.append(total)
        return [(x[1], x[0], tuple(packed(s[number[a:b]]) for s in sums)) for x, a, b in zip(letters, cuts[:-1], cuts[1:], strict=True)]

    def decide(table: pa.Table, got: list, buckets: int) -> pa.Table:
        g = Grams(table)
        n, where = g.docs.num_rows, {b: x for b, x, _ in g.dealt(buckets)}
        counts = np.zeros((2, len(g.keys)), np.int64)
        for _, bucket, sums in got:
            for k in (0, 1):
                counts[k][where[bucket]] = unpacked(sums[k])
        length, loss = np.bincount(g.doc, minlength=n), []
        word, context, pair, _ = g.token
        # without the document's own words: what others wrote must have made them likely
        own_word, own_context, own_pair = (own_times(x, g.doc) for x in (word, context, pair))
        for k in (0, 1):
            mine = g.side[g.doc] == (k == 0)
            every = counts[k][-1] if n and len(g.keys) else 0
            alone = (counts[k][word] - mine * own_word + smoothing) / (every - mine * length[g.doc] + smoothing * distinct)
            seen = counts[k][context] - mine * own_context
            p = (1 - share) * alone + share * np.where(seen > 0, (counts[k][pair] - mine * own_pair) / np.maximum(seen, 1), alone)
            loss.append(np.bincount(g.doc, weights=-np.log(p), minlength=n) / np.maximum(length, 1))
        return pa.Table.from_arrays([g.docs["doc_id"], pa.array(length), pa.array(loss[0]), pa.array(loss[1]), pa.array(loss[0] - loss[1])], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return one_round(docs, good, ask, answer, decide, SCHEMA)
