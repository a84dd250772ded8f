"""Exact substring dedup over words with fixed-block anchors.

Every document is a reference: its non-overlapping blocks of `block` words are the index, and every rolling window of
`block` words of every document probes it. A repeat of `span` >= 2 * block - 1 words holds a whole block of the other copy,
so both copies of it have a probe that hits. Hits are extended to whole spans: each window of `span` words around a hit is
looked up by two independent hashes of its words, 128 bits together, and overlapping removed windows join to maximal
repeats.

Empty cases: a null or blank text has no words and keeps none; a null doc_id counts as larger than all others and stays
null; of windows that read the same in rows with one doc_id (or none) all but one go; of windows in one document the
earliest stays; a text may be of any length up to Arrow's 2 GB, its words are hashed some at a time; extra columns are
ignored, also those named like the new ones; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rounds import bucket_of, ids, mail, split_at, two_rounds
from .textbytes import SECOND, U, cover, doc_blocks, least_of_equals, mix, text_bytes, windows_hash, word_hashes, words

BLOCK, SPAN = 10, 20
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string"


class Words:
    """The words of a chunk as numbers, in order of documents."""

    def __init__(self, table: pa.Table) -> None:
        self.data, self.offsets = text_bytes(table["text"])
        found = [(np.zeros(0, U), np.zeros(0, np.int64))]
        for a, b in doc_blocks(self.offsets):
            part, cuts = self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a]
            starts, ends, doc = words(part, cuts)
            found.append((word_hashes(part, starts, ends), doc + a))
        self.value, self.doc = (np.concatenate(x) for x in zip(*found, strict=True))
        self.first = np.searchsorted(self.doc, np.arange(len(self.offsets)))  # of each document's words

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that lie in one document, and their hashes."""
        h = windows_hash(self.value, width)
        inside = np.flatnonzero(self.doc[: len(h)] == self.doc[width - 1 :]) if len(h) else np.zeros(0, np.int64)
        return inside, h[inside]


def _probes(w: Words, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rolling windows' starts; distinct probes (bucket and 32 bits of hash), their number for each start, which repeat here, which are blocks."""
    at, h = w.windows(block)
    keys = bucket_of(h, buckets).astype(np.uint64) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
    distinct, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    is_block = np.zeros(len(distinct), dtype=bool)
    is_block[number[(at - w.first[w.doc[at]]) % block == 0]] = True
    return at, distinct, number, count > 1, is_block


def substring_dedup(docs: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """For each document: words, words removed because an earlier window of `span` words reads the same, and what is left."""
    if span < 2 * block - 1:
        raise ValueError("a span must hold a whole block at any shift")

    def ask(table: pa.Table, chunk: int, buckets: int) -> pa.Table:
        _, distinct, _, many, is_block = _probes(Words(table), block, buckets)
        return mail(
            [(b, chunk, (distinct[s].astype(np.uint32), np.packbits(many[s]), np.packbits(is_block[s]))) for b, s in split_at((distinct >> np.uint64(32)).astype(np.int32))]
        )

    def answer(letters: list) -> list:
        """A bit for each probe: it occurs twice or more, and once as a block at least."""
        sizes = [len(x[2][0]) for x in letters]
        flags = [np.concatenate([np.unpackbits(x[2][k], count=n) for x, n in zip(letters, sizes, strict=True)]) for k in (1, 2)]
        distinct, number = np.unique(np.concatenate([x[2][0] for x in letters]), return_inverse=True)
        times = np.bincount(number, minlength=len(distinct)) + np.bincount(number, weights=flags[0], minlength=len(distinct))
        hit = ((times > 1) & (np.bincount(number, weights=flags[1], minlength=len(distinct)) > 0))[number]
        return [(x[1], x[0], (np.packbits(part),)) for x, part in zip(letters, np.split(hit, np.cumsum(sizes)[:-1]), strict=True)]

    def entries(w: Words, near: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of `span` words about hits; each one's number among the distinct; of the distinct: first occurrence, two hashes, bucket in order."""
        at, h = w.windows(span)
        keep = near[at]
        at, h = at[keep], h[keep]
        other = windows_hash(mix(w.value, 9), span, SECOND)[at]
        number, first = least_of_equals(h, other)
        bucket = bucket_of(h[first], buckets)
        order = np.lexsort((first, bucket))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        first = first[order]
        return at, back[number], first, h[first], other[first], bucket[order]

    def ask_again(table: pa.Table, got: list, chunk: int, buckets: int) -> pa.Table:
        w = Words(table)
        at, distinct, number, *_ = _probes(w, block, buckets)
        hit = np.zeros(len(distinct), dtype=bool)
        where = dict(split_at((distinct >> np.uint64(32)).astype(np.int32)))
        for _, bucket, (bits,) in got:
            s = where[bucket]
            hit[s] = np.unpackbits(bits, count=s.stop - s.start)
        hits = np.zeros(len(w.value) + span + 1, np.int32)
        hits[at + 1] = hit[number]
        total = np.cumsum(hits)
        n = len(w.value)
        near = (total[span - block + 1 : n + span - block + 1] - total[:n]) > 0  # a hit starts in [p, p + span - block]
        at, _, first_at, h, other, bucket = entries(w, near, buckets)
        doc = ids(table)[w.doc[at[first_at]]]
        out = [(b, chunk, (h[s], other[s], doc[s])) for b, s in split_at(bucket)]
        return mail([*out, (-1 - chunk, chunk, (np.packbits(near),))])

    def answer_again(letters: list) -> list:
        """A bit for each distinct window of a chunk: a chunk with a smaller doc_id has it too."""
        sizes = [len(x[2][0]) for x in letters]
        h, other, doc = (np.concatenate([x[2][k] for x in letters]) for k in range(3))
        order = np.lexsort((doc, other, h))
        later = np.zeros(len(h), dtype=bool)
        later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
        return [(x[1], x[0], (np.packbits(part),)) for x, part in zip(letters, np.split(later, np.cumsum(sizes)[:-1]), strict=True)]

    def decide(table: pa.Table, got: list, buckets: int) -> pa.Table:
        w = Words(table)
        n, own = len(w.value), [x for x in got if x[1] < 0]
        near = np.unpackbits(own[0][2][0], count=n).astype(bool)
        at, number, first_at, _, _, bucket = entries(w, near, buckets)
        later = np.zeros(len(first_at), dtype=bool)
        where = dict(split_at(bucket))
        for _, b, (bits,) in (x for x in got if x[1] >= 0):
            later[where[b]] = np.unpackbits(bits, count=where[b].stop - where[b].start)
        drop = later[number]
        repeat = np.ones(len(at), dtype=bool)
        repeat[first_at] = False
        gone = cover(at[drop | repeat], span, n)
        rows = []
        raw, lost = w.data.tobytes(), np.concatenate([[0], np.cumsum(gone)])
        for k, doc_id in enumerate(table["doc_id"].to_pylist()):
            a, b = int(w.first[k]), int(w.first[k + 1])
            removed = int(lost[b] - lost[a])
            kept = raw[int(w.offsets[k]) : int(w.offsets[k + 1])].split()
            kept = b" ".join(compress(kept, (~gone[a:b]).tolist()) if removed else kept)
            rows.append((doc_id, b - a, removed, kept.decode()))
        return pa.Table.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
            names=["doc_id", "n_words", "n_removed", "kept_text"],
        )

    return two_rounds(docs, ask, answer, ask_again, answer_again, decide, SCHEMA)
