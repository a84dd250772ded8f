"""Exact substring dedup over bytes with merged Burrows-Wheeler transforms.

1. Minimizers find what may repeat: each `width`-byte window names the least hash among its `seed`-byte pieces, so equal
   windows name equal pieces; only pieces that two documents hold go on.
2. Around such a piece lie the windows that name it, a segment of at most 2 * width - seed bytes. Segments go to the
   bucket of their piece. There each of two shards sorts its own distinct segments' suffixes into a Burrows-Wheeler
   transform; the transforms are merged by refining their interleave, two symbols of depth a pass, noting where a pass
   first tells neighbours apart (their common prefix). At depth `width` the intervals without such a cut are the
   repeated strings, and the least doc_id in an interval is where the string starts first.
3. A piece about which very many texts differ (a template's line) would make one group of all its segments. Chunks say
   which pieces have over `VARIED` segments in them; such a piece, or one of over `CROWD` chunks, is dealt on: its windows
   go to the buckets of their own hashes and meet there by 128 bits of hash, so that the group spreads over all buckets.
4. Every window that starts in a smaller doc_id as well is removed, overlaps included.

Empty cases: null text counts as empty; a null doc_id counts as larger than all others and stays null; rows that repeat a
doc_id don't remove each other's bytes; texts shorter than `width` keep all; a text may be of any length up to Arrow's
2 GB, it is read in slices of `SLICE` bytes; extra columns are ignored, also those named like the new ones; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rounds import NO_ID, bucket_of, ids, mail, split_at, two_rounds
from .textbytes import BYTE_VALUE, SECOND, U, doc_blocks, least_of_equals, mix, spans_hash, text_bytes, windows_hash

SEED, WIDTH, BLOCK_SYMBOLS, PLACE_BITS, SLICE, VARIED, CROWD = 24, 50, 150_000, 28, 1_000_000, 16, 1_000
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"


class Pieces:
    """Where the windows of a chunk name the same piece: first window, number of windows, hash of the piece and of the bytes, document."""

    def __init__(self, table: pa.Table, seed: int, width: int) -> None:
        self.data, self.offsets = text_bytes(table["text"])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))]
        for a, b in doc_blocks(self.offsets):
            at, end = int(self.offsets[a]), int(self.offsets[b])
            if b - a == 1 and end - at > SLICE:  # slices of one long text: each window starts in one of them
                cuts = [(x, min(end, x + SLICE + width - 1)) for x in range(at, end - width + 1, SLICE)]
                parts = [(x, self._block(self.data[x:y], np.array([0, y - x]), seed, width)) for x, y in cuts]
            else:
                parts = [(at, self._block(self.data[at:end], self.offsets[a : b + 1] - at, seed, width))]
            found += [(first + x, count, named, whole, doc + a) for x, (first, count, named, whole, doc) in parts]
        self.first, self.count, self.hash, self.whole, self.doc = (np.concatenate(x) for x in zip(*found, strict=True))

    @staticmethod
    def _block(data: np.ndarray, offsets: np.ndarray, seed: int, width: int) -> tuple[np.ndarray, ...]:
        if len(data) < width:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, U, np.int64))
        value = BYTE_VALUE[data]
        h = windows_hash(value, seed)
        least = h >> U(PLACE_BITS) << U(PLACE_BITS) | np.arange(len(h), dtype=U)
        span, pieces = 1, width - seed + 1
        while span * 2 <= pieces:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < pieces:
            least = np.minimum(least[: span - pieces], least[pieces - span :])
        named = (least & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        inside = np.zeros(len(named) + 1, dtype=np.int32)
        whole = offsets[:-1][np.diff(offsets) >= width]
        np.add.at(inside, whole, 1)
        np.add.at(inside, offsets[1:][np.diff(offsets) >= width] - width + 1, -1)
        inside = np.cumsum(inside[:-1]) > 0
        fresh = inside.copy()
        fresh[1:] &= ~(inside[:-1] & (named[1:] == named[:-1]))
        first = np.flatnonzero(fresh)
        before = np.concatenate([[0], np.cumsum(inside)])
        count = before[np.append(first[1:], len(named))] - before[first] if len(first) else np.zeros(0, np.int64)
        return first, count, h[named[first]], spans_hash(value, first, first + count + width - 1), np.searchsorted(offsets, first, side="right") - 1


def gather(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + length[i] - 1, end to end."""
    if not len(first):
        return np.zeros(0, np.int64)
    begins = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(first - begins, length)


def window_hashes(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows at rising starts, some at a time."""
    found, at = [(np.zeros(0, U), np.zeros(0, U))], 0
    while at < len(starts):
        upto = int(np.searchsorted(starts, starts[at] + SLICE, side="right"))
        value, own = BYTE_VALUE[data[starts[at] : starts[upto - 1] + width]], starts[at:upto] - starts[at]
        found.append((spans_hash(value, own, own + width), spans_hash(mix(value, 9), own, own + width, SECOND)))
        at = upto
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged_runs(starts: np.ndarray, width: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs that windows at `starts` cover together, none across texts: first byte, end, text; memory by windows, not by bytes."""
    starts = np.unique(starts)
    cell = np.searchsorted(offsets, starts, side="right") - 1
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (starts[1:] > starts[:-1] + width) | (cell[1:] != cell[:-1])
    last = np.append(fresh[1:], True) if len(starts) else fresh
    return starts[fresh], starts[last] + width, cell[fresh]


class Shard:
    """The suffixes of some segments, sorted to `width` symbols, and the one and the two symbols before each (0 ends a segment, then it starts anew)."""

    def __init__(self, data: np.ndarray, first: np.ndarray, length: np.ndarray, width: int) -> None:
        total = length + 1
        begins = np.cumsum(total) - total
        symbols = np.zeros(int(total.sum()), np.uint8)
        symbols[gather(begins, length)] = data[gather(first, length)] + 1
        self.segment = np.repeat(np.arange(len(first)), total)
        self.place = np.arange(len(symbols)) - np.repeat(begins, total)
        after = np.arange(1, len(symbols) + 1)
        after[begins + length] = begins
        before = np.empty_like(after)
        before[after] = np.arange(len(symbols))
        pair = symbols.astype(np.uint16) << 8 | symbols[after]
        jump, at, order = after[after], np.arange(len(symbols)), np.arange(len(symbols))
        keys = []
        for _ in range(-(-width // 2)):
            keys.append(pair[at])
            at = jump[at]
        for key in reversed(keys):
            order = order[np.argsort(key[order], kind="stable")]
        last = before[order]
        self.order, self.bwt, self.bwt2 = order, symbols[last], pair[before[last]]


def merge(a: Shard, b: Shard, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the merged suffixes: row (a's rows, then b's), and the number of the interval whose `width` symbols agree."""
    one, two = np.concatenate([a.bwt, b.bwt]), np.concatenate([a.bwt2, b.bwt2])
    n, split = len(one), len(a.bwt)
    side = np.zeros(n, dtype=bool)
    side[split:] = True
    interval, place = np.zeros(n, np.int32), np.arange(n, dtype=np.int32)

    def rows() -> np.ndarray:
        upto = np.cumsum(side, dtype=np.int32)
        return np.where(side, upto + np.int32(split - 1), place - upto)

    # a pass by the symbol before sorts suffixes by one symbol more, a pass by the two before by two more
    for symbols in [one] * (width % 2) + [two] * (width // 2):
        symbol = symbols[rows()]
        order = np.argsort(symbol, kind="stable").astype(np.int32)
        side, symbol, old = side[order], symbol[order], interval[order]
        cut = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        np.cumsum(cut, out=interval[1:])
    return rows(), interval


def least_starts(data: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """For each window of each distinct segment, end to end: the least doc of all its group's segments that hold the same window."""
    out, begins = np.repeat(doc, count), np.cumsum(count) - count
    size = np.bincount(group, minlength=int(group.max()) + 1 if len(group) else 0)
    many = np.flatnonzero(size[group] > 1)
    many = many[np.argsort(group[many], kind="stable")]
    if not len(many):
        return out
    length = count + width  # a window more than width - 1, and the end mark
    upto = np.cumsum(length[many])
    last_of_group = np.append(np.flatnonzero(np.diff(group[many])), len(many) - 1)
    cuts, base = [], 0
    for k in last_of_group.tolist():
        if upto[k] - base >= BLOCK_SYMBOLS:
            cuts.append(k + 1)
            base = upto[k]
    for some in np.split(many, [c for c in cuts if c < len(many)]):
        halves = [some[0::2], some[1::2]]
        a, b = (Shard(data, first[x], count[x] + width - 1, width) for x in halves)
        row, interval = merge(a, b, width)
        segment = np.concatenate([halves[0][a.segment[a.order]], halves[1][b.segment[b.order]]])[row]
        place = np.concatenate([a.place[a.order], b.place[b.order]])[row]
        starts = place < count[segment]
        segment, place, interval = segment[starts], place[starts], interval[starts]
        edge = np.flatnonzero(np.diff(interval, prepend=-1))
        least = np.minimum.reduceat(doc[segment], edge)
        out[begins[segment] + place] = np.repeat(least, np.diff(np.append(edge, len(interval))))
    return out


def suffix_dedup(docs: DataFrame, width: int = WIDTH, seed: int = SEED, as_text: bool = False) -> DataFrame:
    """For each document: bytes, bytes and runs removed, and what is left.

    With as_text, also kept_text, without the halves of cut characters, and the columns of docs other than the new ones.
    """
    if not 2 <= seed <= width:
        raise ValueError("a window must hold a piece")

    def asked(p: Pieces, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        keys = bucket_of(p.hash, buckets).astype(U) << U(32) | (p.hash & U(0xFFFFFFFF))
        return np.unique(keys, return_inverse=True)

    def ask(table: pa.Table, chunk: int, buckets: int) -> pa.Table:
        p, doc = Pieces(table, seed, width), ids(table)
        distinct, number = asked(p, buckets)
        low, high = np.full(len(distinct), NO_ID), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, number, doc[p.doc])
        np.maximum.at(high, number, doc[p.doc])
        _, one = least_of_equals(p.hash, p.whole)
        varied = np.bincount(number[one], minlength=len(distinct)) > VARIED
        return mail(
            [(b, chunk, (distinct[s].astype(np.uint32), np.packbits((low != high)[s]), np.packbits(varied[s]))) for b, s in split_at((distinct >> U(32)).astype(np.int32))]
        )

    def answer(letters: list) -> list:
        """Two bits for each piece: two documents or more hold it; its windows are to be dealt on."""
        sizes = [len(x[2][0]) for x in letters]
        distinct, number = np.unique(np.concatenate([x[2][0] for x in letters]), return_inverse=True)
        many, varied = (np.concatenate([np.unpackbits(x[2][k], count=n) for x, n in zip(letters, sizes, strict=True)]) for k in (1, 2))
        chunks = np.bincount(number, minlength=len(distinct))
        several = chunks + np.bincount(number, weights=many, minlength=len(distinct)) > 1
        spread = several & ((np.bincount(number, weights=varied, minlength=len(distinct)) > 0) | (chunks > CROWD))
        parts = (np.split(x[number], np.cumsum(sizes)[:-1]) for x in (several, spread))
        return [(x[1], x[0], (np.packbits(a), np.packbits(b))) for x, a, b in zip(letters, *parts, strict=True)]

    def segments(p: Pieces, hit: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """Of the pieces that hit: their indices, each one's number among the distinct segments; of these the first piece and bucket, in order."""
        at = np.flatnonzero(hit)
        name = np.stack([p.hash[at], p.whole[at]], axis=1)
        order = np.lexsort((name[:, 1], name[:, 0]))
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (name[order][1:] != name[order][:-1]).any(axis=1)
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(fresh) - 1
        source = at[order[fresh]]
        bucket = bucket_of(p.hash[source], buckets)
        order = np.lexsort((source, bucket))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return at, back[number], source[order], bucket[order]

    def windows(p: Pieces, spread: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """Starts of the windows of spread pieces, each one's number among the distinct; of these, in order of buckets: first start, hashes, bucket."""
        starts = gather(p.first[spread], p.count[spread])
        h, other = window_hashes(p.data, starts, width)
        number, one = least_of_equals(h, other)
        bucket = bucket_of(h[one], buckets)
        order = np.lexsort((one, bucket))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        one = one[order]
        return starts, back[number], starts[one], h[one], other[one], bucket[order]

    def ask_again(table: pa.Table, got: list, chunk: int, buckets: int) -> pa.Table:
        p = Pieces(table, seed, width)
        distinct, number = asked(p, buckets)
        said, where = np.zeros((2, len(distinct)), dtype=bool), dict(split_at((distinct >> U(32)).astype(np.int32)))
        for _, bucket, bits in got:
            for k in (0, 1):
                said[k][where[bucket]] = np.unpackbits(bits[k], count=where[bucket].stop - where[bucket].start)
        hit, spread = said[:, number]
        _, _, source, bucket = segments(p, hit & ~spread, buckets)
        doc = ids(table)
        of_bucket = {}
        for b, s in split_at(bucket):
            first, count = p.first[source[s]], p.count[source[s]]
            of_bucket[b] = (p.hash[source[s]].astype(np.uint32), count.astype(np.uint16), doc[p.doc[source[s]]], p.data[gather(first, count + width - 1)])
        _, _, start, h, other, bucket = windows(p, spread, buckets)
        holder = doc[np.searchsorted(p.offsets, start, side="right") - 1]
        none = (np.zeros(0, np.uint32), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.uint8))
        dealt_on = {b: (h[s], other[s], holder[s]) for b, s in split_at(bucket)}
        unspread = (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))
        out = [(b, chunk, (*of_bucket.get(b, none), *dealt_on.get(b, unspread))) for b in sorted({*of_bucket, *dealt_on})]
        return mail([*out, (-1 - chunk, chunk, (np.packbits(hit), np.packbits(spread)))])

    def answer_again(letters: list) -> list:
        """A bit for each window of a chunk's distinct segments, and for each window dealt on: it starts in a document before its own as well."""
        sizes = [len(x[2][0]) for x in letters]
        h, other, holder = (np.concatenate([x[2][k] for x in letters]) for k in (4, 5, 6))
        number, one = least_of_equals(h, other)
        least = np.full(len(one), NO_ID)
        np.minimum.at(least, number, holder)
        dealt_on = np.split(least[number] < holder, np.cumsum([len(x[2][4]) for x in letters])[:-1])
        name, count, doc, data = (np.concatenate([x[2][k] for x in letters]) for k in range(4))
        count = count.astype(np.int64)
        length = count + width - 1
        first = np.cumsum(length) - length
        own = [np.cumsum(n) - n for n in np.split(length, np.cumsum(sizes)[:-1])]
        whole = np.concatenate([spans_hash(BYTE_VALUE[x[2][3]], a, np.append(a[1:], len(x[2][3]))[: len(a)]) for x, a in zip(letters, own, strict=True)])
        order = np.lexsort((doc, whole, name))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (name[order][1:] != name[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        one = order[fresh]  # with the least doc of each distinct segment
        group = np.cumsum(np.diff(name[one], prepend=name[one][:1]) != 0)
        least = least_starts(data, first[one], count[one], doc[one], group, width)
        begins = np.cumsum(count[one]) - count[one]
        earlier = least[gather(begins[number], count)] < np.repeat(doc, count)
        windows = [int(x[2][1].sum(dtype=np.int64)) for x in letters]
        assert sum(sizes) == len(doc)
        parts = zip(letters, np.split(earlier, np.cumsum(windows)[:-1]), dealt_on, strict=True)
        return [(x[1], x[0], (np.packbits(a), np.packbits(b))) for x, a, b in parts]

    def decide(table: pa.Table, got: list, buckets: int) -> pa.Table:
        p, doc = Pieces(table, seed, width), ids(table)
        hit, spread = (np.unpackbits(x, count=len(p.first)).astype(bool) for x in next(x[2] for x in got if x[1] < 0))
        at, number, source, bucket = segments(p, hit & ~spread, buckets)
        count = p.count[source]
        begins, earlier = np.cumsum(count) - count, np.zeros(int(count.sum()), dtype=bool)
        where = dict(split_at(bucket))
        window, place, begin, _, _, their_bucket = windows(p, spread, buckets)
        before, where_on = np.zeros(len(begin), dtype=bool), dict(split_at(their_bucket))
        for _, b, bits in (x for x in got if x[1] >= 0):
            if b in where:
                n, start = int(count[where[b]].sum()), int(begins[where[b].start])
                earlier[start : start + n] = np.unpackbits(bits[0], count=n)
            if b in where_on:
                before[where_on[b]] = np.unpackbits(bits[1], count=where_on[b].stop - where_on[b].start)
        starts = gather(p.first[at], p.count[at])
        drop = earlier[gather(begins[number], p.count[at])]
        drop |= np.repeat(doc[p.doc[at]] > doc[p.doc[source]][number], p.count[at])
        holder = lambda places: doc[np.searchsorted(p.offsets, places, side="right") - 1]
        on = before[place] | (holder(window) > holder(begin)[place])
        first, end, cell = merged_runs(np.concatenate([starts[drop], window[on]]), width, p.offsets)
        removed = np.bincount(cell, weights=end - first, minlength=len(doc)).astype(np.int64)
        spans = np.bincount(cell, minlength=len(doc))
        of_doc = np.searchsorted(cell, np.arange(len(doc) + 1)).tolist()
        raw, kept = memoryview(p.data), []
        for k, (low, high) in enumerate(zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True)):
            runs_here = slice(of_doc[k], of_doc[k + 1])
            edges = zip([low, *end[runs_here].tolist()], [*first[runs_here].tolist(), high], strict=True)
            kept.append(b"".join(raw[x:y] for x, y in edges))
        texts = [x.decode(errors="ignore") for x in kept] if as_text else [None] * len(kept)
        return pa.Table.from_arrays(
            [table["doc_id"].cast(pa.int64()), pa.array(np.diff(p.offsets)), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary()), pa.array(texts, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"],
        )

    new = {"doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"}
    return two_rounds(docs, ask, answer, ask_again, answer_again, decide, SCHEMA, [c for c in docs.columns if c not in new] if as_text else [])
