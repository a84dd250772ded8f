"""SimHash near-dedup with BK-trees.

A fingerprint has a bit set where over half of the text's 4-word shingles' hashes have it. Two fingerprints within
`radius` bits of each other agree on two of radius + 2 blocks of bits, so the distinct fingerprints are dealt by each pair
of blocks, and those with the same pair make a BK-tree: children are keyed by their integer distance from the parent, and
a search follows only edges within the radius. The trees of a task are built and searched together, level by level. They
are dealt out rather than broadcast, since a broadcast tree of all fingerprints would grow with the corpus.

A pair of blocks that very many fingerprints share is dealt in parts: part i is built once and the parts j >= i search it.
The number of tasks follows the number of fingerprints, and a task reads its trees one portion after the other. Each task
keeps a spanning forest of the links it finds, and the forests are joined to components.

Empty cases: null text counts as empty; texts of 1 to 3 words have one shingle; texts without words have fingerprint zero
and are linked like any other; a null doc_id stays null and names no component unless its group has no other id; equal
texts have one fingerprint and cost one search, however many there are; rows that repeat a doc_id are rows of their own,
whose groups are one if their fingerprints link; a text is read whole, however long; columns other than doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, cut
from .textbytes import text_bytes

SHINGLE, RADIUS, PART, TASK_ROWS, PORTION = 4, 4, 2_000, 500_000, 200_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    found = text.translate(LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k, hashed = min(shingle, len(found)), xxhash.xxh64_intdigest
    h = np.array([hashed(line[a:b], 42) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=">u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, row_hash): one row for each row of docs; fp is the fingerprint's 64 bits as a signed number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw = data.tobytes()
            fps = [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), batch.column(2)], names=["doc_id", "fp", "row_hash"])

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("row_hash")).mapInArrow(each, "doc_id long, fp long, row_hash long")


def block_keys(radius: int) -> list[tuple[int, int]]:
    """(number, mask) of each pair of the radius + 2 blocks of bits."""
    cuts = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(k, a | b) for k, (a, b) in enumerate(combinations(masks, 2))]


class Forest:
    """BK-trees, one for each key; nodes are indices of fps, children are looked up by (parent, distance)."""

    def __init__(self, fps: np.ndarray, tree: np.ndarray) -> None:
        order = np.argsort(tree, kind="stable")
        fresh = np.diff(tree[order], prepend=tree[order][:1] - 1) != 0
        root = order[fresh]
        self.fps, self.trees, self.root = fps, tree[root], root
        rest = order[~fresh]
        parent = np.repeat(root, np.diff(np.append(np.flatnonzero(fresh), len(order))) - 1)
        slots, nodes = [], []
        while len(rest):
            slot = parent * 65 + np.bitwise_count(fps[rest] ^ fps[parent]).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            rest, slot = rest[order], slot[order]
            fresh = np.diff(slot, prepend=-1) != 0
            slots.append(slot[fresh])
            nodes.append(rest[fresh])
            below = np.repeat(rest[fresh], np.diff(np.append(np.flatnonzero(fresh), len(slot))) - 1)
            rest, parent = rest[~fresh], below
        slot = np.concatenate([np.zeros(0, np.int64), *slots])
        order = np.argsort(slot)
        self.slot, self.node = slot[order], np.concatenate([np.zeros(0, np.int64), *nodes])[order]
        self.visited = 0  # pairs of query and node that searches compared

    def near(self, query: np.ndarray, tree: np.ndarray, radius: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, in portions of bounded size."""
        root = np.searchsorted(self.trees, tree)
        found = (root < len(self.trees)) & (self.trees[np.minimum(root, len(self.trees) - 1)] == tree)
        todo = [(np.flatnonzero(found), self.root[root[found]])]
        while todo:
            q, node = todo.pop()
            if len(q) > most:
                todo += [(q[most:], node[most:]), (q[:most], node[:most])]
                continue
            self.visited += len(q)
            d = np.bitwise_count(query[q] ^ self.fps[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.slot, node * 65 + np.maximum(d - radius, 0))
            size = np.searchsorted(self.slot, node * 65 + np.minimum(d + radius, 64), side="right") - low
            if size.any():
                begins = np.cumsum(size) - size
                todo.append((np.repeat(q, size), self.node[np.arange(int(size.sum())) + np.repeat(low - begins, size)]))


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the least vertex that the pairs link each to (those that are not the least themselves)."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def whole_trees(batches: Iterator[pa.RecordBatch], portion: int = PORTION) -> Iterator[pa.Table]:
    """Rows in the order of `tree`, about `portion` at a time and never a part of a tree."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= portion:
            table = pa.Table.from_batches(held)
            cut = int(np.searchsorted(table["tree"].to_numpy(), table["tree"][-1].as_py()))  # where the last tree begins
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def links(distinct: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """Edges (a, b) between ids of (id, fp) that connect whatever a chain of links within the radius connects."""
    masks = block_keys(radius)
    keyed = distinct.select("id", "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for k, m in masks])).alias("key")).select("id", "fp", "key.*")
    sizes = keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    # part i of a large tree is joined by itself and every later part
    parts = F.ceil(F.col("n") / part).cast("int")
    own: Column = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = keyed.join(sizes.select("k", "bits", parts.alias("parts")), ["k", "bits"]).withColumn("own", own)
    sent = dealt.select("id", "fp", "k", "bits", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    sent = sent.select("id", "fp", F.xxhash64("k", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("tree"), (F.col("own") <= F.col("other")).alias("built"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_trees(batches):
            ids, fps, tree = (table[c].to_numpy() for c in ("id", "fp", "tree"))
            built = table["built"].to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids, fps, tree, built = ids[order], fps[order].view(np.uint64), tree[order], built[order]
            keep = np.flatnonzero(built)
            forest = Forest(fps[keep], tree[keep])
            distinct, number = np.unique(ids, return_inverse=True)
            a, b = spanning(((number[q], number[keep[node]]) for q, node in forest.near(fps, tree, radius)), len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(distinct[a]), pa.array(distinct[b])], names=["a", "b"])

    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), distinct.count() * len(masks) // TASK_ROWS)
    return sent.repartition(tasks, "tree").sortWithinPartitions("tree").mapInArrow(search, "a long, b long")


def simhash(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links lead to); also group_key, which tells groups apart even where doc_id doesn't, and row_hash (of doc_id and text)."""
    spark = docs.sparkSession
    each = cut(spark, fingerprints(docs, shingle))
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    label = components(spark, links(distinct.select(F.col("fp").alias("id"), "fp"), radius)).withColumnRenamed("id", "fp")
    groups = distinct.join(label, "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("group_key"))
    names = groups.groupBy("group_key").agg(F.min("first_id").alias("component_id"))
    groups = groups.join(names, "group_key").select("fp", "group_key", "component_id")
    return each.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_key", "row_hash")
