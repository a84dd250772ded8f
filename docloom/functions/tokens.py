"""Token counts, tokens and budgets by a byte-pair vocabulary.

A vocabulary is a file of ranks: a line with a token in base64 and its rank, tokens being merged in the order of ranks. It is
read through Spark, from any store, is bounded by MOST_BYTES and goes to the tasks with the functions; texts are counted in
Arrow batches. Vocabularies are public files; none is learned here.

Words of over LONG bytes are merged with a heap, in n log n steps, since merging by scans takes the square of their length.
"""

from __future__ import annotations

import base64
import heapq
import re as plain_re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: How byte-level vocabularies of this kind cut a text into words before merging: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_BYTES, LONG = 64_000_000, 1_000


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of one word: the pair of least rank is merged, the earlier one among equals, until none has a rank."""
    n = len(word)
    after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    rank = lambda i: ranks.get(word[i : i + size[i] + size[after[i]]]) if after[i] < n else None
    heap = [(r, i, 1, 1) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if size[i] else n
        if size[i] != a or j >= n or size[j] != b:  # one of the two has changed since
            continue
        size[i], size[j], after[i] = a + b, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, size[k], size[after[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : i + size[i]]])
        i = after[i]
    return out


_coders: dict[tuple, _Coder] = {}


class _Coder:
    """A vocabulary ready for use, once in each worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.words = ranks, regex.compile(pattern)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.long = plain_re.compile(rf"\S{{{LONG // 4},}}|\s{{{LONG // 4},}}")

    @staticmethod
    def of(lines: bytes, pattern: str) -> _Coder:
        key = hash(lines), pattern
        if key not in _coders:
            _coders.clear()  # one at a time
            _coders[key] = _Coder({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}, pattern)
        return _coders[key]

    def tokens(self, text: str) -> np.ndarray:
        if not self.long.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).view(np.int32)
        out = []
        for word in self.words.findall(text):
            raw = word.encode("utf-8", "replace")
            out += merged(raw, self.ranks) if len(raw) > LONG else self.fast.encode_ordinary(word)
        return np.array(out, np.int32)

    def text(self, tokens: list[int]) -> str:
        return self.fast.decode(tokens)


def each(column: pa.Array) -> Iterator:
    """The values of a column one by one, so that no batch stands whole as Python objects."""
    return (x.as_py() for x in column)


class Vocabulary:
    """Functions of columns that count and cut texts by its tokens. Null texts have null tokens and no count."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = PATTERN) -> None:
        lines = spark.read.text(path)
        if lines.agg(F.coalesce(F.sum(F.octet_length("value").cast("long") + 1), F.lit(0))).first()[0] > MOST_BYTES:
            raise ValueError(f"a vocabulary has at most {MOST_BYTES} bytes")
        self.lines, self.pattern = "\n".join(r[0] for r in lines.collect()).encode(), pattern
        _Coder.of(self.lines, pattern)  # an unfit file fails here
        self.shared = spark.sparkContext.broadcast(self.lines)

    def _function(self, kind: str, do: Callable[[_Coder, pa.Array], pa.Array]) -> Callable[[Column], Column]:
        """A function of a column, batch by batch."""
        shared, pattern = self.shared, self.pattern

        @F.arrow_udf(kind)
        def run(column: pa.Array) -> pa.Array:
            return do(_Coder.of(shared.value, pattern), column)

        return run

    def encoded(self, c: Column) -> Column:
        def lists(coder: _Coder, texts: pa.Array) -> pa.Array:
            parts = [coder.tokens(x) if x is not None else None for x in each(texts)]
            sizes = np.array([0 if x is None else len(x) for x in parts], np.int64)
            flat = np.concatenate([np.zeros(0, np.int32), *[x for x in parts if x is not None]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([x is None for x in parts]))

        return self._function("array<int>", lists)(c)

    def decoded(self, c: Column) -> Column:
        return self._function("string", lambda coder, lists: pa.array([None if x is None else coder.text(x) for x in each(lists)], pa.string()))(c)

    def count(self, c: Column) -> Column:
        """The number of tokens; none of a null text."""
        return F.coalesce(self._function("bigint", lambda coder, texts: pa.array([None if x is None else len(coder.tokens(x)) for x in each(texts)], pa.int64()))(c), F.lit(0).cast("long"))

    def count_each(self, c: Column) -> Column:
        """The numbers of tokens of the texts of an array."""
        return self._function("array<bigint>", lambda coder, lists: pa.array([None if x is None else [len(coder.tokens(t or "")) for t in x] for x in each(lists)], pa.list_(pa.int64())))(c)

    def cut(self, c: Column, most: int) -> Column:
        """The text's longest beginning of at most `most` tokens that ends between characters."""

        def beginning(coder: _Coder, text: str) -> str:
            return b"".join(coder.fast.decode_tokens_bytes(coder.tokens(text)[:most].tolist())).decode("utf-8", "ignore")

        return self._function("string", lambda coder, texts: pa.array([None if x is None else beginning(coder, x) for x in each(texts)], pa.string()))(c)
