"""Vectors of Arrow columns as matrices (helpers used inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as rows."""
    chunks = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(chunks).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def places(column: pa.ChunkedArray) -> np.ndarray:
    """The place of each value among the sorted ones."""
    order = pc.sort_indices(column).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def totals(products: np.ndarray) -> np.ndarray:
    """Each row's sum, added up in the order of its components, so that equal rows give equal sums wherever they stand."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def cosines(a: np.ndarray, b: np.ndarray, squares_a: np.ndarray, squares_b: np.ndarray) -> np.ndarray:
    """Cosine similarity of a's rows and b's (or one row), as SQL computes it; 0 with a zero vector."""
    both = np.sqrt(squares_a * squares_b)
    return np.clip(np.divide(totals(a * b), both, out=np.zeros(len(a)), where=both > 0), -1, 1)


def firsts(k: int, *keys: np.ndarray) -> np.ndarray:
    """The places of the first k rows of each group in order; keys as in lexsort, the last one being the group."""
    order = np.lexsort(keys)
    group = keys[-1][order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(group)), bool), group[1:] != group[:-1]]))
    return order[np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group)))) < k]


def nearest(asking: np.ndarray, vectors: np.ndarray, keys: np.ndarray, groups: np.ndarray, k: int, held: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of each query's k most similar rows of each group, equal ones by key.

    Matrix products choose, `held` of them at once; what they leave within a margin for rounding is compared exactly. Of
    equal vectors in a group only the k of least key can be among the best.
    """
    if not len(asking) or not len(vectors):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    raw = np.ascontiguousarray(vectors)
    same = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    kept = firsts(k, keys, same + groups * (int(same.max()) + 1))
    kept = kept[np.argsort(groups[kept], kind="stable")]
    asking, vectors, keys, groups = asking.astype(float), vectors[kept].astype(float), keys[kept], groups[kept]
    squares, asked = totals(vectors * vectors), totals(asking * asking)
    unit = lambda x, sq: np.divide(x, np.sqrt(sq)[:, None], out=np.zeros_like(x), where=sq[:, None] > 0)
    units, directions = unit(vectors, squares), unit(asking, asked)
    edges = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1, append=groups[-1] + 1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(edges, edges[1:], strict=False):
        step = max(1, held // int(b - a))
        for i in range(0, len(asking), step):
            products = directions[i : i + step] @ units[a:b].T
            least = np.partition(products, -k, axis=1)[:, -k] - 1e-12 if b - a > k else np.full(len(products), -np.inf)
            who, at = np.nonzero(products >= least[:, None])
            who, at = who + i, at + a
            for c in range(0, len(who), step_pairs := max(1, held // asking.shape[1])):
                w, v = who[c : c + step_pairs], at[c : c + step_pairs]
                found.append((w, v, cosines(asking[w], vectors[v], asked[w], squares[v])))
    who, at, similarity = (np.concatenate(x) for x in zip(*found, strict=True))
    best_of = firsts(k, keys[at], -similarity, who * (int(groups[-1]) + 1) + groups[at])
    return who[best_of], kept[at[best_of]], similarity[best_of]
