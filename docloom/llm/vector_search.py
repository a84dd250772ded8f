"""Approximate nearest neighbours with vantage-point trees.

`SCOUTS` of the vectors (those with the least hashes of vec_id) go to all tasks. The first of them are pivots, one for each
`SHARD_ROWS` vectors; every vector belongs to the shard of its nearest pivot, whose ball reaches to its farthest member. A
query's k-th nearest scout bounds how far it has to look, and it is sent only to shards whose balls come that near. Each
shard is a tree whose nodes halve their vectors by the distance from a vantage point; a half is skipped when the triangle
inequality puts all of it further away than the k-th best so far divided by `factor`: factor 1 gives exact results, larger
factors skip more. Shards are cut into parts of about `SHARD_ROWS` by their counted sizes, however alike their vectors are; a
part's tree is built once, and the queries sent to its shard stream through it, `QUERY_ROWS` at a time. Each query's best of
all parts are ranked at the end.

Empty cases: vectors that are null, zero, empty, or hold null or non-finite components take no part, nor does a null
vec_id; only vectors of the same length are compared; rows with the query's own vec_id are not its candidates; rows that
repeat a vec_id are candidates each by itself, but of queries that repeat one only that with the least vector asks; ties go
to the smaller vec_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_ROWS, TURN_ROWS, SCOUTS, LEAF, K = 20_000, 5_000, 200_000, 1_000, 256, 10
SENT = "dim int, shard int, part int, turn int, asks boolean, vec_id long, embedding array<double>, within double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of a and rows of b; components are added in order, as a plain sum would."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        step = a[:, k, None] - b[None, :, k]
        out += step * step
    return np.sqrt(out)


def rough(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows of a and rows of b by one matrix product, and how much they may be wrong by rounding."""
    size = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)
    return size - 2 * (a @ b.T), 1e-12 * size


class Tree:
    """A vantage-point tree over rows of `points`, with integer `names`."""

    def __init__(self, points: np.ndarray, names: np.ndarray) -> None:
        self.points, self.names = points, names
        self.top = self._grow(np.arange(len(points)), np.random.default_rng(7))

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple:
        if len(rows) <= LEAF:
            return (rows,)
        vantage = rows[rng.integers(len(rows))]
        d = distances(self.points[vantage][None], self.points[rows])[0]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return vantage, d[near[-1]], d[far[0]], self._grow(rows[near], rng), self._grow(rows[far], rng)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Names and distances of the k nearest of each query (infinite where there are fewer), without its own name.

        within: what lies further away than this need not be found.
        """
        best = np.full((len(queries), k), np.inf)
        name = np.full((len(queries), k), np.iinfo(np.int64).max)
        within = np.full(len(queries), np.inf) if within is None else within

        def leaf(rows: np.ndarray, q: np.ndarray) -> None:
            with np.errstate(over="ignore", invalid="ignore"):
                about, slack = rough(queries[q], self.points[rows])
                mine = self.names[rows] == own[q][:, None]
                about[mine] = np.inf
                most = np.minimum(best[q, k - 1], within[q]) ** 2 * (1 + 1e-12)
                if len(rows) > k:
                    most = np.minimum(most, np.partition(about + slack, k - 1, axis=1)[:, k - 1])
                # not "<=": what can't be compared is looked at as well
                i, j = np.nonzero(~(about - slack > most[:, None]) & ~mine)
            if not len(i):
                return
            d = np.zeros(len(i))
            for c in range(queries.shape[1]):  # components are added in order, as a plain sum would
                step = queries[q[i], c] - self.points[rows[j], c]
                d += step * step
            some = np.unique(i)
            who = np.concatenate([np.repeat(some, k), i])
            all_d, all_n = np.concatenate([best[q[some]].ravel(), np.sqrt(d)]), np.concatenate([name[q[some]].ravel(), self.names[rows[j]]])
            order = np.lexsort((all_n, all_d, who))
            first = np.searchsorted(who[order], some)[:, None] + np.arange(k)
            best[q[some]], name[q[some]] = all_d[order[first]], all_n[order[first]]

        def visit(node: tuple, q: np.ndarray) -> None:
            if not len(q):
                return
            if len(node) == 1:
                leaf(node[0], q)
                return
            vantage, inner, outer, near, far = node
            d = distances(queries[q], self.points[vantage][None])[:, 0]
            closer = d - inner <= outer - d
            visit(near, q[closer])
            visit(far, q[~closer])
            reach = np.minimum(best[q, k - 1], within[q]) / factor + 1e-9
            visit(far, q[closer & (outer - d <= reach)])
            visit(near, q[~closer & (d - inner <= reach)])

        visit(self.top, np.arange(len(queries)))
        return name, best


class Scouts:
    """The scouts of each length of vector, and the radii of the balls about the first of them, the pivots."""

    def __init__(self, rows: list[tuple[int, list[float]]], shards: int) -> None:
        self.shards, self.radius = shards, {}
        self.names, self.points = {}, {}
        for dim in {len(v) for _, v in rows}:
            some = [r for r in rows if len(r[1]) == dim]
            self.names[dim], self.points[dim] = np.array([r[0] for r in some]), np.array([r[1] for r in some])

    def home(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's shard, and its distance from the pivot; shard 0 where no pivot has its length."""
        dim = vectors.shape[1]
        if dim not in self.points:
            return np.zeros(len(vectors), np.int64), np.full(len(vectors), np.inf)
        pivots = self.points[dim][: self.shards]
        shard = rough(vectors, pivots)[0].argmin(axis=1)
        return shard, np.sqrt(((vectors - pivots[shard]) ** 2).sum(axis=1))

    def reached(self, query: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of query (by number) and shard to look into, and how far each query has to look."""
        dim = query.shape[1]
        if dim not in self.points:
            return np.arange(len(query)), np.zeros(len(query), np.int64), np.full(len(query), np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            d2, slack = rough(query, self.points[dim])
            high, low = np.sqrt(np.maximum(d2 + slack, 0)), np.sqrt(np.maximum(d2 - slack, 0))
            high[(self.names[dim] == own[:, None]) | np.isnan(high)] = np.inf
            within = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(query), np.inf)
            radius = np.array([self.radius.get((dim, s), -np.inf) for s in range(min(self.shards, len(self.names[dim])))])
            q, shard = np.nonzero(~(low[:, : len(radius)] - radius > within[:, None] / factor + 1e-9) & (radius >= 0))
        return q, shard, within


def matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The vectors of these rows, all of one length."""
    some = column.take(pa.array(rows))
    return np.array(some.flatten()).reshape(len(rows), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = 1.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (distance) for queries and vectors (vec_id, embedding)."""

    def usable(frame: DataFrame) -> DataFrame:
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        clean = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return clean.filter(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))

    spark, points = vectors.sparkSession, usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    shards = max(1, min(SCOUTS, -(-points.count() // SHARD_ROWS)))
    first = points.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SCOUTS).toArrow()
    scouts = Scouts(list(zip(first["vec_id"].to_pylist(), first["embedding"].to_pylist(), strict=True)), shards)
    sent = spark.sparkContext.broadcast(scouts)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, shard, far = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                shard[rows], far[rows] = sent.value.home(matrix(batch.column(1), rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(far)], names=["vec_id", "embedding", "dim", "shard", "far"])

    dealt = points.mapInArrow(homes, "vec_id long, embedding array<double>, dim int, shard int, far double")
    balls = dealt.groupBy("dim", "shard").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()  # SCOUTS rows for each length of vector that scouts have
    scouts.radius = {(r["dim"], r["shard"]): r["far"] * (1 + 1e-9) for r in balls if r["far"] < float("inf")}
    sent_with_radii = spark.sparkContext.broadcast(scouts)

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, own = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                q, shard, within = sent_with_radii.value.reached(matrix(batch.column(1), rows), own[rows], k, factor)
                at = pa.array(rows[q])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(shard.astype(np.int32)), pa.array(within[q])], names=["vec_id", "embedding", "dim", "shard", "within"]
                )

    asked = asked.select("vec_id", "embedding", "dim").mapInArrow(routes, "vec_id long, embedding array<double>, dim int, shard int, within double")
    # parts of a shard by its vectors; turns by its queries: only beyond TURN_ROWS queries does a part's tree stand in several tasks
    wanted = {(r["dim"], r["shard"]): r["count"] for r in asked.groupBy("dim", "shard").count().collect()}  # as many rows
    parts = {(r["dim"], r["shard"]): -(-r["n"] // SHARD_ROWS) for r in balls}
    plan = spark.createDataFrame([(d, s, p, -(-wanted.get((d, s), 1) // TURN_ROWS)) for (d, s), p in parts.items()], "dim int, shard int, parts int, turns int")
    plan = F.broadcast(plan)
    of = lambda c, n: F.pmod(F.xxhash64(c, F.lit(1)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    built = dealt.join(plan, ["dim", "shard"]).withColumn("part", of("vec_id", "parts")).withColumn("turn", each("turns")).withColumns({"asks": F.lit(False), "within": F.lit(None).cast("double")})
    asking = asked.join(plan, ["dim", "shard"]).withColumn("part", each("parts")).withColumn("turn", of("vec_id", "turns")).withColumn("asks", F.lit(True))
    names = [c.split()[0] for c in SENT.split(", ")]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(parts.values()))
    by = ["dim", "shard", "part", "turn"]
    met = built.select(names).unionByName(asking.select(names)).repartition(tasks, *by).sortWithinPartitions(*by, "asks")
    found = met.mapInArrow(lambda batches: answered(batches, k, factor), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Consecutive rows of one tree, vectors apart from queries: (dim, shard, part, turn), whether they ask, rows."""
    for batch in batches:
        key = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in key], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, np.int64)
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if b > a:
                yield tuple(int(x[a]) for x in key[:4]), bool(key[4][a]), batch.slice(a, b - a)


def answered(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """What the trees of a task answer: a tree's vectors come first, then its queries, which are searched as they come."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    now, held, tree = None, [], None
    for key, asks, rows in runs(batches):
        if key != now:
            now, held, tree = key, [], None
        names, points = rows.column(5).to_numpy(), matrix(rows.column(6), np.arange(rows.num_rows))
        if not asks:
            held.append((names, points))
            continue
        if not held:
            continue
        if tree is None:
            names_, points_ = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            order = np.argsort(names_, kind="stable")
            tree = Tree(points_[order], names_[order])
        within = rows.column(7).to_numpy(zero_copy_only=False) * (1 + 1e-9)
        for a in range(0, len(names), QUERY_ROWS):
            own = names[a : a + QUERY_ROWS]
            name, d = tree.search(points[a : a + QUERY_ROWS], own, k, factor, within[a : a + QUERY_ROWS])
            full = np.isfinite(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(own[:, None], d.shape)[full]), pa.array(name[full]), pa.array(d[full])], schema=schema)
