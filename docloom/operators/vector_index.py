"""A persisted index of vectors: inverted lists around centroids.

Centroids are k-means of a sample; every vector is written to the list of its nearest centroid, lists being the partition
column of a table. A search compares queries with centroids, and a semi-join on the partition column lets Spark read only
the lists that some query probes (dynamic partition pruning); filters on owners go to the same scan. Queries and the
vectors of their lists meet in cells, as matrix products; a query goes once to each cell that has lists of its, with their
numbers, and only its best k leave a cell.

Lists are cut into parts of about PART_ROWS rows by their measured size, so that a list of any size, equal vectors
included, is no larger group; parts are dealt to cells of about as many rows in turn. Queries come in blocks of
BLOCK_QUERIES. Centroids, and the lists' radii and sizes, are bounded by MOST_LISTS rows and are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.records import dot
from .matrices import firsts, matrix, nearest, places

#: Rows of the sample and of a part, most lists, queries of a block, and products held at once.
SAMPLE, PART_ROWS, MOST_LISTS, BLOCK_QUERIES, HELD = 100_000, 50_000, 16_384, 50_000, 4_000_000


def unit(c: Column) -> Column:
    """The vector at length one; null where it has no direction (null, zero, holding null or non-finite numbers)."""
    wide = c.cast("array<double>")
    length = F.sqrt(dot(wide, wide))
    sound = F.coalesce((length > 0) & (length < float("inf")), F.lit(False)) & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x))
    # the length is a lambda's variable, else it would be computed again for each number
    return F.when(sound, F.element_at(F.transform(F.array(length), lambda one: F.transform(wide, lambda x: x / one)), 1))


def ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def assigned(rows: DataFrame, centers: np.ndarray, numbers: list[int]) -> DataFrame:
    """rows (with `unit`) with the list of each vector, its nearest centroid's, and the distance to that."""

    @F.arrow_udf("struct<list:int,distance:double>")
    def nearest(units: pa.Array) -> pa.Array:
        step, lists, units = max(1, HELD // len(centers)), np.array(numbers, np.int32), matrix(pa.chunked_array([units]))
        products = [units[i : i + step] @ centers.T for i in range(0, len(units), step)]
        near = [lists[x.argmax(axis=1)] for x in products] or [lists[:0]]
        far = [np.sqrt(np.maximum(0, 2 - 2 * x.max(axis=1))) for x in products] or [np.zeros(0)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(near)), pa.array(np.concatenate(far))], names=["list", "distance"])

    return rows.withColumn("found", nearest("unit")).withColumns({"list": F.col("found.list"), "distance": F.col("found.distance")}).drop("found")


def chooser(centers: np.ndarray, radii: np.ndarray, numbers: list[int], n: int) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    """For each query of a batch the places of the n lists nearest to it, and of all that can hold a vector within its reach."""
    order = np.array(numbers)

    def choose(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        asking, reach = matrix(pa.chunked_array([batch["query"]])), batch["reach"].to_numpy(zero_copy_only=False)
        for i in range(len(asking)):
            if not len(order):
                yield np.zeros(0, np.int64)
                continue
            near = np.sqrt(np.maximum(0, 2 - 2 * (centers @ asking[i])))
            chosen = near - radii <= reach[i] + 1e-9  # a margin for rounding
            chosen[np.lexsort((order, near))[:n]] = True
            yield np.flatnonzero(chosen)

    return choose


class VectorIndex:
    """The index at a path that all executors reach: `centroids` (list, centroid, radius, parts) and `lists`, partitioned by list."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id") -> None:
        self.spark, self.path, self.key = spark, path, key
        self.centroids = spark.read.parquet(f"{path}/centroids")
        self.lists = spark.read.schema(spark.read.text(f"{path}/schema").first()[0]).parquet(f"{path}/lists")
        known = self.centroids.orderBy("list").collect()  # MOST_LISTS rows
        self.numbers, self.parts, self.radii = [r["list"] for r in known], [r["parts"] for r in known], np.array([r["radius"] for r in known])
        self.centers = np.array([r["centroid"] for r in known])

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, key: str = "vec_id", embedding: str = "embedding", owner: list[str] | None = None, seed: int = 7) -> VectorIndex:
        """Index every vector that has a direction. Rows of a part are sorted by `owner`, so that a filter on it skips row groups.

        Lists are as many as the root of the number of vectors unless given. Vectors must have one width. The path must be new.
        """
        spark = vectors.sparkSession
        rows = vectors.withColumn("unit", unit(F.col(embedding))).filter("unit IS NOT NULL")
        n = rows.count()
        lists = max(1, min(lists or round(n**0.5), MOST_LISTS, n))
        share = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < max(1, SAMPLE * 1_000_000 // max(n, SAMPLE))
        points = rows.filter(share).select(array_to_vector("unit").alias("features"))
        model = KMeans(k=lists, seed=seed, maxIter=10).fit(points) if n else None
        centers = np.array([c / (np.linalg.norm(c) or 1.0) for c in model.clusterCenters()]) if model else np.zeros((1, 1))
        every = assigned(rows, centers, list(range(len(centers)))).persist()  # for the sizes, then for the rows
        sizes = every.groupBy("list").agg(F.max("distance").alias("radius"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
        known = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "list int, centroid array<double>")
        known.join(sizes, "list").coalesce(1).write.parquet(f"{path}/centroids")  # MOST_LISTS rows
        parts = F.broadcast(spark.read.parquet(f"{path}/centroids").select("list", "parts"))
        placed = every.join(parts, "list").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts", "distance")
        placed = placed.select(*[F.col(f"`{c}`") for c in placed.columns if c != "list"], "list")
        width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS))
        placed.repartition(width, "list", "part").sortWithinPartitions("list", "part", *(owner or []), key).write.partitionBy("list").parquet(f"{path}/lists")
        spark.createDataFrame([(ddl(placed),)], "schema string").coalesce(1).write.text(f"{path}/schema")
        every.unpersist()
        return cls(spark, path, key)

    def add(self, vectors: DataFrame, embedding: str = "embedding") -> VectorIndex:
        """Append vectors with new keys to their lists; the centroids stay, the radii follow. An empty index must be built anew."""
        rows = vectors.withColumn("unit", unit(F.col(embedding))).filter("unit IS NOT NULL")
        every = assigned(rows, self.centers, self.numbers).persist()
        far = {r["list"]: r["far"] for r in every.groupBy("list").agg(F.max("distance").alias("far")).collect()}  # MOST_LISTS rows
        wider = [(i, [float(x) for x in c], max(float(r), far.get(i, 0.0)), p) for i, c, r, p in zip(self.numbers, self.centers, self.radii, self.parts, strict=True)]
        # radii first: a search between the writes reads too many lists, never too few
        self.spark.createDataFrame(wider, self.centroids.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        known = F.broadcast(self.spark.createDataFrame([(i, p) for i, _, _, p in wider], "list int, parts int"))
        placed = every.join(known, "list").withColumn("part", F.pmod(F.xxhash64(self.key), F.col("parts")).cast("int"))
        placed.select(*[F.col(f"`{c}`") for c in self.lists.columns]).repartition("list", "part").write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")
        every.unpersist()
        return VectorIndex(self.spark, self.path, self.key)

    def probes(self, queries: DataFrame, n: int) -> DataFrame:
        """(query_id, query, list, parts) of the n lists nearest to each query (query_id, query, reach), and of all that can hold a vector within its reach."""
        kind = queries.schema["query_id"].dataType.simpleString()
        choose, numbers, parts = chooser(self.centers, self.radii, self.numbers, n), np.array(self.numbers, np.int32), np.array(self.parts, np.int32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = list(choose(batch))
                lengths = np.array([len(x) for x in at], np.int64)
                ends, flat = pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), np.concatenate([*at, np.zeros(0, np.int64)])
                pairs = pa.StructArray.from_arrays([pa.array(numbers[flat]), pa.array(parts[flat])], names=["list", "parts"])
                yield pa.RecordBatch.from_arrays([batch["query_id"], batch["query"], pa.ListArray.from_arrays(ends, pairs)], names=["query_id", "query", "lists"])

        found = queries.select("query_id", "query", "reach").mapInArrow(run, f"query_id {kind}, query array<double>, lists array<struct<list:int,parts:int>>")
        return found.select("query_id", "query", F.inline("lists"))

    def dealt(self, queries: DataFrame, n: int, cells: int) -> DataFrame:
        """(query_id, query, cell, lists): each query once for each cell that holds parts of its lists, with those lists."""
        kind = queries.schema["query_id"].dataType.simpleString()
        choose, numbers, parts = chooser(self.centers, self.radii, self.numbers, n), np.array(self.numbers, np.int64), np.array(self.parts, np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, at in enumerate(choose(batch)):
                    wanted = np.repeat(numbers[at], parts[at])
                    part = np.arange(len(wanted)) - np.repeat(np.cumsum(parts[at]) - parts[at], parts[at])
                    pairs = np.unique(np.stack([(wanted + part) % cells, wanted], axis=1), axis=0)
                    cell, starts = np.unique(pairs[:, 0], return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(pairs)), pa.int32()), pa.array(pairs[:, 1], pa.int32()))
                    same = pa.array(np.full(len(cell), i))
                    yield pa.RecordBatch.from_arrays([batch["query_id"].take(same), batch["query"].take(same), pa.array(cell, pa.int32()), lists], names=["query_id", "query", "cell", "lists"])

        return queries.select("query_id", "query", "reach").mapInArrow(run, f"query_id {kind}, query array<double>, cell int, lists array<int>")

    def probed(self, probes: DataFrame, where: Column | None = None) -> DataFrame:
        """The rows of the lists that some query probes, and that meet a filter."""
        wanted = F.broadcast(probes.filter("list >= 0").select("list").distinct())  # MOST_LISTS rows; Spark prunes by a side with a filter
        rows = self.lists.filter(where) if where is not None else self.lists
        return rows.join(wanted, "list", "left_semi")

    def compared(self, asked: DataFrame, probes: int, k: int, where: Column | None, blocks: int, cells: int, columns: list[str] | None) -> DataFrame:
        """Each query's k best of every cell of the lists it probes."""
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        dealt = self.dealt(asked, probes, cells).withColumn("block", block)
        rows = self.probed(self.probes(asked, probes), where).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))
        kept = [f for f in self.lists.schema if f.name not in ("unit", "list", "part") and (columns is None or f.name in (*columns, self.key))]
        names = [f"kept_{i}" for i in range(len(kept))]  # whatever the columns are called
        cell = F.pmod(F.col("list") + F.col("part"), F.lit(cells)).cast("int")
        rows = rows.select(cell.alias("cell"), "block", "list", "unit", *[F.col(f"`{f.name}`").alias(name) for f, name in zip(kept, names, strict=True)])
        key = names[[f.name for f in kept].index(self.key)]
        schema = ", ".join([f"query_id {asked.schema['query_id'].dataType.simpleString()}", *(f"{name} {f.dataType.simpleString()}" for f, name in zip(kept, names, strict=True)), "similarity double"])

        def meet(_: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
            units, asking, order = matrix(vectors["unit"]), matrix(queries["query"]), places(vectors[key])
            of = vectors["list"].to_numpy()
            lists = pa.chunked_array(queries["lists"].chunks, pa.list_(pa.int32()))
            wanted = np.concatenate([*(x.flatten().to_numpy(zero_copy_only=False) for x in lists.chunks), np.zeros(0, np.int32)])
            whose = np.repeat(np.arange(len(queries)), np.concatenate([*(x.value_lengths().to_numpy(zero_copy_only=False) for x in lists.chunks), np.zeros(0, np.int32)]))
            by_row, by_query = np.argsort(of, kind="stable"), np.argsort(wanted, kind="stable")
            rows_of, queries_of, n_held = of[by_row], wanted[by_query], 0
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

            def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                who, at, similarity = (np.concatenate(x) for x in zip(*held, strict=True))
                first = firsts(k, order[at], -similarity, who)
                return who[first], at[first], similarity[first]

            for number in np.unique(of):
                mine = by_row[np.searchsorted(rows_of, number) : np.searchsorted(rows_of, number, "right")]
                asks = whose[by_query[np.searchsorted(queries_of, number) : np.searchsorted(queries_of, number, "right")]]
                who, at, similarity = nearest(asking[asks], units[mine], order[mine], np.zeros(len(mine), np.int64), k, HELD)
                held.append((asks[who], mine[at], similarity))
                n_held += len(who)
                if n_held > HELD // 2:  # the best so far, so that what is held doesn't grow with the lists
                    held, n_held = [merged()], 0
            who, at, similarity = merged()
            found = vectors.select(names).take(pa.array(at))
            return pa.Table.from_arrays([queries["query_id"].take(pa.array(who)), *found.columns, pa.array(similarity)], names=["query_id", *names, "similarity"])

        met = rows.groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")).applyInArrow(meet, schema)
        return met.select("query_id", *[F.col(name).alias(f.name) for f, name in zip(kept, names, strict=True)], "similarity")

    def search(self, queries: DataFrame, k: int, probes: int = 8, where: Column | None = None, exact: bool = False, columns: list[str] | None = None) -> DataFrame:
        """The k rows most like each query (query_id, query): columns of the indexed rows, similarity (cosine) and rank.

        `probes` lists are read for each query. exact: then those too that can hold a row as near as the k-th best found, so
        that none is missed. Queries without a direction find nothing; equal similarities go by key. `columns`: those of the
        rows that are wanted beside the key, all if not given; each query's finds carry them through a shuffle.
        """
        asked = queries.select("query_id", unit(F.col("query")).alias("query"), F.lit(-1.0).alias("reach")).filter("query IS NOT NULL")
        blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
        cells = max(1, -(-self.lists.count() // PART_ROWS), min(self.spark.sparkContext.defaultParallelism, sum(self.parts)))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), self.key))
        if exact:
            seen = self.compared(asked, probes, k, where, blocks, cells, []).withColumn("rank", rank).filter(F.col("rank") == k)
            reach = seen.select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("found"))
            # a query that found fewer than k reaches every list
            asked = asked.join(reach, "query_id", "left").select("query_id", "query", F.coalesce("found", F.lit(9.0)).alias("reach"))
        found = self.compared(asked, probes, k, where, blocks, cells, columns)
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)
