"""Table profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.NumericType,)
QUARTERS = (0.25, 0.5, 0.75)


def _numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, NUMERIC)


def missing(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    return c.isNull() | F.isnan(c) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def null_counts(rows: DataFrame) -> DataFrame:
    """A10: column, nulls; NaN counts as null."""
    one = rows.agg(*[F.count_if(missing(f)).alias(f.name) for f in rows.schema])
    return one.unpivot([], one.columns, "column", "nulls")


def describe(rows: DataFrame) -> DataFrame:
    """Column, stat, value (as text) for every column.

    Numeric columns have count, mean, std, min, exact quartiles and max; others count, unique, top (first by name of equals)
    and freq. One aggregation gives what needs no order. The rest works on the distinct values of all columns together,
    (column, value, times), counted by one shuffle: quartiles are read from running counts over them (`ranked_quartiles`),
    top and freq from one group for each column. No buffer holds a column's values.
    """
    wanted: list[Column] = []
    numbers, texts = [f for f in rows.schema if _numeric(f)], [f for f in rows.schema if not _numeric(f)]
    for f in rows.schema:
        c = F.when(~missing(f), F.col(f"`{f.name}`"))
        stats = {"count": F.count(c)}
        if _numeric(f):
            x = c.cast("double")
            stats |= {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        wanted += [F.struct(F.lit(f.name).alias("column"), F.lit(k).alias("stat"), v.cast("string").alias("value")) for k, v in stats.items()]
    out = rows.agg(F.array(*wanted).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    if numbers:
        pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.when(~missing(f), F.col(f"`{f.name}`").cast("double")).alias("v")) for f in numbers])
        counts = rows.select(F.inline(pairs)).filter("v IS NOT NULL").groupBy("column", "v").agg(F.count("*").alias("times"))
        quartiles = ranked_quartiles(counts)
        empty = rows.sparkSession.createDataFrame([(f.name, f"{int(q * 100)}%") for f in numbers for q in QUARTERS], "column string, stat string")
        out = out.unionByName(empty.join(quartiles, ["column", "stat"], "left"))
    if texts:
        pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.when(~missing(f), F.col(f"`{f.name}`").cast("string")).alias("v")) for f in texts])
        counts = rows.select(F.inline(pairs)).groupBy("column", "v").agg(F.count("*").alias("times"))
        there = F.col("v").isNotNull()
        best = counts.groupBy("column").agg(
            F.count("v").cast("string").alias("unique"), F.min_by("v", F.when(there, F.struct(-F.col("times"), F.col("v")))).alias("top"), F.max(F.when(there, F.col("times"))).cast("string").alias("freq")
        )
        out = out.unionByName(best.select("column", F.explode(F.create_map(F.lit("unique"), "unique", F.lit("top"), "top", F.lit("freq"), "freq")).alias("stat", "value")))
    return out


def sliced(counts: DataFrame, by: list[str], v: Column, slices: int, slot: str) -> DataFrame:
    """counts with the slice of each row's v between the least and greatest of its group, a row of `by`."""
    ends = counts.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high"))
    share = (v - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * slices
    return counts.join(F.broadcast(ends), by).withColumn(slot, F.least(F.floor(share), F.lit(slices - 1)).cast("int")).drop("low", "high")


def ranked_quartiles(counts: DataFrame, slices: int = 1024) -> DataFrame:
    """column, stat, value: exact quartiles, between ranks in proportion, of (column, v, times).

    Values fall into slices of equal width on a logarithmic scale, so that single far values, infinite ones too, don't push all
    others into one slice; slices that hold a wanted rank are cut again, evenly between their own ends. Only sums of slices go
    over a column, and only the small slices that hold a wanted rank are ordered value by value.
    """
    flat = F.signum("v") * F.least(F.log1p(F.abs("v")), F.lit(1000.0))
    n = counts.groupBy("column").agg(F.sum("times").alias("n"))  # a row for each column
    rank = F.explode(F.array(*[F.struct(F.lit(f"{int(q * 100)}%").alias("stat"), F.lit(q).alias("q"), F.lit(up).alias("up")) for q in QUARTERS for up in (0, 1)]))
    wanted = n.withColumn("a", rank).select("column", "n", "a.*").withColumn("rank", F.least(F.floor(F.col("q") * (F.col("n") - 1)) + F.col("up"), F.col("n") - 1))

    def holding(dealt: DataFrame, asked: DataFrame, slot: str, inside: list[str]) -> DataFrame:
        """The wanted ranks with the slice that holds each; rank counts from the slice on."""
        sums = dealt.groupBy("column", *inside, slot).agg(F.sum("times").alias("held"))
        upto = F.sum("held").over(Window.partitionBy("column", *inside).orderBy(slot))  # `slices` rows
        sums = sums.withColumn("before", upto - F.col("held"))
        found = sums.join(F.broadcast(asked), ["column", *inside]).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("held")))
        return found.withColumn("rank", F.col("rank") - F.col("before")).drop("before", "held")

    dealt = sliced(counts, ["column"], flat, slices, "slot")
    coarse = holding(dealt, wanted, "slot", [])
    within = dealt.join(F.broadcast(coarse.select("column", "slot").distinct()), ["column", "slot"], "left_semi")
    within = sliced(within, ["column", "slot"], flat, slices, "fine")
    fine = holding(within, coarse, "fine", ["slot"])
    found = within.join(F.broadcast(fine), ["column", "slot", "fine"])
    place = F.sum("times").over(Window.partitionBy("column", "slot", "fine", "stat", "up").orderBy("v"))
    found = found.withColumn("end", place).filter((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("times")))
    both = found.groupBy("column", "stat", "q", "n").agg(F.min_by("v", "up").alias("a"), F.max_by("v", "up").alias("b"))
    part = F.col("q") * (F.col("n") - 1) - F.floor(F.col("q") * (F.col("n") - 1))
    return both.select("column", "stat", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part).cast("string").alias("value"))


def shape(rows: DataFrame) -> DataFrame:
    """Rows, columns."""
    return rows.agg(F.count("*").alias("rows"), F.lit(len(rows.columns)).alias("columns"))


def kinds(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Column, type, position; needs no scan."""
    return spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(rows.dtypes)], "column string, type string, pos int")


def head_and_tail(rows: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First and last rows by an order, marked; two top-n selections."""
    first = rows.orderBy(*order).limit(n).withColumn("end", F.lit("head"))
    last = rows.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("end", F.lit("tail"))
    return first.unionByName(last)


def summary_text(spark: SparkSession, rows: DataFrame, label: str, order: list[str], n: int = 5, full: bool = False) -> DataFrame:
    """One text with the table's label, shape, columns, types and first rows; `full` adds the statistics of describe and the last rows."""
    shown = F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]).alias("line")
    joined = lambda found, key: found.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "line"))), lambda x: x["line"]), "\n").alias("lines"))
    sample = lambda by: joined(rows.orderBy(*by).limit(n).select(F.struct(*order).alias("o"), shown), "o")
    lines = sample(order)
    head = F.concat(F.lit(f"{label}\nShape: "), F.col("rows").cast("string"), F.lit(f" rows x {len(rows.columns)} columns\nColumns: {', '.join(rows.columns)}\nTypes: {', '.join(f'{a}={b}' for a, b in rows.dtypes)}\n\n"))
    text = F.concat(head, F.coalesce("lines", F.lit("")))
    whole = shape(rows).crossJoin(lines)  # one row each
    if full:
        place = F.array_position(F.array(*map(F.lit, rows.columns)), F.col("column"))
        stats = describe(rows).select(F.struct(place.alias("p"), "stat").alias("o"), F.concat("column", F.lit(" "), "stat", F.lit(": "), F.coalesce("value", F.lit(""))).alias("line"))  # some rows a column
        last = sample([F.desc(c) for c in order]).withColumnRenamed("lines", "last")
        whole = whole.crossJoin(joined(stats, "o").withColumnRenamed("lines", "stats")).crossJoin(last)
        text = F.concat(head, F.lit("Statistics:\n"), F.coalesce("stats", F.lit("")), F.lit(f"\n\nSample (first {n} rows):\n"), F.coalesce("lines", F.lit("")), F.lit(f"\n\nSample (last {n} rows):\n"), F.coalesce("last", F.lit("")))
    return whole.select(text.alias("summary"))


def cell_statistics(tables: DataFrame, cells: str = "rows") -> DataFrame:
    """Size, empty cells and their share, a guess at a header row, validity, for tables given as arrays of rows."""
    flat = F.flatten(F.col(cells))
    empty = F.size(F.filter(flat, lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""))
    total = F.greatest(F.size(flat), F.lit(1))
    first = F.get(F.col(cells), 0)
    header = F.coalesce(F.forall(first, lambda x: ~F.coalesce(x, F.lit("")).rlike(r"^\s*[\d.,%-]*\s*$")), F.lit(False))
    return tables.withColumns(
        {"n_rows": F.size(cells), "n_columns": F.coalesce(F.array_max(F.transform(F.col(cells), F.size)), F.lit(0)), "empty_cells": empty, "empty_ratio": empty / total, "has_header": header}
    ).withColumn("valid", (F.col("n_rows") >= 2) & (F.col("n_columns") >= 2) & (F.col("empty_ratio") < 0.5))


def frequent(rows: DataFrame, by: list[str], value: str, more_than: int, longest: int) -> DataFrame:
    """Short values seen more than so often in their group."""
    return rows.filter(F.length(value) <= longest).groupBy(*by, value).agg(F.count("*").alias("times")).filter(F.col("times") > more_than)


def otsu(histogram: DataFrame) -> DataFrame:
    """The level (0-255) that parts a histogram (level, n) with the largest variance between its classes."""
    below = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # 256 rows at most
    whole = Window.partitionBy()
    rows = histogram.groupBy("level").agg(F.sum("n").alias("n"))
    rows = rows.withColumns({"w0": F.sum("n").over(below), "s0": F.sum(F.col("n") * F.col("level")).over(below), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("level")).over(whole)})
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.when(F.col("w") > F.col("w0"), F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * gap * gap).otherwise(F.lit(0.0))
    return rows.agg(F.min_by("level", F.struct(-between, F.col("level"))).alias("threshold"))
