"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Sizes are words. Source weights share the total; no source takes more than `most` times its size, and what it can't take
goes to the others by weight. Each source's weight follows a schedule of (time, multiplier) knots over training time
[0, 1], scaled to a mean of one, so that the schedule shapes when a source is read and not how much. A document's place in
its source's running demand (documents in the order of a hash, as often as the target asks) is inverted through the
integral of the schedule: that is its training position, and the mix is range-sorted by it. Each reading of a document has a
position of its own. The document at which a source reaches its target gives only the words still wanted.

Running sums never put one source into one task: documents fall into `SLICES` slices by hash, slices are summed over the
source, and only a slice's documents are ordered together.

Empty cases: null or blank texts have size 0 and are taken 0 times; a null source is a source of its own, last in order;
a null doc_id is ordered by its text; a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS, MOST, SLICES = (5, 2, 1), 3, 1024
#: Schedules by turns of the source's rank: falling, steady, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def size_of(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, rank (from 0), target: from (source, source_size), one row for each source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1)
    # water level: sources fill up in the order of most * size / weight; those below the level stop at their limit
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    level = ranked.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    level = level.withColumn("below", F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    level = level.withColumn("open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    whole = Window.partitionBy()
    level = level.withColumn("level", (F.sum("source_size").over(whole) - F.col("below")).cast("double") / F.col("open"))
    level = level.withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    last = F.max(F.when(~F.col("full"), -F.col("below").cast("double"))).over(whole)  # the first that is not full
    at = F.max(F.when(~F.col("full") & (-F.col("below").cast("double") == last), F.col("level"))).over(whole)
    level = level.withColumn("at", at)
    return level.select("source", "source_size", "rank", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("at") * F.col("weight")).alias("target"))


def position(share: Column, rank: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which the schedule's integral reaches `share` of its whole."""
    out = None
    for k, knots in enumerate(schedules):
        area = sum((t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False))
        inverse, done = F.lit(1.0), []
        upto = 0.0
        for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False):
            part = (t1 - t0) * (m0 + m1) / 2 / area
            rest, slope = (share - F.lit(upto)) * F.lit(area), (m1 - m0) / (t1 - t0)
            # m0 * x + slope / 2 * x ** 2 = rest, in the form that holds for slope 0 as well
            x = rest * 2 / (F.lit(m0) + F.sqrt(F.greatest(F.lit(m0 * m0) + rest * (2 * slope), F.lit(0.0))))
            done.append((upto + part, F.lit(t0) + F.least(F.greatest(x, F.lit(0.0)), F.lit(t1 - t0))))
            upto += part
        for end, value in reversed(done):
            inverse = F.when(share <= F.lit(end), value).otherwise(inverse)
        out = inverse if out is None else F.when(F.pmod(rank, F.lit(len(schedules))) == k, inverse).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, schedules: tuple = SCHEDULES) -> DataFrame:
    """Every document with size, source_size, target, taken, its first training position (null if it isn't taken) and readings.

    Readings are (position, words), one for each time that the document is read. Columns of docs stay, but for those named
    like the new ones or `words`.
    """
    new = {"size", "source_size", "target", "taken", "position", "readings", "words"}
    kept = [c for c in docs.columns if c not in new]
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    old = [F.col(c).alias(f"old_{i}") for i, c in enumerate(kept)]
    rows = docs.select(*old, F.col("source").alias("source"), size_of(F.col("text")).alias("size"), order.alias("order"), F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("slice", (F.conv(F.substring("order", 1, 3), 16, 10).cast("int") * SLICES / 4096).cast("int"))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("ahead", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)))
    plan = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, most)
    plan = slices.select(F.col("source").alias("in_source"), F.col("slice").alias("in_slice"), "ahead").join(plan, F.col("in_source").eqNullSafe(F.col("source"))).drop("source")
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("slice") == F.col("in_slice")))
    inner = Window.partitionBy("source", "slice").orderBy("order", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    # a source's demand runs over its documents again and again; this document's words come at start, start + source_size, ...
    wanted = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    part = lambda turn: F.greatest(F.lit(0), F.least(F.col("size"), wanted - F.col("start") - F.col("source_size") * turn))
    taken = sum((part(turn) for turn in range(1, most)), part(0))
    placed = placed.withColumn("taken", taken.cast("long"))
    where = lambda turn: position(F.least((F.col("start") + F.col("source_size") * turn) / F.col("target"), F.lit(1.0)), F.col("rank"), schedules)
    each = F.array(*[F.when(part(turn) > 0, F.struct(where(turn).alias("position"), part(turn).cast("long").alias("words"))) for turn in range(most)])
    placed = placed.withColumns({"position": F.when(F.col("taken") > 0, where(0)), "readings": F.filter(each, lambda x: x.isNotNull())})
    return placed.select(*[F.col(f"old_{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target", "taken", "position", "readings")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The readings of the taken documents with their own position and words, range-sorted by position."""
    others = [F.col(f"`{c}`") for c in mixed.columns if c not in ("position", "readings")]
    read = mixed.filter("taken > 0").select(*others, F.inline("readings"))
    return read.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def in_order(mixed: DataFrame) -> DataFrame:
    """Every document once, range-sorted by its first position; those that aren't taken come last."""
    by = [F.col("position").asc_nulls_last(), F.col("doc_id").asc()]
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by)
