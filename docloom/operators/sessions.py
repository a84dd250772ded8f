"""Conversations and sessions: nested children, as-of and range joins, running sums, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capitalized


def nested(parents: DataFrame, children: DataFrame, on: str, order: list[str], name: str, fields: list[str] | None = None) -> DataFrame:
    """Parents with their children as an ordered array, empty without any; children are gathered before the join."""
    fields = fields or [c for c in children.columns if c != on]
    each = F.struct(*order, F.struct(*fields).alias("item"))
    grouped = children.groupBy(on).agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["item"]).alias(name))
    kind = grouped.schema[name].dataType
    return parents.join(grouped, on, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def first_n(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("n_th", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("n_th") <= n).drop("n_th")


def exists_in(rows: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Rows with a flag whether their key occurs."""
    return rows.join(keys.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def in_order_of(rows: DataFrame, wanted: DataFrame, ids: str, key: str, *by: str) -> DataFrame:
    """rows in the order of an id list (column `ids` of one row, or of one for each of `by`); repeats in the list stay."""
    return wanted.select(*by, F.posexplode(ids).alias("pos", key)).join(rows, key).orderBy(*by, "pos")


def as_of(points: DataFrame, starts: DataFrame, by: str, at: str, start: str, value: str, floor_first: bool = False) -> DataFrame:
    """Each point gets the value of the last start at or before it; null before the first, or with floor_first its value.

    One union and one window per group, so that it needs no range join.
    """
    marks = starts.select(by, F.col(start).alias("at_"), F.lit(0).alias("kind_"), F.struct(F.col(value).alias("v")).alias("mark_"))
    rest = points.select(by, F.col(at).alias("at_"), F.lit(1).alias("kind_"), F.struct(*points.columns).alias("row_"))
    both = marks.unionByName(rest, allowMissingColumns=True)
    seen = Window.partitionBy(by).orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("found_", F.last("mark_", ignorenulls=True).over(seen))
    if floor_first:
        both = both.withColumn("found_", F.coalesce("found_", F.first("mark_", ignorenulls=True).over(Window.partitionBy(by).orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return both.filter("kind_ = 1").select("row_.*", F.col("found_")["v"].alias(value))


def in_ranges(ranges: DataFrame, points: DataFrame, by: str, start: str, at: str) -> DataFrame:
    """Ranges (from their start to the next one's) with the sorted points in them: an as-of join turned around."""
    found = as_of(points.select(by, F.col(at).alias("point_")), ranges.select(by, start), by, "point_", start, start)
    grouped = found.filter(F.col(start).isNotNull()).groupBy(by, start).agg(F.sort_array(F.collect_list("point_")).alias("points"))
    return ranges.join(grouped, [by, start], "left").withColumn("points", F.coalesce("points", F.array().cast(grouped.schema["points"].dataType)))


def starts(rows: DataFrame, by: str, order: str, length: Column, name: str = "start_time", digits: int | None = None) -> DataFrame:
    """Sum of the lengths before each row of its group."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(F.coalesce(length, F.lit(0))).over(before), F.lit(0))
    return rows.withColumn(name, F.round(total, digits) if digits is not None else total)


def next_index(rows: DataFrame, by: str, index: str) -> DataFrame:
    """The index that follows the largest."""
    return rows.groupBy(by).agg(F.coalesce(F.max(index) + 1, F.lit(0)).alias("next_index"))


def history(messages: DataFrame, by: str, order: str, n: int = 10, role: str = "role", text: str = "text") -> DataFrame:
    """The last n messages of each conversation as lines `Role: text`."""
    last = first_n(messages, by, [F.desc(order)], n)
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, role, text))), lambda m: F.concat(capitalized(m[role]), F.lit(": "), m[text]))
    return last.groupBy(by).agg(F.array_join(lines, "\n").alias("history"))


def preview(messages: DataFrame, by: str, order: str, n: int = 3, most: int = 200, text: str = "text") -> DataFrame:
    """The first n messages, each cut."""
    head = first_n(messages, by, [F.col(order)], n)
    return head.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda m: F.substring(m[text], 1, most)), " ").alias("preview"))


def first_seen(rows: DataFrame, value: str, order: list[str], most: int | None = None) -> DataFrame:
    """The first row of each value, in order, `most` in all."""
    kept = first_n(rows, value, [F.col(c) for c in order], 1).orderBy(*order)
    return kept.limit(most) if most is not None else kept


def new_rows(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored yet."""
    return rows.join(stored.select(key), key, "left_anti")


def without_children_of(gone: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the rows of deleted parents."""
    return [t.join(gone.select(key), key, "left_anti") for t in tables]


def speakers(segments: DataFrame, by: str, order: str, allowed: tuple[str, ...] = ("host", "guest")) -> DataFrame:
    """Segments numbered from 0; an unknown speaker alternates between the two."""
    rows = segments.withColumn("segment_index", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    return rows.withColumn("speaker", F.when(F.col("speaker").isin(*allowed), F.col("speaker")).when(F.col("segment_index") % 2 == 0, allowed[0]).otherwise(allowed[1]))


def numbered_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Repeats of a name get _1, _2, ..."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return rows.withColumn("unique_name", F.when(k == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), k.cast("string"))))


def k_th_equal(left: DataFrame, right: DataFrame, value: str, left_order: str, right_order: str) -> DataFrame:
    """The k-th row of a value on the left with the k-th on the right."""
    number = lambda t, o: t.withColumn("k_", F.row_number().over(Window.partitionBy(value).orderBy(o)))
    return number(left, left_order).join(number(right, right_order), [value, "k_"]).drop("k_")


def export(session: DataFrame, chapters: DataFrame, segments: DataFrame, bookmarks: DataFrame, annotations: DataFrame, doubts: DataFrame, key: str = "session_id") -> DataFrame:
    """One JSON document for each session: chapters, segments (chapter as of their index, bookmark, notes) and doubts."""
    rows = as_of(segments, chapters.select(key, F.col("start").alias("start_"), F.col("title").alias("chapter")), key, "index", "start_", "chapter")
    rows = exists_in(rows, bookmarks, [key, "index"], "bookmarked")
    notes = annotations.groupBy(key, "index").agg(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "note"))), lambda x: F.struct(x["note"].alias("note"), x["created_at"].alias("created_at"))).alias("annotations"))
    rows = rows.join(notes, [key, "index"], "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(notes.schema["annotations"].dataType)))
    out = nested(session, chapters, key, ["start"], "chapters", ["title", F.col("start").alias("startSegment"), "summary"])
    out = nested(out, rows, key, ["index"], "segments", ["index", "speaker", "text", "duration_ms", "chapter", "bookmarked", "annotations"])
    out = nested(out, doubts, key, ["paused_at_segment"], "doubts", ["paused_at_segment", "question", "answer"])
    meta = [c for c in session.columns]
    return out.select(key, F.to_json(F.struct(F.struct(*meta).alias("session_metadata"), "chapters", "segments", "doubts")).alias("json"))


def children_of(rows: DataFrame, parents: DataFrame, on: str, where: Column) -> DataFrame:
    """Rows whose parent satisfies a condition."""
    return rows.join(parents.filter(where).select(on), on, "left_semi")


def with_ancestors(rows: DataFrame, *links: tuple[DataFrame, str]) -> DataFrame:
    """Rows with their parent's columns, and the parent's parent's, along (table, key) links."""
    for table, key in links:
        rows = rows.join(table, key)
    return rows


def zipped(left: DataFrame, right: DataFrame, by: str, order: str, how: str = "inner") -> DataFrame:
    """Rows of both sides that stand at the same place of their group."""
    place = lambda t: t.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).drop(order)
    return place(left).join(place(right), [by, "place"], how)


def merged(*results: DataFrame) -> DataFrame:
    """Results of several searches one after the other, marked by their number."""
    marked = [r.withColumn("angle", F.lit(i)) for i, r in enumerate(results)]
    out = marked[0]
    for r in marked[1:]:
        out = out.unionByName(r)
    return out


def missing_from(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows that weren't chosen, repeats counted."""
    return rows.exceptAll(chosen)


def drafts(materials: DataFrame, notebook: str = "notebook_id", wanted: str | None = "draft") -> DataFrame:
    """materials of one notebook, of none (draft), or all (None)."""
    if wanted is None:
        return materials
    return materials.filter(F.col(notebook).isNull() if wanted == "draft" else F.col(notebook) == wanted)


def in_index_order(results: DataFrame, by: str, index: str) -> DataFrame:
    """Results that came in any order, by group and index; the sort is a range partitioning."""
    return results.repartitionByRange(by, index).sortWithinPartitions(by, index)


def ready_prefix(segments: DataFrame, by: str, index: str, done: str) -> DataFrame:
    """ST06: of each group the segments that can be played already, up to the first that isn't done."""
    upto = F.min(F.when(~F.coalesce(F.col(done), F.lit(False)), F.col(index))).over(Window.partitionBy(by))
    return segments.withColumn("first_gap", upto).filter(F.col("first_gap").isNull() | (F.col(index) < F.col("first_gap"))).drop("first_gap")


def without_status(rows: DataFrame, status: str, excluded: list[str]) -> DataFrame:
    """Rows whose status isn't one of these; unknown ones stay."""
    return rows.filter(~F.coalesce(F.col(status).isin(*excluded), F.lit(False)))
