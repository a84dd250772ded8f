"""Page layout: blocks and detections to text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import no_adjacent_repeats, stripped

LEAST_CONFIDENCE = 0.35
ROWS_A_TASK = 1_000_000
MOST_TASKS = 200  # beyond so many a shuffle holds the rows that it writes in memory, not in a file for each task


def block_markdown(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks in reading order with their Markdown and whether a paragraph begins there."""
    page = Window.partitionBy(*by)
    order = page.orderBy("y0", "x0")
    size = F.avg("font_size").over(page)
    words = F.regexp_count("text", F.lit(r"\S+"))
    shout = (F.upper("text") == F.col("text")) & F.col("text").rlike(r"\p{L}") & (words <= 10)
    mono = F.lower("font_name").rlike("mono|courier|consol")
    equation = F.col("text").rlike(r"[∑∫√≤≥≠≈∞∂∇]")
    kind = (
        F.when(mono, "code").when(F.col("font_size") > size * 1.5, "title").when((F.col("font_size") > size * 1.2) | F.col("is_bold") | shout, "heading").when(equation, "equation").otherwise("text")
    )
    rows = blocks.withColumn("kind", kind).withColumn("gap", F.col("y0") - F.lag("y1").over(order) > 1.5 * size)
    text = F.col("text")
    marked = F.when(F.col("kind") == "title", F.concat(F.lit("# "), text)).when(F.col("kind") == "heading", F.concat(F.lit("## "), text)).when(F.col("kind") == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(F.col("kind") == "equation", F.concat(F.lit("[EQUATION] "), text)).otherwise(text)
    return rows.withColumns({"markdown": marked, "pos": F.row_number().over(order) - 1, "new_paragraph": F.coalesce("gap", F.lit(False)) | F.col("kind").isin("title", "heading")}).drop("gap")


def without_noise(docs: DataFrame, by: str, more_than: int = 5, longest: int = 60) -> DataFrame:
    """Texts without short lines seen more than so often in them, and without repeated blank lines."""
    lines = docs.select(by, F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("bare", stripped(F.col("line")))
    times = F.count("*").over(Window.partitionBy(by, "bare"))
    stays = (F.col("bare") == "") | (F.length("bare") > longest) | (times <= more_than)
    before = F.last(F.when(F.col("stays"), F.col("bare")), ignorenulls=True).over(Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    kept = lines.withColumn("stays", stays).withColumn("stays", F.col("stays") & ((F.col("bare") != "") | (F.coalesce(before, F.lit("")) != "")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("stays"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return kept.groupBy(by).agg(F.coalesce(text, F.lit("")).alias("clean"))


def confident(detections: DataFrame, by: list[str], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """mean confidence in per cent of the detections that are sure enough."""
    return detections.filter(F.col("conf") >= least).groupBy(*by).agg((F.avg("conf") * 100).alias("confidence"), F.count("*").alias("n"))


def tasks_of(rows: DataFrame, each: int = ROWS_A_TASK) -> int:
    """To how many tasks rows are dealt: `each` rows to one, more only where there are over `MOST_TASKS` times as many."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, -(-rows.count() // each)))


def text_lines(detections: DataFrame, by: str = "page", least: float = LEAST_CONFIDENCE, tasks: int | None = None) -> DataFrame:
    """Lines of a page. A detection starts a new line when it is too far below the line's first one.

    Spark sorts each page's detections from the top down, once, and one pass over them remembers the line's first and gathers
    the line: a page of any length costs no memory but that of a line. Pages are dealt to so many `tasks` (`tasks_of`), so that
    one task's sort stays small; without a number Spark deals them by the settings of its shuffles.
    """
    kind = detections.schema[by].dataType.simpleString()
    number = {c: F.col(c).cast("double").alias(c) for c in ("y", "x", "bottom")}
    rows = detections.filter(F.col("conf") >= least).select(F.col(by).alias("of"), *number.values(), "text", F.col("page_height").alias("height"))
    dealt = rows.repartition(tasks, "of") if tasks else rows
    down = ("y", "x", "bottom", "text")
    page = Window.partitionBy("of").orderBy(*down).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order of the pass, which needs no other sort
    tolerance = F.greatest(F.lit(8), F.floor(F.max("height").over(page) * 0.025)).cast("double")

    def lines(batches: list[pa.RecordBatch], starts: list[int], numbers: list[int]) -> pa.RecordBatch:
        rows = pa.concat_batches(batches).slice(0, starts[-1])
        words = pa.StructArray.from_arrays([rows[c] for c in ("x", "text", "bottom")], names=["x", "text", "bottom"])
        first = pa.array(starts[:-1], pa.int32())
        return pa.RecordBatch.from_arrays([rows["of"].take(first), pa.array(numbers, pa.int32()), rows["y"].take(first), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words)], names=["of", "line", "top", "words"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, anchor, line = object(), None, -1
        held, n_held = [], 0  # rows of the line that isn't ended
        for batch in filter(len, batches):
            starts, numbers = ([0], [line]) if held else ([], [])
            for k, (of, y, apart) in enumerate(zip(batch["of"].to_pylist(), batch["y"].to_pylist(), batch["tolerance"].to_pylist(), strict=True), n_held):
                if of != page and (of == of or page == page):  # NaN is a page
                    page, anchor, line = of, None, -1
                if anchor is None or abs(y - anchor) > apart:
                    anchor, line = y, line + 1
                    starts.append(k)
                    numbers.append(line)
            held.append(batch)
            n_held += len(batch)
            if len(starts) > 1:
                yield lines(held, starts, numbers[:-1])
                held = [batch.slice(len(batch) - (n_held - starts[-1]))]
                n_held = len(held[0])
        if held:
            yield lines(held, [0, n_held], [line])

    ordered = dealt.withColumn("tolerance", tolerance).drop("height").sortWithinPartitions("of", *down)
    found = ordered.mapInArrow(placed, f"of {kind}, line int, top double, words array<struct<x:double,text:string,bottom:double>>")
    text = F.array_join(F.transform(F.sort_array("words"), lambda d: d["text"]), " ")
    return found.select(F.col("of").alias(by), "line", text.alias("text"), "top", F.array_max(F.transform("words", lambda d: d["bottom"])).alias("bottom"))


def line_paragraphs(lines: DataFrame, by: str = "page") -> DataFrame:
    """Lines with a flag for a new paragraph (the step down is over 1.5 times the upper median height) and headings marked."""
    order, height = Window.partitionBy(by).orderBy("line"), F.col("bottom") - F.col("top")
    # one sorted array a page, of which one number goes to its lines
    medians = lines.groupBy(F.col(by).alias("median_of")).agg(F.get(F.sort_array(F.collect_list(height)), F.floor(F.count(height) / 2).cast("int")).alias("median"))
    lines, median = lines.join(medians, F.col(by).eqNullSafe(F.col("median_of"))).drop("median_of"), F.col("median")
    capitals, all_letters = F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")), F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    words = F.regexp_count("text", F.lit(r"\S+"))
    heading = words.between(1, 7) & (F.length("text") < 80) & (all_letters > 0) & (capitals > all_letters * 0.7)
    return lines.withColumns({"new_paragraph": F.coalesce(F.col("top") - F.lag("top").over(order) > 1.5 * median, F.lit(False)), "markdown": F.when(heading, F.concat(F.lit("### "), F.col("text"))).otherwise(F.col("text"))}).drop("median")


def clean_lines(docs: DataFrame, by: str) -> DataFrame:
    """Printable text, lines seen before (in any case) and words repeated side by side removed."""
    printable = F.regexp_replace(F.regexp_replace("text", r"[^\P{C}\n\t]", ""), r"[ \t]+", " ")
    lines = docs.select(by, F.posexplode(F.split(printable, "\n", -1)).alias("pos", "line")).withColumn("line", stripped(F.col("line")))
    first = F.row_number().over(Window.partitionBy(by, F.lower("line")).orderBy("pos"))
    kept = lines.withColumn("nth", first).filter((F.col("nth") == 1) & (F.col("line") != "")).withColumn("words", F.split("line", " "))
    line = F.array_join(no_adjacent_repeats(F.col("words")), " ")
    return kept.withColumn("line", line).groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("clean"))


def assembled(pages: DataFrame, by: str) -> DataFrame:
    """Page texts in order, blank lines between; mean confidence over pages that have text."""
    full = F.filter(F.sort_array(F.collect_list(F.struct("page", "text", "confidence"))), lambda p: stripped(p["text"]) != "")
    return pages.groupBy(by).agg(F.array_join(F.transform(full, lambda p: p["text"]), "\n\n").alias("text"), F.avg(F.when(stripped(F.col("text")) != "", F.col("confidence"))).alias("confidence"))


def merged_tables(tables: DataFrame, by: list[str], most_gap: float = 50.0) -> DataFrame:
    """Neighbours on a page whose gap is small are merged in pairs, each table once: a fold over the page's tables."""
    kind = "array<struct<y0:double,y1:double,rows:array<array<string>>,last:boolean>>"
    start = F.array().cast(kind)

    def step(done: Column, t: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = (F.size(done) > 0) & ~F.coalesce(last["last"], F.lit(True)) & (t["y0"] - last["y1"] < most_gap)
        both = F.struct(last["y0"].alias("y0"), t["y1"].alias("y1"), F.concat(last["rows"], t["rows"]).alias("rows"), F.lit(True).alias("last"))
        one = F.struct(t["y0"].alias("y0"), t["y1"].alias("y1"), t["rows"].alias("rows"), F.lit(False).alias("last"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(one)))

    ordered = F.sort_array(F.collect_list(F.struct(F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1"), "rows")))
    return tables.groupBy(*by).agg(F.aggregate(ordered, start, step).alias("t")).select(*by, F.posexplode("t").alias("pos", "t")).select(*by, "pos", "t.y0", "t.y1", "t.rows")
