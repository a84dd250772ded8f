"""Lines of pages: one sort, one shuffle, and the same lines however the rows are cut into batches."""

import math
import random

from pyspark.sql import functions as F

from docloom.operators import layout

SCHEMA = "page double, page_height int, x double, y double, bottom double, text string, conf double"


def plain_lines(rows):
    """A page's detections from the top down; a new line where one is over the tolerance below the line's first."""
    pages, found = {}, []
    for page, height, x, y, bottom, text, conf in rows:
        if conf >= layout.LEAST_CONFIDENCE:
            pages.setdefault(repr(page), []).append((height, x, y, bottom, text))
    for page, own in pages.items():
        apart = max(8, math.floor(max(r[0] for r in own) * 0.025))
        lines, anchor = [], None
        for _, x, y, bottom, text in sorted(own, key=lambda r: (r[2] is not None, r[2] or 0, *(r[k] for k in (1, 3, 4)))):
            if anchor is None or y - anchor > apart:
                anchor = y
                lines.append((y, []))
            lines[-1][1].append((x, text, bottom))
        found += [(page, k, " ".join(t for _, t, _ in sorted(words)), top, max(b for _, _, b in words)) for k, (top, words) in enumerate(lines)]
    return sorted(map(repr, found))


def detections():
    dice = random.Random(25)
    pages = [float(k) for k in range(12)] + [None, float("nan")]
    rows = []
    for k in range(400):
        y = float(dice.randrange(400))
        rows.append((dice.choice(pages), dice.choice((300, 1000)), float(dice.randrange(5)), y if k % 40 else None, y + dice.randrange(20), f"w{k}", dice.choice((0.2, 0.35, 0.9))))
    return rows + [(99.0, 1000, float(k), 5.0, 9.0, f"v{k:02}", 0.9) for k in range(30)]  # a line of many batches


def test_lines_are_the_same_in_batches_of_any_size(spark):
    rows = detections()
    frame, want = spark.createDataFrame(rows, SCHEMA), plain_lines(rows)
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            for tasks in (None, 3):
                got = layout.text_lines(frame, tasks=tasks)
                assert sorted(repr((repr(r.page), r.line, r.text, r.top, r.bottom)) for r in got.collect()) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert layout.text_lines(frame.limit(0)).collect() == []


def test_lines_take_one_sort_and_one_shuffle(spark):
    """A second sort of the same rows and hash tables of lines were half of a task's memory."""
    frame = spark.createDataFrame(detections(), SCHEMA).filter("NOT isnan(page)").withColumn("page", F.col("page").cast("long"))
    for tasks in (None, 3):
        plan = layout.text_lines(frame, tasks=tasks)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1 and "Aggregate" not in plan


def test_tasks_follow_the_rows(spark):
    parallel = spark.sparkContext.defaultParallelism
    assert layout.tasks_of(spark.range(10), 1) == max(10, parallel)
    assert layout.tasks_of(spark.range(0), 1) == parallel
    assert layout.tasks_of(spark.range(1000), 1) == layout.MOST_TASKS
