"""State changes as rewrites of tables (D01-D09, W14, M16, ST10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import lookup, minutes_before

# Share done in per cent by status.
PROGRESS = {"pending": 0, "processing": 10, "ocr_running": 30, "transcribing": 30, "embedding": 70, "completed": 100, "failed": 100}
ITERATIONS, CALLS, TOKENS, RETRIES = 7, 10, 12_000, 2


def oldest_pending(jobs: DataFrame) -> DataFrame:
    """The oldest pending job of each type."""
    first = Window.partitionBy("job_type").orderBy("created_at", "id")
    return jobs.filter("status = 'pending'").withColumn("n_th", F.row_number().over(first)).filter("n_th = 1").drop("n_th")


def claim(jobs: DataFrame, now: Column) -> DataFrame:
    """All jobs, of which each type's oldest pending one is now in work."""
    picked = oldest_pending(jobs).select("id", F.lit(True).alias("picked"))
    rows = jobs.join(picked, "id", "left")
    return rows.withColumns({"status": F.when(F.col("picked"), "processing").otherwise(F.col("status")), "updated_at": F.when(F.col("picked"), now).otherwise(F.col("updated_at"))}).drop("picked")


def recover(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Jobs in work for longer than so many minutes are pending again, with a note."""
    stuck = (F.col("status") == "processing") & (F.col("updated_at") < minutes_before(now, minutes))
    return jobs.withColumn("error", F.when(stuck, F.lit("recovered: no progress")).otherwise(F.col("error") if "error" in jobs.columns else F.lit(None).cast("string"))).withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))


def latest(events: DataFrame, key: str, at: str, tie: str | None = None) -> DataFrame:
    """The last event of each key is its state; of several at one time the least by `tie`, then by a hash of the row."""
    order = [F.desc(at), *([F.col(tie)] if tie else []), F.xxhash64(*[F.col(f"`{c}`") for c in events.columns])]
    return events.withColumn("n_th", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("n_th = 1").drop("n_th")


def use_once(tokens: DataFrame, presented: DataFrame) -> DataFrame:
    """Presented unused tokens become used; a used one that is presented again takes its whole family away."""
    shown = tokens.join(presented.select("token_hash").distinct(), "token_hash", "left_semi")
    burnt = shown.filter("used").select("family").distinct()
    rest = tokens.join(burnt, "family", "left_anti").join(presented.select("token_hash").distinct().withColumn("shown", F.lit(True)), "token_hash", "left")
    return rest.withColumn("used", F.col("used") | F.coalesce("shown", F.lit(False))).select(*tokens.columns)


def unexpired(rows: DataFrame, now: Column, at: str = "expires_at") -> DataFrame:
    """D06"""
    return rows.filter(F.col(at) >= now)


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true (unknown ones stay)."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def reindex(materials: DataFrame, chunker: Callable[[DataFrame], DataFrame], key: str = "material_id") -> tuple[DataFrame, DataFrame]:
    """Chunks of all completed materials with text, and counts by outcome."""
    usable = (F.col("status") == "completed") & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    chunks = chunker(materials.filter(usable))
    outcome = materials.join(chunks.select(key).distinct().withColumn("chunked", F.lit(True)), key, "left").withColumn("outcome", F.when(F.col("chunked"), "reindexed").when(usable, "failed").otherwise("skipped"))
    return chunks, outcome.groupBy("outcome").agg(F.count("*").alias("n"))


def progress_of(status: Column) -> Column:
    """M16"""
    return F.coalesce(lookup(status, PROGRESS), F.lit(0))


def agent_runs(steps: DataFrame, by: str = "run_id", order: str = "step") -> DataFrame:
    """ST10: runs folded over their steps (tokens, ok): where each stopped, and why.

    A failed step is tried again up to RETRIES times in a row; then it is skipped. Limits end a run.
    """
    start = F.struct(*[F.lit(0).alias(x) for x in ("iterations", "calls", "tokens", "failures", "skipped")], F.lit("running").alias("state"))

    def step(s: Column, x: Column) -> Column:
        on = s["state"] == "running"
        iterations, calls, tokens = s["iterations"] + 1, s["calls"] + 1, s["tokens"] + x["tokens"]
        failures = F.when(x["ok"], F.lit(0)).otherwise(s["failures"] + 1)
        give_up = failures > RETRIES
        state = F.when(calls >= CALLS, "call limit").when(tokens >= TOKENS, "token limit").when(iterations >= ITERATIONS, "iteration limit").otherwise("running")
        new = F.struct(iterations.alias("iterations"), calls.alias("calls"), tokens.alias("tokens"), F.when(give_up, F.lit(0)).otherwise(failures).alias("failures"), (s["skipped"] + give_up.cast("int")).alias("skipped"), state.alias("state"))
        return F.when(on, new).otherwise(s)

    # no run goes beyond ITERATIONS steps: only these are gathered
    steps = steps.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("nth") <= ITERATIONS)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(order, F.col("tokens").cast("int").alias("tokens"), "ok"))), lambda x: F.struct(x["tokens"].alias("tokens"), x["ok"].alias("ok")))
    return steps.groupBy(by).agg(F.aggregate(ordered, start, step).alias("run")).select(by, "run.*")
