"""Rate limiting by a sliding log, in batch and on streams (ST01-ST03), and streaming forms of C04 and K09."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Requests a minute by kind of endpoint.
LIMITS, WINDOW_US = {"chat": 30, "generation": 5, "auth": 10}, 60_000_000
OUT = "key string, kind string, request_id long, at long, allowed boolean, remaining int, retry_after int"
ANSWER = Row(*(x.split()[0] for x in OUT.split(", ")))


class Log:
    """The admitted requests of one key within the window; rejected ones leave no trace."""

    def __init__(self, limit: int, times: list[int] | None = None) -> None:
        self.limit, self.times = limit, deque(times or [])

    def ask(self, at: int) -> tuple[bool, int, int]:
        """Admitted, requests that remain, seconds to wait."""
        while self.times and self.times[0] <= at - WINDOW_US:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False, 0, int((WINDOW_US - (at - self.times[0])) // 1_000_000) + 1
        self.times.append(at)
        return True, self.limit - len(self.times), 0


def _prepared(requests: DataFrame, *more: str) -> DataFrame:
    return requests.select(*more, F.col("key").cast("string").alias("key"), "kind", F.col("request_id").cast("long").alias("request_id"), F.unix_micros(F.to_timestamp("ts")).alias("at")).filter(F.col("kind").isin(*LIMITS))


def limited(requests: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """ST01, ST02 in batch: (key, kind, request_id, ts) with the decision on each request.

    A log is empty after a pause of a whole window, so a key's requests are cut there, and no run knows of another: runs are
    dealt to tasks, however many one key has. Spark sorts each task's runs by time, and the task reads them batch by batch; it
    keeps one log, of `limit` times at most. Pauses are found by Spark's spilling window over a key.
    """
    order = Window.partitionBy("key", "kind").orderBy("at", "request_id")
    rows = _prepared(requests).withColumn("pause", (F.col("at") - F.lag("at").over(order) >= WINDOW_US).cast("long"))
    rows = rows.withColumn("run", F.coalesce(F.sum("pause").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    dealt = rows.drop("pause").repartition("key", "kind", "run").sortWithinPartitions("key", "kind", "run", "at", "request_id")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, now = Log(0), None
        for batch in batches:
            said = []
            for key, kind, at, run in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "at", "run")), strict=True):
                if (key, kind, run) != now:
                    log, now = Log(limits[kind]), (key, kind, run)
                said.append(log.ask(at))
            answers = zip(*said, strict=True) if said else ((), (), ())
            columns = [pa.array(x, t) for x, t in zip(answers, (pa.bool_(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "kind", "request_id", "at")), *columns], names=[x.split()[0] for x in OUT.split(", ")])

    return dealt.mapInArrow(decide, OUT)


class Limiter(StatefulProcessor):
    """The same decisions on a stream: the log of each key is kept as one value until no request can ask for it.

    Each call to the state store costs far more than a decision, so a batch of a key makes two, and a key has one timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.log = handle, handle.getValueState("log", "times array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        asked = sorted(((r["at"], r["request_id"]) for r in rows), key=lambda x: (x[0], x[1] is None, x[1] or 0))
        kept = self.log.get()
        log = Log(LIMITS[key[1]], kept[0] if kept is not None else [])
        said = [ANSWER(key[0], key[1], request, at, *log.ask(at)) for at, request in asked]
        self.log.update((list(log.times),))
        if kept is None:
            self.expire_at(log.times[-1])
        return iter(said)

    def expire_at(self, newest: int) -> None:
        """The log is of no use once the watermark is a window past its newest time."""
        self.handle.registerTimer((newest + WINDOW_US) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        newest = self.log.get()[0][-1]
        if (newest + WINDOW_US) // 1000 + 1 > expiredTimerInfo.getExpiryTimeInMs():  # requests have come since
            self.expire_at(newest)
        else:
            self.log.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ST01 on a streaming frame (needs the RocksDB state store): the decisions of `limited`, each key's requests coming in order of time.

    Requests later than `late` get no decision; in return a key without requests for that time and a window leaves the state.
    """
    # a watermark begins at the epoch and leaves out what isn't after it
    timed = requests.withColumn("seen", F.greatest(F.to_timestamp("ts"), F.timestamp_millis(F.lit(1)))).withWatermark("seen", late)
    rows = _prepared(timed, "seen").groupBy("key", "kind")
    return rows.transformWithState(Limiter(), OUT, "Append", "EventTime")


def first_of_stream(segments: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """C04 on a stream: the first event of each key; state older than the watermark is dropped."""
    return segments.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """An append-only sink that takes what has arrived and ends; run it again for more."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
