"""Segments of a stream in the order of their index (ST06): a reorder buffer that doesn't wait for a gap forever."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "session string, position long, place long, after_gap boolean, body string"


class Buffer(StatefulProcessor):
    """The segments of a session that wait for earlier ones, the index that is due, and how many went out."""

    def __init__(self, patience_ms: int, first: int) -> None:
        self.patience_ms, self.first = patience_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "position long", "at_ms long, body string")
        self.due = handle.getValueState("due", "position long, place long")

    def released(self, key: tuple, due: int, place: int, after_gap: bool) -> list[tuple]:
        """What can go out from `due` on."""
        rows = []
        while self.waiting.containsKey((due,)):
            rows.append((key[0], due, place, after_gap and not rows, self.waiting.getValue((due,))[1]))
            self.waiting.removeKey((due,))
            due, place = due + 1, place + 1
        self.due.update((due, place))
        return rows

    def oldest(self) -> int | None:
        return min((at for at, _ in self.waiting.values()), default=None)

    def sent(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """The rows; the timer stands for the gap behind them, if segments wait there."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (oldest := self.oldest()) is not None:
            self.handle.registerTimer(oldest + self.patience_ms)
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, place = self.due.get() if self.due.exists() else (self.first, 0)
        for frame in rows:
            for position, at_ms, body in zip(frame["position"], frame["at_ms"], frame["body"], strict=True):
                # one that comes again, or after it was given up, goes nowhere; the first of equals counts
                if position >= due and not self.waiting.containsKey((int(position),)):
                    self.waiting.updateValue((int(position),), (int(at_ms), body))
        yield from self.sent(self.released(key, due, place, False))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Gaps are given up as long as what waits behind them has waited long enough: the next segment is due."""
        rows, now = [], max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        while (oldest := self.oldest()) is not None and oldest + self.patience_ms <= now:
            place = self.due.get()[1] if self.due.exists() else 0
            rows += self.released(key, min(k[0] for k in self.waiting.keys()), place, True)
        yield from self.sent(rows)

    def close(self) -> None:
        pass


def in_order(segments: DataFrame, session: str = "session_id", index: str = "index", at: str = "at", late: str = "1 minute", patience: int = 60, first: int = 0) -> DataFrame:
    """A stream's rows, each session's by rising index: session, index, place (from 0), after_gap, and `row`, the whole row.

    A row goes out once all earlier ones have, or once the stream's watermark is `patience` seconds past the time of the
    oldest that waits; then the missing ones are given up, the next has after_gap, and what comes of them later is left out.
    Rows without session, index or time are left out, and rows that are later than `late`. Needs the RocksDB state store; a session's waiting rows are its state.
    """
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in segments.columns]))
    rows = segments.filter(F.col(session).isNotNull() & F.col(index).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    sent = rows.select(F.col(session).cast("string").alias("session"), F.col(index).cast("long").alias("position"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"), body.alias("body"), F.col(at))
    found = sent.groupBy("session").transformWithStateInPandas(Buffer(patience * 1000, first), OUT, "Append", "EventTime")
    return found.select(F.col("session").cast(segments.schema[session].dataType).alias(session), F.col("position").alias(index), "place", "after_gap", F.from_json("body", segments.schema).alias("row"))
