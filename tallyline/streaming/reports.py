"""Reports at an hour and answers to commands, as streams with state.

State and timers are those of ``transformWithState``, which keeps them in RocksDB: ``with_state`` sets the provider where
a session has another one.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIGURES = ("total", "success", "error")
DAY = timedelta(days=1)
#: Commands that are answered with the status.
COMMANDS = ("/status", "/stats")


def with_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _utc(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC)


def _ms(at: datetime) -> int:
    return round(at.timestamp() * 1000)


class DailyReports(StatefulProcessor):
    """A target's reports. State: hours not reported yet, added up by the report that first counts them, and the sums of those reported.

    One timer a target waits for its next report and sets the following one, so a target without calls is reported too.
    """

    def __init__(self, key: str, hour: int):
        self.key, self.hour = key, hour

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        sums = ", ".join(f"{f} bigint" for f in FIGURES)
        self.waiting = handle.getMapState("waiting", "at bigint", f"{sums}, {', '.join(f'today_{f} bigint' for f in FIGURES)}")
        self.reported = handle.getValueState("reported", f"at bigint, {sums}")

    def report_of(self, start: datetime) -> datetime:
        """The first report after the hour that begins at ``start``."""
        at = start.replace(hour=self.hour, minute=0, second=0, microsecond=0)
        return at if start < at else at + DAY

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reported = self.reported.get()
        done = reported[0] if reported else None
        new: dict[int, list[int]] = {}
        for frame in rows:
            for ms, *figures in zip(frame["start_ms"].tolist(), *(frame[f].tolist() for f in FIGURES), strict=True):
                start = _utc(ms)
                at = self.report_of(start)
                if done is not None and _ms(at) <= done:  # of a report that is out: the next one sums it
                    at = _utc(done) + DAY
                same_day = at.date() == start.date()
                held = new.setdefault(_ms(at), [0] * 6)
                for i, n in enumerate(figures):
                    held[i] += n
                    held[i + 3] += n * same_day
        for ms, held in new.items():
            before = self.waiting.getValue((ms,)) or (0,) * 6
            self.waiting.updateValue((ms,), tuple(a + b for a, b in zip(before, held, strict=True)))
        # Before the first report an earlier hour may still come in: the timer moves back.
        timers = list(self.handle.listTimers())
        first = min(new) if done is None else done + _ms(DAY + _utc(0))
        if not timers or first < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All reports up to the watermark: several where the stream has jumped over days."""
        at, now, out = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), []
        reported = self.reported.get()
        sums, waiting = list(reported[1:]) if reported else [0, 0, 0], {k[0]: v for k, v in self.waiting.iterator()}
        while at <= now:
            held = (0,) * 6
            if at in waiting:
                held = waiting[at]
                self.waiting.removeKey((at,))
            sums = [a + b for a, b in zip(sums, held, strict=False)]
            out.append((key[0], _utc(at).strftime("%Y-%m-%d"), *held[3:], *sums))
            last, at = at, _ms(_utc(at) + DAY)
        if out:
            self.reported.update((last, *sums))
        self.handle.registerTimer(at)
        yield pd.DataFrame(out, columns=[self.key, "day", *FIGURES, *(f"all_{f}" for f in FIGURES)])


def daily_reports_stream(calls: DataFrame, key: str, ts: str, failed: Column, hour: int = 9, late: str = "1 hour") -> DataFrame:
    """STM2: a report of each target a day, at the hour (UTC), once the watermark is past it: key, day, figures of that day until the hour, and of all time until it.

    Calls are added up by target and hour before they reach a target's state, on the map side first, so a target that makes
    most calls is a few rows an hour there. A target's first report is the one that follows its first call. Rows without a
    time or a target count nowhere.
    """
    with_state(calls.sparkSession)
    t = calls.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    hours = t.groupBy(F.window(ts, "1 hour"), key).agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("error"))
    hours = hours.select(key, F.unix_millis("window.start").alias("start_ms"), *FIGURES)
    shape = f"`{key}` {calls.schema[key].dataType.simpleString()}, day string, " + ", ".join(f"{f} bigint" for f in (*FIGURES, *(f"all_{f}" for f in FIGURES)))
    return hours.groupBy(key).transformWithStateInPandas(DailyReports(key, hour), shape, "Append", "EventTime")


def report_text(day: Column, today: list[Column], all_time: list[Column]) -> Column:
    """The report's text; both lists are total, success and error."""
    said = lambda x: [c.cast("string") for c in x]
    (n, good, bad), (all_n, all_good, all_bad) = said(today), said(all_time)
    return F.concat(
        F.lit("Daily report - "), day, F.lit("\nCalls: "), n, F.lit("\nSuccessful: "), good, F.lit("\nErrors: "), bad,
        F.lit("\n\nAll-time - calls: "), all_n, F.lit(", success: "), all_good, F.lit(", errors: "), all_bad,
    )


class Newer(StatefulProcessor):
    """Updates behind a chat's offset, which is then the largest of them."""

    def __init__(self, columns: list[str], offset: str):
        self.columns, self.offset = columns, offset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "offset bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = self.at.get()[0] if self.at.exists() else None
        seen: set[int] = set()  # of this batch: one chat's updates
        for frame in rows:
            new = frame[~frame[self.offset].isin(seen)].drop_duplicates(self.offset)
            new = new if start is None else new[new[self.offset] > start]
            seen.update(new[self.offset].tolist())
            yield new[self.columns]
        if seen:
            self.at.update((max(seen),))


def commands_stream(updates: DataFrame, allowed: DataFrame, chat: str = "chat_id", offset: str = "update_id", text: str = "text") -> DataFrame:
    """STM3: updates that ask for the status, from allowed chats, each once, as they came.

    A source that sends updates again from an older offset gives nothing twice, also after a restart: each chat's largest offset
    is in the state. Offsets ascend from batch to batch, as such sources send them. Updates without chat, offset or text
    are passed over. allowed: a static table with the chat's column; a chat in it twice is one.
    """
    with_state(updates.sparkSession)
    asks = updates.where(F.trim(text).isin(*COMMANDS) & F.col(offset).isNotNull())
    asks = asks.withColumn(offset, F.col(offset).cast("long")).join(allowed.select(chat), chat, "left_semi").select(*updates.columns)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asks.schema.fields)
    return asks.groupBy(chat).transformWithStateInPandas(Newer(asks.columns, offset), shape, "Append", "None")
