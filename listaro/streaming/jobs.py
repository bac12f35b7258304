"""Streaming twins of the nightly operators: status changes, and counts per day and per week.

Late data: a watermark of a day by default, since nothing in the batch operators
says how long a correction may take. Rows in any order within it give what the
batch operators give on the same rows in time order; rows beyond it are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "id string, event_id long, old_status string, new_status string"
#: The state store that keeps lists and timers apart, so that a key's state is not rewritten for each row.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Keys of the stream of status changes. A bucket's waiting rows are in one worker's memory while its timer runs.
BUCKETS = 256


def _timer(micros: int) -> int:
    """The first whole millisecond not before it: when the watermark is there, nothing earlier can come any more."""
    return -(-micros // 1000)


class StatusChanges(StatefulProcessor):
    """Observations wait until the watermark has passed them, and are then compared in time order with the one before of their id.

    Ids share a key, their bucket: each call to the state crosses to the JVM, and so they
    grow with buckets and batches, not with ids. For the same reason rows lie there many at a time, as JSON.
    A bucket's state is the last status of its ids and the observations of the watermark's delay; a timer stands at the first of those.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "statuses string")
        self.waiting = handle.getListState("waiting", "rows string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r.id, r.at, r.event_id, r.status) for r in rows]
        self.waiting.appendList([(json.dumps(came),)])
        self.handle.registerTimer(_timer(min(x[1] for x in came)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(x) for r in self.waiting.get() for x in json.loads(r[0])]
        due, later = sorted(x for x in held if x[1] <= now), [x for x in held if x[1] > now]
        if due:
            statuses = json.loads(self.last.get()[0]) if self.last.exists() else {}
            for i, _, event_id, new in due:
                status = statuses.get(i)
                if status is not None and new != status:
                    yield Row(id=i, event_id=event_id, old_status=status, new_status=new)
                statuses[i] = new
            self.last.update((json.dumps(statuses),))
        if later:
            if due:
                self.waiting.put([(json.dumps(later),)])
            self.handle.registerTimer(_timer(min(x[1] for x in later)))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Rows whose trimmed status differs from the one before of the same id, in time order, whatever order they came in.

    ``stream``: id, observed_at, event_id, status. A change is emitted once the
    watermark has passed it. Needs the state store of STATE_STORE. Rows without an
    id or a time are left out, as they have no place in any order. ``buckets``: keys that
    the ids are dealt over; it stays as it is as long as a checkpoint lives.
    """
    clean = F.trim(F.coalesce("status", F.lit("")))
    rows = stream.filter("id is not null and observed_at is not null").withWatermark("observed_at", late)
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "id", "observed_at", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at"), "event_id", clean.alias("status"))
    return rows.groupBy("bucket").transformWithState(StatusChanges(), CHANGES, "append", "eventTime")


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Observations per day and status; a day is emitted once, when the watermark has passed its end."""
    counts = stream.withWatermark("observed_at", late).groupBy(F.window("observed_at", "1 day"), "status").agg(F.count("*").alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), "status", "n")


def weekly_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Observations per status in the seven days up to and with each day; a week is emitted once, when the watermark has passed its end."""
    counts = stream.withWatermark("observed_at", late).groupBy(F.window("observed_at", "7 days", "1 day"), "status").agg(F.count("*").alias("n"))
    return counts.select(F.date_sub(F.to_date("window.end"), 1).alias("last_day"), "status", "n")
