"""Files as keyed state: observations of files become changes, marks for deletion and, by timers, purges.

What ``lifecycle.daemon_diff`` and ``lifecycle.expired`` find by joining whole snapshots, this finds as observations arrive, with one small state for each file.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Observations: a file that was seen with a hash, or (null) not found. ``seq`` orders what was seen at one time.
OBSERVED = "section string, rel_path string, content_hash string, seen_at timestamp, seq long"
ACTIONS = "section string, rel_path string, action string, at timestamp, content_hash string"
_STATE = "content_hash string, in_use boolean, purge_us long"
_OUT = "section string, rel_path string, action string, at_us long, content_hash string"
#: Timers need the state store that keeps them.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FileLifecycle(StatefulProcessor):
    """A file is unknown, in use, or marked for deletion until its grace is over.

    Seen while unknown it is new, with another hash changed, and when marked restored (or changed). Not found while in use it is marked (delete), with a timer; when that ends it is
    purged and unknown. An observation at or after the end finds the file purged, whether the timer has fired by then or not, so actions don't hang on how the stream is cut into batches.
    """

    def __init__(self, grace: timedelta):
        self.grace = int(grace.total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802  the interface's name
        now = tuple(self.file.get()) if self.file.exists() else None
        before = now
        for r in sorted(rows, key=lambda r: (r["at_us"], r["seq"])):  # a file's observations of one batch
            if now and now[2] is not None and r["at_us"] >= now[2]:
                yield Row(section=key[0], rel_path=key[1], action="purge", at_us=now[2], content_hash=now[0])
                now = None
            seen, action = r["content_hash"], None
            if seen is None:
                if now and now[1]:
                    now, action = (now[0], False, r["at_us"] + self.grace), "delete"
            else:
                action = "new" if now is None else "changed" if now[0] != seen else None if now[1] else "restored"
                now = (seen, True, None)
            if action:
                yield Row(section=key[0], rel_path=key[1], action=action, at_us=r["at_us"], content_hash=now[0])
        if before and before[2] is not None and (not now or now[2] != before[2]):
            self.handle.deleteTimer(self._ms(before[2]))
        if now is None:
            self.file.clear()
        elif now != before:
            self.file.update(now)
            if now[2] is not None:
                self.handle.registerTimer(self._ms(now[2]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        if self.file.exists():
            hash_, _, purge = tuple(self.file.get())
            if purge is not None and self._ms(purge) <= expiredTimerInfo.getExpiryTimeInMs():
                self.file.clear()
                yield Row(section=key[0], rel_path=key[1], action="purge", at_us=purge, content_hash=hash_)

    @staticmethod
    def _ms(us: int) -> int:
        return -(-us // 1000)


def actions(observed: DataFrame, grace: timedelta, late: timedelta = timedelta(0)) -> DataFrame:
    """ACTIONS of a stream of OBSERVED rows, as they come. Observations may come up to ``late`` behind the newest one; what is due by then is purged."""
    spark = observed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    at = F.col("seen_at").cast("timestamp")
    rows = observed.select("section", "rel_path", "content_hash", at.alias("seen_at"), F.unix_micros(at).alias("at_us"), "seq").withWatermark("seen_at", f"{int(late.total_seconds())} seconds")
    out = rows.groupBy("section", "rel_path").transformWithState(FileLifecycle(grace), _OUT, "Append", "EventTime")
    return out.select("section", "rel_path", "action", F.timestamp_micros("at_us").alias("at"), "content_hash")


def start(spark: SparkSession, source: DataFrame, grace: timedelta, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the actions of a stream as Parquet under ``target``; ``once`` takes what is there and ends."""
    writer = actions(source, grace).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
