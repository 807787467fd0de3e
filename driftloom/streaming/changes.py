"""An extension: changes between consecutive versions as a stream. The batch operator is operators.history.diffs."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

OUTPUT = StructType(
    [StructField(n, StringType()) for n in ("repo", "tool")]
    + [StructField(n, LongType()) for n in ("from_seq", "to_seq")]
    + [StructField(n, TimestampType()) for n in ("from_date", "to_date")]
    + [StructField("description_changed", BooleanType())]
)
_VERSION = StructType([StructField("date", TimestampType()), StructField("seq", LongType()), StructField("description", StringType())])
#: Spark's store for state of any form.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(date: datetime) -> int:
    return int(date.astimezone(timezone.utc).timestamp() * 1000)


class Consecutive(StatefulProcessor):
    """Of each key: the last version that was told, the early ones that wait for the watermark, and a lifetime.

    A version waits until the watermark has passed its date, as an older one may still come till then; a timer wakes the key.
    Then it is told after the last, in the order of (date, seq). A key of which nothing comes for ``lifetime`` forgets its last version.
    """

    def __init__(self, lifetime_ms: int | None):
        self.lifetime = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _VERSION, self.lifetime)
        self.waiting = handle.getListState("waiting", _VERSION)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        have = {(w[0], w[1]) for w in self.waiting.get()}
        armed = set(self.handle.listTimers())
        for r in rows:
            v = (r["date"], r["seq"], r["description"] or "")
            if _ms(v[0]) <= now or (v[0], v[1]) in have:
                continue  # too late, or there already
            have.add((v[0], v[1]))
            self.waiting.appendValue(v)
            if (at := _ms(v[0]) + 1) not in armed:
                armed.add(at)
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(tuple(w) for w in self.waiting.get())
        ready = [w for w in waiting if _ms(w[0]) < due]
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for w in ready:
            if last is not None:
                out.append(Row(repo=key[0], tool=key[1], from_seq=last[1], to_seq=w[1], from_date=last[0], to_date=w[0], description_changed=last[2] != w[2]))
            last = w
        if ready:
            self.last.update(last)
            rest = waiting[len(ready) :]
            self.waiting.put(rest) if rest else self.waiting.clear()
        return iter(out)

    def close(self) -> None:
        pass


def ordered_state(spark: SparkSession) -> None:
    """Chooses the store that such state needs, for streams that are started from now on."""
    spark.conf.set(*STORE)


def stream_changes(versions: DataFrame, delay: str = "1 hour", lifetime_ms: int | None = None) -> DataFrame:
    """Pairs of consecutive versions of each (repo, tool) from a stream (repo, tool, date timestamp, seq, description), in any order.

    Versions that come within ``delay`` of the latest date seen are put in order by (date, seq) before they are compared, so a
    shuffled stream gives what the sorted one does; later ones are dropped, and so is a second one of an equal date and seq.
    A pair is told once the watermark has passed its later version. With ``lifetime_ms``, a key that nothing came for so long
    (by the clock) forgets its last version, and its next one starts anew: state does not grow with all keys ever seen.
    """
    ordered_state(versions.sparkSession)
    rows = versions.select("repo", "tool", "date", "seq", "description").withWatermark("date", delay)
    return rows.groupBy("repo", "tool").transformWithState(Consecutive(lifetime_ms), OUTPUT, "Append", "EventTime")
