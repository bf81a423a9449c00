"""Prices with a state for each key: first sightings, marks that stick, and the latest price while it is fresh.

A key is a venue and a pair. It holds its days, each with its first sighting, last price and mark, and the latest price of all, as one value:
every look into a state is a call from Python to the JVM, so a batch of rows of a key has one to read and one to write, however many days it
touches. One timer of a key is set at a time, for what is due first: the price is forgotten once it is too old against the watermark, and a
day when no row can reach it any more, so a key that is quoted no longer takes no room.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

OUT = "venue string, pair long, day string, kind string, first long, seen long, id long, price double, marked boolean"
_HOUR, _EPOCH = 3_600_000, dt.date(1970, 1, 1)


class Prices(StatefulProcessor):
    """Rows ``(venue, pair, day, seen, id, price, marked)`` to changes: a row of a day that changed, and ``gone`` when the latest price is.

    ``seen`` is in milliseconds. Of rows of a key the later by ``seen`` and ``id`` holds. ``keep_days`` is how long a day is kept after its end.
    """

    def __init__(self, fresh_hours: int, keep_days: int):
        self.fresh, self.keep = fresh_hours * _HOUR, keep_days * 24 * _HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("days", "days string, last string, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told = sorted(((r.seen, r.id, r.price, r.marked, r.day) for r in rows), key=lambda r: r[:2])
        own = {}
        for seen, number, price, marked, day in told:
            first = own.get(day, (seen, number, seen, number, price, False))
            own[day] = (*first[:2], seen, number, price, first[5] or bool(marked))
        days, last, timer = self._held()
        for day, state in sorted(own.items()):
            old = days.get(day)
            if old:
                state = (*min(tuple(old[:2]), state[:2]), *max(tuple(old[2:5]), state[2:5]), old[5] or state[5])
            days[day] = state
            yield self._told(key, day, "day", state[0], *state[2:])
        newest = told[-1][:3]
        self._hold(days, max(tuple(last), newest) if last else newest, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Forgets all that is due by now: a timer set here for something that is due already would not call before the next batch."""
        at = expiredTimerInfo.getExpiryTimeInMs()
        now = max(at, timerValues.getCurrentWatermarkInMs())
        days, last, timer = self._held()
        if last and last[0] + self.fresh <= now:
            yield self._told(key, None, "gone", None, *last, None)
            last = None
        # The timer that calls is dropped by Spark.
        self._hold({day: state for day, state in days.items() if self._end(day) > now}, last, None if timer == at else timer)

    def close(self) -> None:
        pass

    def _held(self) -> tuple[dict[str, list], list | None, int | None]:
        found = self.state.get()
        return (json.loads(found[0]), json.loads(found[1]), found[2]) if found else ({}, None, None)

    def _hold(self, days: dict, last: tuple | None, timer: int | None) -> None:
        """Writes the state and sets the timer for what is due first, in place of ``timer``; of a key with nothing left there is neither."""
        due = min([*map(self._end, days), *([last[0] + self.fresh] if last else [])], default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.state.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.state.update((json.dumps(days), json.dumps(last), due))

    def _end(self, day: str) -> int:
        return (dt.date.fromisoformat(day) - _EPOCH).days * 24 * _HOUR + self.keep

    @staticmethod
    def _told(key, day: str | None, kind: str, first: int | None, seen: int, number: int, price: float, marked: bool | None) -> Row:
        return Row(venue=key[0], pair=key[1], day=day, kind=kind, first=first, seen=seen, id=number, price=price, marked=marked)


def prices(quotes: DataFrame, delay: str, fresh_hours: int = 18, keep_days: int = 30) -> DataFrame:
    """Changes of a stream of quotes ``(venue, pair, ts, id, price, marked)``, in update mode.

    States live in RocksDB, which ``spark.sql.streaming.stateStore.providerClass`` has to name.
    """
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    rows = quotes.where("price is not null").withWatermark("ts", delay).select("venue", "pair", "ts", day, F.unix_millis("ts").alias("seen"), "id", "price", "marked")
    return rows.groupBy("venue", "pair").transformWithState(Prices(fresh_hours, keep_days), OUT, "Update", "EventTime")


def days_of(changes: DataFrame) -> DataFrame:
    """The changes folded: each day's first sighting, last price and mark. A mark or a later row never goes back, so the order of batches does not matter."""
    rows = changes.where("kind = 'day'")
    return rows.groupBy("venue", "pair", "day").agg(F.min("first").alias("first"), F.max_by("price", F.struct("seen", "id")).alias("price"), F.bool_or("marked").alias("marked"))


def fresh_of(changes: DataFrame) -> DataFrame:
    """The latest price of each key that has not gone since."""
    newest = Window.partitionBy("venue", "pair").orderBy(F.desc("seen"), F.desc("id"), F.desc("kind"))
    last = changes.withColumn("place", F.row_number().over(newest)).where("place = 1 and kind = 'day'")
    return last.select("venue", "pair", "seen", "price")
