"""Keyed state over event time, for operators whose rows depend on earlier ones.

Rows of a key may reach a task in any order, also within a micro-batch. They wait in buckets of event time and are taken
out once the watermark has passed their bucket's end, in order. Up to ``PIECE_ROWS`` rows of a key wait in one value with
one timer, that of their first bucket, and leave together however many buckets have passed. More rows wait in a map
state that holds each bucket's rows in pieces, with a timer for each bucket: there a row is written once and read once
however long it waits and however many rows its key has. So the stream gives what the batch form gives. Rows behind the
watermark are dropped and counted by Spark (``numRowsDroppedByWatermark``).

An operator is a ``step(state, rows)`` function: a tuple of state values (or None at first) and the ordered rows of one
key as dictionaries; it returns the new state and the rows to emit. In rows, event time is a whole number of
microseconds under ``AT``, so neither the session's zone nor a clock change can move it. An operator may also have a
moment at which something happens by itself: ``due(state)`` names it, ``expire(state, moment)`` is called when all rows
up to it have been taken, be there later rows or not.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from colloquy.functions.numbers import micros

AT = "event_us"
FAR = "9999-01-01 00:00:00"       # event time of an end marker
END_MS = 221_845_392_000_000     # the year 9000: the watermark passes it only after an end marker
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Keyed state of this kind needs the RocksDB store, which keeps it off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


BUCKET_MS = 10_000  # event time that is taken out at once
PIECE_ROWS = 1_000  # rows in one value of the state

# rows that wait together, their first timer, buckets that wait in pieces, whether the end of the input has been handled
WAITING = "rows binary, timer bigint, paged int, closed boolean"


class OrderedSteps(StatefulProcessor):
    def __init__(self, rows: T.StructType, key: list, state: T.StructType, out: T.StructType, step: Callable, tie: list,
                 close: Callable | None, due: Callable | None, expire: Callable | None, bucket_ms: int):
        self.rows, self.key, self.state_type, self.out = rows, key, state, out
        self.step, self.tie, self.close_step, self.due, self.expire, self.bucket_ms = step, tie, close, due, expire, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the rows of a piece travel as one value
        self.pieces = handle.getMapState("pieces", "bucket bigint, piece int", "rows binary")
        self.counts = handle.getMapState("counts", "bucket bigint", "pieces int")
        self.waiting = handle.getValueState("waiting", WAITING)
        self.state = handle.getValueState("state", self.state_type)

    def _held(self) -> tuple:
        """The key's waiting rows, as WAITING names them; rows wait together or in pieces, never both."""
        packed, timer, paged, closed = self.waiting.get() or (None, None, 0, False)
        return pickle.loads(packed) if packed else [], timer, paged, closed

    def _hold(self, rows: list, timer, paged: int, closed: bool) -> None:
        self.waiting.update((pickle.dumps(rows) if rows else None, timer, paged, closed))

    def handleInputRows(self, key, rows, timerValues):
        at = self.rows.names.index(AT)
        fresh = [tuple(r[n] for n in self.rows.names) for r in rows]
        held, timer, paged, closed = self._held()
        if paged or len(held) + len(fresh) > PIECE_ROWS:
            self._hold([], None, paged + self._page(held + fresh, at), closed)
            if self.close_step or self.due:
                self.handle.registerTimer(END_MS)
            return iter([])
        timer = self._timed(min(r[at] for r in fresh) // 1000 // self.bucket_ms, timer)
        self._hold(held + fresh, timer, 0, closed)
        return iter([])

    def _timed(self, bucket: int, timer: int | None) -> int | None:
        """A timer at the bucket's end, unless an earlier one is there; an end marker needs none."""
        end = (bucket + 1) * self.bucket_ms
        if end >= END_MS or (timer is not None and timer <= end):
            return timer
        self.handle.registerTimer(end)
        return end

    def _page(self, rows: list, at: int) -> int:
        """Put rows into pieces of their buckets; returns the number of buckets that are new."""
        waiting, new = {}, 0
        for row in rows:
            waiting.setdefault(row[at] // 1000 // self.bucket_ms, []).append(row)
        # Spark has dropped what is behind the watermark, so none of these buckets has been taken yet
        for bucket, fresh in waiting.items():
            known = self.counts.getValue((bucket,)) if self.counts.containsKey((bucket,)) else None
            n = known[0] if known else 0
            for i in range(0, len(fresh), PIECE_ROWS):
                self.pieces.updateValue((bucket, n), (pickle.dumps(fresh[i:i + PIECE_ROWS]),))
                n += 1
            self.counts.updateValue((bucket,), (n,))
            if not known:
                new += 1
                self.handle.registerTimer((bucket + 1) * self.bucket_ms)
        return new

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = expiredTimerInfo.getExpiryTimeInMs()
        held, timer, paged, closed = self._held()
        if closed:
            return iter([])
        if paged:  # bucket by bucket, each at its own timer
            rows = self._taken(until // self.bucket_ms - 1) if until < END_MS else []
            paged -= bool(rows)
        else:  # all buckets that the watermark has passed
            if timerValues is not None:
                until = max(until, timerValues.getCurrentWatermarkInMs())
            until = until // self.bucket_ms * self.bucket_ms if until < END_MS else END_MS
            at = self.rows.names.index(AT)
            gone = [(r[at] // 1000 // self.bucket_ms + 1) * self.bucket_ms <= until for r in held]
            rows = self._ordered([r for r, out in zip(held, gone) if out])
            held = [r for r, out in zip(held, gone) if not out]
            timer = self._timed(min(r[at] for r in held) // 1000 // self.bucket_ms, None) if held else None
            if until < END_MS and (self.close_step or self.due):
                self.handle.registerTimer(END_MS)
        if rows or until >= END_MS:
            self._hold(held, timer, paged, until >= END_MS)
        before = self.state.get()
        state = tuple(before) if before is not None else None
        state, emitted = self._advance(state, rows, until * 1000)
        if state is not None:
            self.state.update(state)
        if self.close_step and until >= END_MS and state is not None:
            emitted = emitted + list(self.close_step(state))
        fixed = dict(zip(self.key, key))
        row = Row(*self.out.names)
        return iter([row(*[fixed[c] if c in fixed else r[c] for c in self.out.names]) for r in emitted])

    def _taken(self, bucket: int) -> list:
        """The rows of a bucket in order, taken out of the state."""
        if not self.counts.containsKey((bucket,)):
            return []  # the timer of a deadline
        found = []
        for piece in range(self.counts.getValue((bucket,))[0]):
            found.extend(pickle.loads(self.pieces.getValue((bucket, piece))[0]))
            self.pieces.removeKey((bucket, piece))
        self.counts.removeKey((bucket,))
        return self._ordered(found)

    def _ordered(self, rows: list) -> list:
        order = [self.rows.names.index(n) for n in (AT, *self.tie)]
        return [dict(zip(self.rows.names, r)) for r in sorted(rows, key=lambda r: tuple(r[i] for i in order))]

    def _advance(self, state, rows: list, until: int) -> tuple:
        """State and rows to emit once all ``rows`` are taken and time has come to ``until``."""
        if self.due is None:
            return self.step(state, rows) if rows else (state, [])
        emitted = []

        def time_passes(state, moment):
            while state is not None and (deadline := self.due(state)) is not None and deadline < moment:
                state, out = self.expire(state, deadline)
                emitted.extend(out)
            return state

        for row in rows:  # rows at the moment of a deadline come before it
            state, out = self.step(time_passes(state, row[AT]), [row])
            emitted.extend(out)
        state = time_passes(state, until)
        deadline = self.due(state) if state is not None else None
        if deadline is not None and until < END_MS * 1000:
            # at the end of a bucket, so that its rows come first
            self.handle.registerTimer((deadline // 1000 // self.bucket_ms + 1) * self.bucket_ms)
        return state, emitted


def end_marker(spark, schema: T.StructType, ts: str) -> DataFrame:
    """One row that ends a finite input: a far event time and nulls.

    Delivered last, it moves the watermark past every real row, so all of them leave the state, and open results
    are closed. It stays in the state itself and is never given out. Filters in front of a stream operator must
    let a row of nulls pass, or stand behind ``event_time``.
    """
    shape = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    row = [(None,) * len(shape)]
    return spark.createDataFrame(row, shape).withColumn(ts, F.lit(FAR).cast(shape[ts].dataType)).select(*shape.names)


def event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark on ``ts``; zone-less timestamps are read as UTC."""
    return stream.withColumn(ts, F.timestamp_micros(micros(stream, ts))).withWatermark(ts, delay)


def in_order(
    stream: DataFrame, key, ts: str, state: str, out: list, step: Callable, delay: str | None = "10 seconds", tie=(),
    close: Callable | None = None, due: Callable | None = None, expire: Callable | None = None, bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Run ``step`` over each key's rows in event-time order.

    Column names must not start with an underscore, which the state's Python side
    drops. ``state`` is the DDL of the state; ``out`` the output columns as
    ``(name, DDL type)``, in front of which the key is put. ``ts`` among them is
    made from ``AT`` of the emitted row. ``close(state)`` gives the rows that a key
    still owes once an end marker has come. ``bucket_ms`` is the event time that is
    taken out at once: rows come out at most that much later than the watermark
    allows, and each bucket with rows costs a timer.
    """
    key = [key] if isinstance(key, str) else list(key)
    spark = stream.sparkSession
    use_rocksdb(spark)
    if delay is not None:
        stream = event_time(stream, ts, delay)
    stream = stream.where(F.col(ts).isNotNull()).withColumn(AT, F.unix_micros(ts))
    rows = T.StructType([f for f in stream.schema if f.name not in (*key, ts)])
    fields = [stream.schema[k] for k in key]
    for name, kind in out:
        fields.append(T.StructField(AT, T.LongType()) if name == ts else T.StructField(name, T._parse_datatype_string(kind)))
    shape = T.StructType(fields)
    processor = OrderedSteps(rows, key, T._parse_datatype_string(state), shape, step, list(tie), close, due, expire, bucket_ms)
    done = stream.groupBy(*key).transformWithState(processor, shape, "Append", "EventTime")
    return done.select(*[F.timestamp_micros(AT).alias(ts) if f.name == AT else F.col(f.name) for f in fields])
