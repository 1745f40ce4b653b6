"""Rows of a key with the row before them in event time, on a stream.

``lag`` is refused on streams.  ``in_order`` keeps a key's recent rows as list state
and gives a log of changes: a row comes out with its predecessor (``op`` 1); when a
row arrives late and takes its place between two others, the later one is taken
back (``op`` -1) and comes out again with its new predecessor.  ``net_rows`` of the
log equals the window over all rows, whatever the order of arrival.  With ``wait``
rows are held until the watermark has passed them, and the log has no corrections.

The watermark bounds the state: a row older than it can no longer arrive (Spark
refuses it), so of such rows only the newest is kept, as the predecessor of what
comes; event-time timers free the others, also for keys without new rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

#: How late a row may come, unless a job says otherwise.
HORIZON = "365 days"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store; a session that names another one keeps it
    (and Spark then says so)."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(name, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(name, ROCKSDB)


class _InOrder(StatefulProcessor):
    """State of a key: its rows as (event time in ms, position, columns ..., out, position of
    the predecessor it came out with)."""

    def __init__(self, key: str, columns: list[str], state: StructType, wait: bool):
        self.columns, self.state, self.wait = columns, state, wait
        self.names = [key, "op", *columns, *(f"prev_{c}" for c in columns)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self._kept()
        known = {r[1] for r in kept}
        for r in rows:
            if r["_pos"] not in known:  # replays add nothing
                known.add(r["_pos"])
                kept.append([r["_ms"], r["_pos"], *(r[c] for c in self.columns), False, None])
        yield from self._settle(key, kept, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key, self._kept(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _kept(self) -> list[list]:
        return [list(r) for r in self.rows.get()]

    def _settle(self, key, kept: list[list], watermark: int) -> Iterable[Row]:
        """Gives what has changed and frees what no later row can touch."""
        kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        at = {r[1]: r for r in kept}
        log, before = [], None
        for r in kept:
            if self.wait and r[0] is not None and r[0] >= watermark:
                continue
            place = before[1] if before else None
            if not r[-2]:
                log.append(self._row(key, 1, r, before))
                r[-2:] = [True, place]
            elif r[-1] != place and before is not None:  # else what came before is freed
                log.append(self._row(key, -1, r, at.get(r[-1])))
                log.append(self._row(key, 1, r, before))
                r[-1] = place
            before = r
        past = sum(1 for r in kept if r[0] is not None and r[0] < watermark and r[-2])
        kept = kept[max(0, past - 1) :]
        self.rows.put([tuple(r) for r in kept])
        # the next time at which a row can be freed, or one that waits comes out
        times = [r[0] for r in kept if r[0] is not None]
        times = [t for t in times if t >= watermark] if self.wait else times[1:2]
        if times:
            self.handle.registerTimer(times[0] + 1)
        return log

    def _row(self, key, op: int, row: list, before: list | None) -> Row:
        old = before[2:-2] if before else [None] * len(self.columns)
        return Row(**dict(zip(self.names, [*key, op, *row[2:-2], *old])))


def in_order(
    stream: DataFrame, key: str, at: str, pos: str, columns: list[str], horizon: str = HORIZON, wait: bool = False
) -> DataFrame:
    """Log ``key, op, <columns>, prev_<columns>`` of a stream's rows by ``key`` in the order of
    ``at`` (NULL last), then ``pos`` (a long, unique within the key).

    Rows with a position that is already known are replays; rows more than
    ``horizon`` behind the newest one are refused by the watermark."""
    use_state_store(stream.sparkSession)
    fields = {f.name: f for f in stream.schema.fields}
    nullable = lambda name, f: StructField(name, f.dataType, True)
    mine = [nullable(c, fields[c]) for c in columns]
    state = StructType(
        [StructField("_ms", LongType()), StructField("_pos", LongType()), *mine]
        + [StructField("_out", BooleanType()), StructField("_before", LongType())]
    )
    out = StructType(
        [nullable(key, fields[key]), StructField("op", IntegerType()), *mine]
        + [nullable(f"prev_{c}", fields[c]) for c in columns]
    )
    time = F.col(at).cast("timestamp")
    rows = stream.select(
        key, *[F.col(c) for c in columns if c != key], time.alias("_time"), F.unix_millis(time).alias("_ms"),
        F.col(pos).cast("long").alias("_pos"),
    )
    return (
        rows.withWatermark("_time", horizon)
        .groupBy(key)
        .transformWithState(_InOrder(key, columns, state, wait), out, "Append", "EventTime")
    )


def net_rows(log: DataFrame) -> DataFrame:
    """The rows that a log of changes leaves: those given and not taken back."""
    columns = [c for c in log.columns if c != "op"]
    left = log.groupBy(*columns).agg(F.sum("op").alias("op")).where("op > 0")
    return left.drop("op")
