"""Board snapshots as a stream: rows wait in state until their snapshot is whole, then the batch operator reconciles them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from postlake.operators.lifecycle import sync_statuses
from postlake.operators.versions import Version, Versions

#: Settings of queries with whole_snapshots: state in RocksDB, and no batches without data, which timers would make without end.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Snapshots(Versions):
    """Versions of the postings; the log says which batches of the stream are in them."""

    def publish(self, rows: DataFrame) -> Version:
        """The first version, or the next one whatever it was made from."""
        return self.commit(rows, self.newest())


class _Whole(StatefulProcessor):
    """Holds the rows of a board's snapshots, by the snapshot's time, until there are as many different ones as it announces.

    Rows are held in parts as they came, a state call for each part and none for a
    row.  Arrivals are counted, and only once they are enough are the parts read again,
    one at a time, and rows that came before taken out of them.
    """

    def __init__(self, columns: list[str], time: str, size: str, row: str, patience_ms: int):
        self.columns, self.time, self.size, self.row, self.patience = columns, time, size, row, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "at string, part int", "rows binary")
        self.seen = handle.getMapState("seen", "at string", "n long, parts int, due long")
        self.done = handle.getValueState("done", "at string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        due = timerValues.getCurrentProcessingTimeInMs() + self.patience
        done = self.done.get()[0] if self.done.exists() else ""
        touched: dict[str, int] = {}
        for part in rows:
            for time, mine in part[self.columns].groupby(self.time, sort=False, dropna=False):
                at = str(time)
                if at <= done:
                    continue
                touched[at] = int(mine[self.size].iloc[-1])
                n, parts, until = self.seen.getValue((at,)) if self.seen.containsKey((at,)) else (0, 0, due)
                self._hold(at, parts, mine)
                self.seen.updateValue((at,), (n + len(mine), parts + 1, until))
                if parts == 0:
                    self.handle.registerTimer(due)
        whole = [at for at, size in touched.items() if self._is_whole(at, size)]
        if whole:
            newest = max(whole)
            for number in range(self.seen.getValue((newest,))[1]):
                yield self._held(newest, number)
            self.done.update((newest,))
            self._drop(lambda at, _: at <= newest)

    def _hold(self, at: str, number: int, rows: pd.DataFrame) -> None:
        self.rows.updateValue((at, number), (pickle.dumps(rows, protocol=5),))

    def _held(self, at: str, number: int) -> pd.DataFrame:
        return pickle.loads(self.rows.getValue((at, number))[0])

    def _is_whole(self, at: str, size: int) -> bool:
        n, parts, due = self.seen.getValue((at,))
        if n < size:
            return False
        names: set[str] = set()
        for number in range(parts):
            held = self._held(at, number)
            name = held[self.row].map(str)
            new = ~(name.duplicated() | name.isin(names))
            if not new.all():
                self._hold(at, number, held[new])
            names.update(name)
        self.seen.updateValue((at,), (len(names), parts, due))
        return len(names) >= size

    def _drop(self, old) -> None:
        for (at,), (_, parts, due) in list(self.seen.iterator()):
            if old(at, due):
                self.seen.removeKey((at,))
                for number in range(parts):
                    self.rows.removeKey((at, number))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        self._drop(lambda _, due: due <= now)
        return iter(())

    def close(self) -> None:
        pass


def whole_snapshots(rows: DataFrame, board: str = "company_id", time: str = "ts", size: str = "snapshot_rows", row: str = "pos", patience_s: int = 3600) -> DataFrame:
    """A stream's snapshot rows, those of a board's snapshot together, once all have come.

    A snapshot is a board's rows of one time; ``size`` says how many there are and
    ``row`` tells them apart.  Rows may come in any order over many micro-batches and more than once.  A newer whole
    snapshot replaces older ones, whose later rows are dropped, and what is not whole
    after ``patience_s`` goes.  The columns stay; times are compared as text.  The
    query needs the settings STATE.
    """
    columns = rows.columns
    processor = _Whole(columns, time, size, row, patience_s * 1000)
    return rows.groupBy(board).transformWithStateInPandas(processor, outputStructType=rows.schema, outputMode="Append", timeMode="ProcessingTime")


def start(snapshots: DataFrame, store: Snapshots, checkpoint: str, grace_days: int = 3, whole: bool = True) -> StreamingQuery:
    """Apply a stream of snapshot rows (with ts, the time of the snapshot) to the store.

    The store must hold a version, which gives the columns.  A board's snapshot
    closes what it does not list.  Where the rows carry ``snapshot_rows``, they wait
    until theirs are whole; else (or with ``whole`` false) a micro-batch must hold
    whole boards.  Other writers may update the store meanwhile: a batch is folded
    again if one was faster, and applied once.
    """
    if store.newest() is None:
        raise ValueError(f"no version in {store.root}: publish one, of no rows perhaps, first")
    if whole and "snapshot_rows" in snapshots.columns:
        snapshots = whole_snapshots(snapshots)

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)  # the fold reads it for each kind of match, and every reading would go through the state again
        try:
            newest = batch.agg(F.max("ts"), F.count("*")).first()
            if newest[1] == 0:
                return
            rows, now = batch.drop("ts", "snapshot_rows"), F.lit(newest[0])
            store.update(lambda stored: sync_statuses(stored, rows, now, grace_days).drop("change"), app=checkpoint, batch=batch_id)
        finally:
            batch.unpersist()

    conf = store.spark.conf
    before = {name: conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        conf.set(name, value)
    try:  # a query takes its settings as it starts
        return snapshots.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
