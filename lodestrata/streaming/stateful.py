"""Keyed state with timers of event time: rows that come out of order, and values that expire."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor

#: The state store that typed state with timers needs; a session has it set before such a query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
END_OF_TIME = pd.Timestamp.max.value // 1000
END_OF_LONG = 2**63 - 1


def use_state_store(spark: SparkSession) -> None:
    """Queries that ``spark`` starts from now on keep typed state."""
    spark.conf.set(*STATE_STORE)


class InOrder(StatefulProcessor):
    """Folds a key's rows in order of event time, whatever the order in which they come.

    Rows later than the watermark wait in a list state; those up to it are folded into a value state for good, at the next
    rows of the key or when the timer of the first that waits fires. After new rows the key's results are told as if all
    that waits had been folded, so that in update mode the last rows told are those of all rows that came. ``columns`` of a
    row are its time in microseconds and what ``fold(state, row) -> (state, result)`` reads; rows are ordered by them from
    the first. ``tell(key, results)`` makes the rows told from the results of all rows that aren't settled.
    """

    def __init__(self, columns: Sequence[str], row: str, state: str, start: tuple, fold: Callable[[tuple, tuple], tuple[tuple, tuple]], tell: Callable[[tuple, list[tuple]], pd.DataFrame]):
        self.columns, self.row, self.state, self.start, self.fold, self.tell = list(columns), row, state, start, fold, tell

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", self.state)
        self.waiting = handle.getListState("waiting", self.row)

    def _rows(self) -> list[tuple]:
        return [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []

    def _settle(self, rows: list[tuple], watermark_ms: int) -> tuple[list[tuple], list[tuple]]:
        """Results of the rows in order; what is up to the watermark goes into the state, the rest waits."""
        rows.sort()
        now = tuple(self.settled.get()) if self.settled.exists() else self.start
        least, results, waits = watermark_ms * 1000, [], []
        kept = now
        for row in rows:
            now, result = self.fold(now, row)
            results.append(result)
            if row[0] < least:
                kept = now
            else:
                waits.append(row)
        if len(waits) < len(rows):
            self.settled.update(kept)
        if waits:
            self.waiting.put(waits)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(waits[0][0] // 1000, watermark_ms) + 1)
        else:
            self.waiting.clear()
        return results, waits

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(x) for part in rows for x in part[self.columns].astype(object).itertuples(index=False, name=None)]
        results, _ = self._settle(self._rows() + new, timerValues.getCurrentWatermarkInMs())
        yield self.tell(key, results)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle(self._rows(), timerValues.getCurrentWatermarkInMs())
        yield self.tell(key, [])

    def close(self) -> None:
        pass


class Successions(StatefulProcessor):
    """Tells of each row whether it is its key's first, or like the one before it in order of event time, or unlike it.

    A group is a bucket of many keys, as each group costs calls to the state store: it is sorted as a whole, and its state is
    one value, an Arrow table of the rows later than the watermark and of each key's last row up to it. Rows are ordered
    by ``at_us``, ``version`` and ``digest``. After new rows of a key the results of all of it that wait are told again; a
    bucket without new rows settles when the timer of its latest row fires. Rows at ``END_OF_LONG`` come last and never settle.
    """

    COLUMNS = pa.schema([("repo", pa.string()), ("path", pa.string()), ("at_us", pa.int64()), ("version", pa.int64()), ("digest", pa.string())])
    STORED = COLUMNS.append(pa.field("settled", pa.bool_()))
    MOST_TOLD = 50_000

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "rows binary, timer long")

    def _settle(self, new: list[pa.Table], watermark_ms: int) -> pd.DataFrame:
        """Results of the rows that weren't settled, of keys with new rows; the state is then without all but the last of each key up to the watermark."""
        kept = self.kept.get()
        stored, old = ([pa.ipc.open_stream(pa.py_buffer(kept[0])).read_all()], kept[1]) if kept else ([], None)
        table = pa.concat_tables([*stored, *new]).combine_chunks()
        numbers = {c: table[c].to_numpy() for c in ("at_us", "version", "settled")}
        repo, path = (table[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("repo", "path"))
        key = repo.indices.to_numpy().astype(np.int64) * len(path.dictionary) + path.indices.to_numpy()
        digest = pc.rank(table["digest"], null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((digest, numbers["version"], numbers["at_us"], ~numbers["settled"], key))
        key, digest, at, settled = key[order], digest[order], numbers["at_us"][order], numbers["settled"][order]
        follows, alike = np.append(False, key[1:] == key[:-1]), np.append(False, digest[1:] == digest[:-1])
        # what is up to the watermark comes first within a key
        done = settled | (at < watermark_ms * 1000)
        stays = ~(done & np.append(follows[1:] & done[1:], False))
        table = table.take(pa.array(order))
        self._keep(table.select(self.COLUMNS.names).append_column("settled", pa.array(done)).filter(pa.array(stays)), at[~done & (at < END_OF_LONG)], old)
        state = np.array(["new", "changed", "same"], dtype=object)[follows * (1 + alike)]
        told = ~settled & np.isin(key, key[order >= sum(map(len, stored))])
        rows = table.filter(pa.array(told))
        return pd.DataFrame({**{c: rows[c].to_pandas() for c in ("repo", "path", "version")}, "state": state[told]})

    def _keep(self, table: pa.Table, waiting: np.ndarray, old: int | None) -> None:
        timer = int(waiting.max()) // 1000 + 1 if len(waiting) else None
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.STORED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        self.kept.update((sink.getvalue().to_pybytes(), timer))
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pa.Table.from_arrays([*[pa.array(part[f.name], f.type, from_pandas=True) for f in self.COLUMNS], pa.array(np.zeros(len(part), bool))], schema=self.STORED) for part in rows]
        results = self._settle(parts, timerValues.getCurrentWatermarkInMs())
        for at in range(0, len(results), self.MOST_TOLD):
            yield results.iloc[at : at + self.MOST_TOLD]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle([], timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


class Expiring(StatefulProcessor):
    """The newest value of a key until a time of its own has gone by.

    The value state has one row; a timer at the end of its time takes it away. Told are the new value with its end, and a
    row without a value once that has come. ``columns`` are arrival, creation and the value; times in microseconds.
    """

    def __init__(self, columns: Sequence[str], value: str, ttl_us: int):
        self.columns, self.value, self.ttl_us = list(columns), value, ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", f"arrived long, created long, value {self.value}")

    def _row(self, key, arrived, created, value, ends) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "arrived": [arrived], "created": [created], "value": [value], "ends": [ends]}, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.newest.get()) if self.newest.exists() else None
        for part in rows:
            for row in part[self.columns].astype(object).itertuples(index=False, name=None):
                best = max(best, tuple(row)) if best else tuple(row)
        self.newest.update(best)
        ends = best[1] + self.ttl_us
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(-(-ends // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, *best, ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        arrived, created, _ = self.newest.get()
        self.newest.clear()
        yield self._row(key, arrived, created, None, created + self.ttl_us)

    def close(self) -> None:
        pass
