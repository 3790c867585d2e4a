"""Keyed folds with one definition for batches and streams: a state, a step over a key's rows, and what is done when no more comes.

In a batch a key's rows are its whole stream, so its end is known; a task folds its keys one after the other as they come
sorted, an Arrow batch of many keys at a time, and holds no key's rows whole. In a stream each key has a timer (processing time): it
is set anew with each input, and when it runs out the key hands out what it holds and its state goes, so that no state of
an ended stream stays. Timers and their state need the RocksDB state store (``timers`` sets it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Rows = list[tuple]
Step = Callable[[tuple, Iterable[tuple]], tuple[Rows, tuple]]
End = Callable[[tuple], Rows]


def timers(spark: SparkSession) -> None:
    """Chooses the state store that keyed folds with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Fold(StatefulProcessor):
    """The fold of a stream: state by key, and a timer that ends it."""

    def __init__(self, state_schema: str, start: tuple, order: str, values: list[str], step: Step, end: End, columns: list[str], idle_seconds: float):
        self.state_schema, self.start, self.order, self.values, self.step, self.end, self.columns, self.idle = state_schema, start, order, values, step, end, columns, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def _frame(self, key: tuple, rows: Rows) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get() if self.state.exists() else self.start
        new = pd.concat(list(rows)).sort_values(self.order)[self.values]
        out, now = self.step(tuple(found), new.itertuples(index=False, name=None))
        self.state.update(now)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.end(tuple(self.state.get())) if self.state.exists() else []
        self.state.clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def folded(rows: DataFrame, key: str, order: str, values: list[str], schema: StructType, state_schema: str, start: tuple, step: Step, end: End, idle_seconds: float) -> DataFrame:
    """Rows of ``schema`` (the key first) that ``step`` makes of each key's rows in turn, and ``end`` of what is left.

    step(state, rows) -> (rows out, state), rows being tuples of the columns ``values`` by ``order``, a key's rows in one
    call or several; end(state) -> rows out, after a batch or ``idle_seconds`` without input.
    """
    columns = schema.fieldNames()
    if rows.isStreaming:
        return rows.groupBy(key).transformWithStateInPandas(Fold(state_schema, start, order, values, step, end, columns, idle_seconds), schema, "Append", "ProcessingTime")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, began = None, start, False
        for frame in frames:
            out: Rows = []
            for k, run in groupby(zip(frame[key].tolist(), zip(*[frame[c].tolist() for c in values], strict=True), strict=True), key=itemgetter(0)):
                if began and k != now:
                    out += [(now, *r) for r in end(state)]
                    state = start
                now, began = k, True
                found, state = step(state, map(itemgetter(1), run))
                out += [(k, *r) for r in found]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if began and (left := end(state)):
            yield pd.DataFrame([(now, *r) for r in left], columns=columns)

    dealt = rows.select(key, *dict.fromkeys([order, *values])).repartition(key).sortWithinPartitions(key, F.asc_nulls_last(order))
    return dealt.mapInPandas(whole, schema)
