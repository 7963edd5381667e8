"""Folds on Structured Streaming: keyed state in the state store, one state value per key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import STATE_STORE
from .folds import Fold


class FoldProcessor(StatefulProcessor):
    """Sort the rows of a key in the micro-batch, step through them, keep the state.

    STR-2: with ``ttl_ms`` the state of an idle key is dropped by the store.
    """

    def __init__(self, fold: Fold, columns: list[str], order: list[str], ttl_ms: int | None):
        self.fold, self.columns, self.order, self.ttl_ms = fold, columns, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "body string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.fold.fresh()
        out = self.fold.run(state, frame[self.columns])
        self.state.update((json.dumps(state),))
        yield out

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, fold: Fold, keys: list[str], order: list[str] | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Streaming counterpart of ``folds.replay``; needs the RocksDB state store.

    ``ttl_ms`` works on processing time and so keeps a stream alive: use it in
    long-running queries, not with the available-now trigger.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    processor = FoldProcessor(fold, stream.columns, order or ["ts_ms", "id"], ttl_ms)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=StructType(stream.schema.fields + fold.out),
        outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
