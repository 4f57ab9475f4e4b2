"""Turning points of a stream of candles: a zigzag's state for each series, in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.structure import TURNS, Zigzag
from ..sources.candles import SERIES
from ..tables import scratch, shared_path

STATE = "idx long, open_time long, at long, price double, trend int"
#: State of this kind needs the store that keeps columns.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TurningPoints(StatefulProcessor):
    """Candles of a series, in order of time over all batches, as turns. A candle that isn't newer than the last one is left out: it came late or twice."""

    def __init__(self, threshold_pct: float) -> None:
        self.threshold = threshold_pct / 100

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("zigzag", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        machine, idx, last = Zigzag(self.threshold), -1, None
        if self.state.exists():
            idx, last, machine.at, machine.price, machine.trend = self.state.get()
        out = []
        for open_time, close in pd.concat(rows)[["open_time", "close"]].sort_values("open_time").itertuples(index=False, name=None):
            if last is not None and open_time <= last:
                continue
            idx, last = idx + 1, open_time
            if close and close == close and (turn := machine.push(idx, close)):
                out.append((*key, *turn))
        if last is not None:
            self.state.update((idx, last, machine.at, machine.price, machine.trend))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in TURNS.split(", ")])

    def close(self) -> None:
        pass


def streaming_turns(candles: DataFrame, threshold_pct: float) -> DataFrame:
    """Turns of a stream of candles (series, open_time, close), each once it is confirmed; index counts a series' candles."""
    rows = candles.select(*SERIES, "open_time", "close").groupBy(*SERIES)
    return rows.transformWithStateInPandas(TurningPoints(threshold_pct), outputStructType=StructType.fromDDL(TURNS), outputMode="Append", timeMode="None")


def session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that turning points need."""
    out = spark.newSession()
    out.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return out


def turns_in_batches(candles: DataFrame, threshold_pct: float, batches: int = 3) -> DataFrame:
    """Turns of candles that arrive span by span. After each the query ends, and the next one goes on from its checkpoint."""
    own = session(candles.sparkSession)
    bounds = candles.agg(F.min("open_time"), F.max("open_time")).first()
    if bounds[0] is None:
        return candles.sparkSession.createDataFrame([], TURNS)
    width = (bounds[1] - bounds[0]) // batches + 1
    with scratch(candles.sparkSession) as keep:
        inbox, done = shared_path(own, "inbox"), shared_path(own, "inbox-state")
        outer = shared_path(own, "turns")
        rows = candles.select(*SERIES, "open_time", "close").withColumn("_batch", F.floor((F.col("open_time") - bounds[0]) / width))
        for i in range(batches):
            rows.where(F.col("_batch") == i).drop("_batch").write.mode("append").parquet(inbox)
            stream = own.readStream.schema(rows.drop("_batch").schema).parquet(inbox)
            run = streaming_turns(stream, threshold_pct).writeStream.format("parquet").option("path", outer).option("checkpointLocation", done).trigger(availableNow=True).start()
            run.awaitTermination()
        out = candles.sparkSession.read.schema(TURNS).parquet(outer)
        out._scratch_path = outer
        return keep(out)
