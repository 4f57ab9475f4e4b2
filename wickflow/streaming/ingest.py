"""Closed candles from streams: exchange messages, and ticks resampled under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.candles import COLUMNS
from ..sources.store import CandleStore

#: The fields of a kline message, and the columns that they fill. Some differ by case alone, so they are read by path.
FIELDS = {
    "open_time": ("t", "long"), "close_time": ("T", "long"), "open": ("o", "double"), "high": ("h", "double"), "low": ("l", "double"), "close": ("c", "double"),
    "volume": ("v", "double"), "quote_volume": ("q", "double"), "trades": ("n", "long"),
}


def closed_candles(messages: DataFrame, column: str = "value") -> DataFrame:
    """Candles of JSON kline messages that are closed; malformed and open ones are left out."""
    field = lambda name: F.get_json_object(F.col(column).cast("string"), f"$.k.{name}")
    columns = {c: field(name).cast(kind) for c, (name, kind) in FIELDS.items()} | {"symbol": F.upper(field("s")), "timeframe": field("i"), "is_closed": F.lit(1)}
    return messages.where(field("x") == "true").select(*(v.alias(c) for c, v in columns.items())).select(*COLUMNS)


def merge_into(path: str, stream: str = "klines"):
    """A foreachBatch function that merges each batch into the candle store at path; a batch that runs again is merged once."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        CandleStore(batch.sparkSession, path).merge(batch, stream, batch_id)

    return merge


def streaming_candles(ticks: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Candles of a stream of ticks (event_type, ts, value, event_id), given out once the watermark passes their end."""
    at = F.struct("ts", "event_id")
    ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = ticks.groupBy(F.window("ts", window), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("trades"),
    )
    return out.select("symbol", (F.unix_micros("window.start") / 1000).cast("long").alias("open_time"), "open", "high", "low", "close", "trades")
