"""The engine's time-evolving outputs over a stream of cell states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_of(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_averages(states: DataFrame, time: str, interval: str, value: str, weight: str, delay: str = "0 seconds", start: str | None = None) -> DataFrame:
    """Weighted averages per snapshot interval; rows later than the watermark's delay are dropped, as windows are final then."""
    slot = F.window(time, interval, startTime=start) if start else F.window(time, interval)
    marked = states.withWatermark(time, delay) if states.isStreaming else states
    grouped = marked.groupBy(slot.alias("slot"))
    mean = F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
    return grouped.agg(mean.alias("average"), F.count("*").alias("n")).select(F.col("slot.start").alias("begin"), "average", "n")


def first_crossings(states: DataFrame, entity: str, time: str, value: str, above: float = 0.5) -> DataFrame:
    """(entity, first_time, highest): emitted when an entity first exceeds the threshold, with its highest value until then.

    State per entity: its highest value, and whether it was reported.
    """
    kind = states.schema[entity].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        highest, reported = state.get if state.exists else (float("-inf"), False)
        rows = pd.concat(list(batches)).sort_values("time")
        highest = max(highest, float(rows["value"].max()))
        over = rows[rows["value"] > above]
        out = pd.DataFrame({"entity": [], "first_time": [], "highest": []})
        if len(over) and not reported:
            reported = True
            out = pd.DataFrame({"entity": [key[0]], "first_time": [float(over["time"].iloc[0])], "highest": [highest]})
        state.update((highest, reported))
        yield out

    rows = states.select(F.col(entity).alias("entity"), F.col(time).cast("double").alias("time"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("entity").applyInPandasWithState(
        step, f"entity {kind}, first_time double, highest double", "highest double, reported boolean", "append", GroupStateTimeout.NoTimeout
    )


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Feed all that is there to ``sink`` in micro-batches and stop; a restart goes on from the checkpoint."""
    query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
