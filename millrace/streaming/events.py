"""Structured Streaming: windowed aggregates with watermarks, and states kept per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(events: DataFrame, time: str, length: str, keys: list[str], aggregates: list, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates per key and tumbling or sliding window; events later than the watermark are dropped by the engine."""
    return events.withWatermark(time, late).groupBy(F.window(time, length, slide) if slide else F.window(time, length), *keys).agg(*aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], aggregates: list, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)


def running_cache(events: DataFrame, key: str, page: str, time: str, capacity: int) -> DataFrame:
    """Hits and requests so far of an LRU cache per key; the cached pages are the state."""
    kind = events.schema[key].dataType.simpleString()

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        pages, hits, seen = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, 0)
        for row in pd.concat(list(batches)).sort_values([time, page])[page]:
            seen += 1
            if row in pages:
                hits += 1
                pages.remove(row)
            pages = [*pages, row][-capacity:]
        state.update((pages, hits, seen))
        yield pd.DataFrame({key: [k[0]], "hits": [hits], "requests": [seen]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, hits long, requests long", f"pages array<{events.schema[page].dataType.simpleString()}>, hits long, seen long", "update", GroupStateTimeout.NoTimeout)
