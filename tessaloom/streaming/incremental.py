"""Incremental append with deduplication, windowed counts, and a retry-aware error fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """First of every key while the watermark holds it; the state is bounded by the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, by: list[str], width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def within(stream: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Early and late records are dropped, never retracted."""
    from ..operators.acquire import exact_range

    return exact_range(stream, ts, start, end)


def append_merge_sink(path: str, keys: list[str]):
    """A foreachBatch function that appends the batch's rows with unseen keys."""

    def write(batch: DataFrame, _: int) -> None:
        from ..sources.files import write_new_only

        keyed = batch.withColumn("_key", F.sha2(F.to_json(F.struct(*keys)), 256))
        write_new_only(keyed, path, "_key")

    return write


def error_fold(stream: DataFrame, key: str, order: str, ok: str) -> DataFrame:
    """(key, failures) since the key's last success, updated with every batch; one count of
    state a key."""
    kind = stream.schema[key].dataType.simpleString()

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        for part in [pd.concat(list(batches)).sort_values(order)]:
            for fine in part[ok].eq(True):  # what isn't known to have gone well has failed
                failures = 0 if fine else failures + 1
        state.update((failures,))
        yield pd.DataFrame({key: [k[0]], "failures": [failures]})

    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, failures long", "failures long", "update", GroupStateTimeout.NoTimeout)


def compact_events(events: DataFrame, drop: tuple[str, ...] = ("message", "partial", "snapshot")) -> DataFrame:
    """Delta events without their cumulative snapshots."""
    fields = F.map_filter(F.from_json("event", "map<string, string>"), lambda k, v: ~k.isin(*drop))
    return events.withColumn("event", F.to_json(fields))
