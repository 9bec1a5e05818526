"""An extension: panels kept by Structured Streaming. Events are windowed under a watermark; each batch's closed or changed periods
replace their rows in a table by revision, and smoothing states advance one period at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.contract import ID, TARGET, TIME


def windowed_panel(events: DataFrame, id_col: str, time_col: str, value_col: str | None = None, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(unique_id, ds, y) sums (or counts) of tumbling windows; events later than `late` are dropped by the watermark."""
    rows = events.select(F.col(id_col).alias(ID), F.col(time_col).cast("timestamp").alias("_t"), (F.col(value_col).cast("double") if value_col else F.lit(1.0)).alias("v"))
    out = rows.withWatermark("_t", late).groupBy(F.window("_t", size), ID).agg(F.sum("v").alias(TARGET))
    return out.select(ID, F.col("window.start").cast("timestamp_ntz").alias(TIME), TARGET)


def sessions(events: DataFrame, id_col: str, time_col: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = events.select(F.col(id_col).alias(ID), F.col(time_col).cast("timestamp").alias("_t")).withWatermark("_t", late)
    return rows.groupBy(F.session_window("_t", gap), ID).agg(F.count("*").alias("n")).select(ID, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_panel(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends each closed period to a Parquet table, exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def smoothed(periods: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(unique_id, ds, y, level): exponential smoothing of arriving periods with the level kept as state for each series."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(TIME)
        out = []
        for ds, y in zip(rows[TIME], rows[TARGET]):
            level = y if level is None else alpha * y + (1 - alpha) * level
            out.append((key[0], ds, y, level))
        state.update((level,))
        yield pd.DataFrame(out, columns=[ID, TIME, TARGET, "level"])

    return periods.groupBy(ID).applyInPandasWithState(advance, f"{ID} string, {TIME} timestamp_ntz, {TARGET} double, "
        f"level double", "level double", "append", GroupStateTimeout.NoTimeout)
