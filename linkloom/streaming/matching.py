"""Incremental matching and counters with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def match_stream(rows: DataFrame, match: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Rows matched batch by batch and appended, one folder a batch; a batch that
    is run again replaces its own folder, so results are whole and single."""

    def save(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    w = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def running_counts(rows: DataFrame, by: list[str], value: str | None = None, watermark: tuple[str, str] | None = None, window: str | None = None) -> DataFrame:
    """Rows, and the sum of ``value``, by key so far. With a watermark (time column,
    delay) and the length of a window, by ``window_start`` too: the counters of a window
    that the watermark has passed leave the state, so it doesn't grow with the stream."""
    src = rows.withWatermark(*watermark) if watermark else rows
    extra = [F.sum(value).alias("total")] if value else []
    if not window:
        return src.groupBy(*by).agg(F.count("*").alias("n"), *extra)
    if not watermark:
        raise ValueError("a window needs a watermark")
    out = src.groupBy(*by, F.window(watermark[0], window).alias("_w")).agg(F.count("*").alias("n"), *extra)
    return out.select(*by, F.col("_w.start").alias("window_start"), *[c for c in out.columns if c not in (*by, "_w")])


def progress_of_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """job, found of log lines such as ``[job 7] found 120 products``."""
    return lines.select(F.regexp_extract(column, r"\[job ([^\]]+)\]", 1).alias("job"), F.regexp_extract(column, r"found (\d+) products?", 1).try_cast("long").alias("found")).where("job <> '' and found is not null")
