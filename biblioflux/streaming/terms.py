"""Streaming forms: windowed term and panel counts, duplicates within a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "2 days", weight: Column | None = None) -> DataFrame:
    """(window_start, keys..., freq): tumbling-window counts of keys; rows later than `late` are left out by the
    watermark. It bounds the state in append and update mode; complete mode keeps all windows."""
    w = F.window(time, window)
    counted = stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("freq"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "freq")


def windowed_terms(stream: DataFrame, time: str, tokens: Column, window: str = "1 day", late: str = "2 days") -> DataFrame:
    return windowed_counts(stream.select(time, F.explode(tokens).alias("term")), time, ["term"], window, late)


def drop_repeats(stream: DataFrame, time: str, columns: list[str], late: str = "2 days") -> DataFrame:
    """Exact duplicates left out as long as the first is within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(columns)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append closed windows to Parquet files over what the source has now; state is bounded by the watermark, and a later
    run goes on where this one ended. Both folders must be shared by the cluster."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def counts_to_files(stream: DataFrame, time: str, keys: list[str], path: str, checkpoint: str, window: str = "1 day") -> DataFrame:
    """(window_start, keys..., freq) over all that the source has now, late rows too. Each batch adds its own counts as files
    below `path`, and the files are summed; no state is kept, and a batch that is run again replaces its own files."""
    w = F.window(time, window)

    def batch(rows: DataFrame, number: int) -> None:
        rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("freq")).select(F.col("w.start").alias("window_start"), *keys, "freq").write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path).groupBy("window_start", *keys).agg(F.sum("freq").alias("freq"))


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a query over what its source has now and return its memory table; for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
