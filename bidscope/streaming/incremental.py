"""Incremental jobs on Structured Streaming: event counters, deduplicated alerts, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidscope.workspace import fresh_path


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, *, size: str = "1 hour", slide: str | None = None, watermark: str = "1 day") -> DataFrame:
    """Events and value per type in tumbling or sliding windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = events.withWatermark("ts", watermark).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "value")


def sessions(events: DataFrame, *, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    """Sessions per user: events until a pause of ``gap``."""
    counted = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "user_id", "events")


def unique_alerts(events: DataFrame, keys: list[str], *, watermark: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def daily_digest(events: DataFrame, *, watermark: str = "2 days") -> DataFrame:
    """Per user and day: events, value, purchases."""
    return _digest(events, F.window("ts", "1 day"), watermark)


def weekly_digest(events: DataFrame, *, watermark: str = "8 days") -> DataFrame:
    """Per user and week, named by its Monday: events, value, purchases."""
    return _digest(events, F.window("ts", "7 days", "7 days", "4 days"), watermark)  # windows begin on a Thursday, the first day of all


def _digest(events: DataFrame, window: Column, watermark: str) -> DataFrame:
    counted = events.withWatermark("ts", watermark).groupBy(window.alias("w"), "user_id")
    sums = counted.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return sums.select(F.col("w.start").cast("date").alias("day"), "user_id", "events", "value", "purchases")


def change_stream(stream: DataFrame, key: str, value: str, order: list[str], *, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Each row of a stream with ``change``: new, updated or unchanged against the last value of its key.

    The last values stand in a table beside the output, one version for each batch; a batch compares its rows with one
    another and its first of each key with that table.  A batch that is run again writes the same files anew.
    """
    spark = stream.sparkSession
    out, checkpoint = out or fresh_path(spark, "changes"), checkpoint or fresh_path(spark, "changes-state")
    schema = stream.schema

    def batch(df: DataFrame, number: int) -> None:
        w = Window.partitionBy(key).orderBy(*order)
        rows = df.withColumns({"__before": F.lag(value).over(w), "__first": F.row_number().over(w) == 1})
        last = df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("__last"))
        if number:
            known = spark.read.schema(f"{key} {schema[key].dataType.simpleString()}, __last {schema[value].dataType.simpleString()}").parquet(f"{checkpoint}-last/{number - 1}")
            rows = rows.join(known, key, "left").withColumn("__before", F.when(F.col("__first"), F.col("__last")).otherwise(F.col("__before"))).drop("__last")
            last = known.join(last.select(key), key, "left_anti").unionByName(last)
        change = F.when(F.col("__before").isNull(), "new").when(F.col("__before") != F.col(value), "updated").otherwise("unchanged")
        rows.select(*schema.names, change.alias("change")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.write.mode("overwrite").parquet(f"{checkpoint}-last/{number}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def drain(stream: DataFrame, *, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into Parquet in the shared folder, and return what it wrote.

    A second run with the same checkpoint and target goes on where the first stopped.  In update and complete modes each
    batch replaces the table of the one before.
    """
    spark = stream.sparkSession
    out, checkpoint = out or fresh_path(spark, "stream-out"), checkpoint or fresh_path(spark, "stream-state")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def evaluate_new_rows(stream: DataFrame, evaluate, target: str, keys: list[str], checkpoint: str) -> None:
    """For each batch of new rows run ``evaluate`` and append those of its results whose keys the target lacks."""
    spark = stream.sparkSession

    def batch(df: DataFrame, _: int) -> None:
        found = evaluate(df).dropDuplicates(keys)
        try:
            known = spark.read.parquet(target).select(*keys)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        (found if known is None else found.join(known, keys, "left_anti")).write.mode("append").parquet(target)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
