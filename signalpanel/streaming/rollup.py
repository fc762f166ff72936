"""The daily roll-up as a stream: event-time day windows with a watermark, last value of the day inside the aggregate.

Pings later than the watermark are dropped by the stream; recomputing the day in batch (sources.fleet.raw_rollup) is the
backfill. Update mode writes days as they change, append mode only days that the watermark has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ping_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Pings of a folder of Parquet files in the driver's event layout. Watermarks need a timestamp with time zone."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    e = reader.parquet(path)
    return e.select(F.col("user_id").cast("string").alias("vehicle_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value", F.col("event_id").alias("tie"))


def daily(pings: DataFrame, watermark: str = "2 days") -> DataFrame:
    kind = F.col("kind")
    n = lambda k: F.sum(F.when(kind == k, 1).otherwise(0)).cast("long")
    last = F.max_by(F.when(kind == "view", F.struct("value")), F.when(kind == "view", F.struct("ts", "tie")))["value"]
    rows = pings.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("day"), "vehicle_id")
    rows = rows.agg(n("view").alias("n_view"), n("click").alias("n_click"), n("purchase").alias("n_purchase"), n("signup").alias("n_signup"), last.alias("level_view"), F.max("value").alias("max_value"))
    return rows.withColumn("date", F.to_date("day.start")).drop("day")


def to_files(df: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Closed days appended to Parquet by month, exactly once by the file sink's log."""
    w = df.withColumn("month", F.date_format("date", "yyyy-MM")).writeStream.format("parquet").outputMode("append").partitionBy("month")
    w = w.option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()


def upsert_days(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Vehicle-days as they change, in Parquet by date. Update mode: a batch holds only the days that it has changed, and the
    watermark evicts closed days from the state. A batch reads the dates it touches, replaces its own vehicle-days in them, and
    overwrites those dates alone; what is to be written is staged first, so a batch that is run again gives the same."""
    keys = ["vehicle_id", "date"]

    def write(batch: DataFrame, number: int) -> None:
        spark, staged = batch.sparkSession, f"{path}_staged/{number}"
        new = batch.persist()
        merged = new
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(where):
            old = spark.read.schema(batch.schema).parquet(path).join(new.select("date").distinct(), "date", "left_semi")
            merged = new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
        merged.write.mode("overwrite").parquet(staged)
        new.unpersist()
        kept = spark.read.schema(batch.schema).parquet(staged)
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
