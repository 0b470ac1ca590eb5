"""Rain gauges as a stream: late readings, fixed windows, storms as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "rain_gage int, date timestamp, value double"


def readings(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A stream of Parquet files of readings as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def depths(stream: DataFrame, width: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """rain_gage, start, depth, n of each window; readings later than the watermark don't count."""
    w = stream.withWatermark("date", late).groupBy("rain_gage", F.window("date", width)).agg(F.sum("value").alias("depth"), F.count("*").alias("n"))
    return w.select("rain_gage", F.col("window.start").alias("start"), "depth", "n")


def storms(stream: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """rain_gage, start, stop, depth, peak of each storm: wet readings no more than a gap apart."""
    s = stream.withWatermark("date", late).where("value > 0").groupBy("rain_gage", F.session_window("date", gap)).agg(F.sum("value").alias("depth"), F.max("value").alias("peak"))
    return s.select("rain_gage", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "depth", "peak")
