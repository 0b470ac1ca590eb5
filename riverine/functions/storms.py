"""Design storms: SCS mass curves stretched to a duration, and rain series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .numeric import interpolate

# Hours and cumulative fractions of the 24-hour SCS distributions.
HOURS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11.5, 11.75, 12, 12.5, 13, 14, 15, 16, 18, 20, 22, 24)
FRACTIONS = {
    "II": (0, 0.011, 0.022, 0.035, 0.048, 0.063, 0.080, 0.099, 0.120, 0.147, 0.181, 0.235, 0.283, 0.357, 0.663, 0.735, 0.772, 0.820, 0.854, 0.880, 0.921, 0.952, 0.977, 1),
    "III": (0, 0.010, 0.020, 0.031, 0.043, 0.057, 0.072, 0.089, 0.115, 0.148, 0.189, 0.250, 0.298, 0.339, 0.500, 0.702, 0.751, 0.811, 0.849, 0.886, 0.927, 0.957, 0.980, 1),
}


def hours_of(duration: str) -> float:
    """'24-hr', '60-min', '2-day' in hours."""
    n, _, unit = duration.partition("-")
    for start, factor in (("min", 1 / 60), ("hr", 1), ("hour", 1), ("day", 24)):
        if unit.startswith(start):
            return float(n) * factor
    raise ValueError(f"unknown duration {duration!r}")


def hyetograph(spark: SparkSession, depth_mm: float, storm: str = "III", duration: str = "24-hr", step_min: int = 6, start: str = "2000-01-01 00:00:00", unit: str = "MM") -> DataFrame:
    """rain_gage, date, value (depth per hour over each step), with a zero at the end; the depth is conserved."""
    if storm not in FRACTIONS:
        raise ValueError(f"no storm type {storm!r}")
    hours = hours_of(duration)
    steps = hours * 60 / step_min if step_min > 0 else 0
    if steps <= 0 or steps != int(steps):
        raise ValueError(f"a step of {step_min} min doesn't divide {duration}")
    depth = depth_mm if unit == "MM" else depth_mm / 25.4
    at = [h / 24 * hours for h in HOURS]
    edge = lambda i: interpolate(i * (hours / steps), at, FRACTIONS[storm]) * depth
    i = F.col("id")
    value = F.when(i < int(steps), (edge(i + 1) - edge(i)) / (step_min / 60)).otherwise(0.0)
    date = F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(mins=(i * step_min).cast("int"))
    return spark.range(int(steps) + 1).select(F.lit(1).alias("rain_gage"), date.alias("date"), value.alias("value"))


def interval_minutes(series: DataFrame, date: str = "date", by: str = "rain_gage") -> DataFrame:
    """(by, minutes): the most frequent step of each series (ties: the shorter)."""
    from pyspark.sql import Window

    gap = F.timestamp_diff("SECOND", F.lag(date).over(Window.partitionBy(by).orderBy(date)), F.col(date)) / 60
    n = series.withColumn("minutes", gap).where("minutes is not null").groupBy(by, "minutes").agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), "minutes")).alias("m")).select(by, F.col("m.minutes").alias("minutes"))


def window(series: DataFrame, tail_hours: int, date: str = "date") -> DataFrame:
    """(start, stop): from the first to the last date plus a tail."""
    return series.agg(F.min(date).alias("start"), (F.max(date) + F.make_dt_interval(hours=F.lit(tail_hours))).alias("stop"))
