"""Latency histograms with 64 parts to a power of two, percentiles, throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = 64


def bucket(ns: Column) -> Column:
    """Power of two and its part; exact for all longs, 0 for 0."""
    power = F.length(F.bin(ns)) - 1
    base = F.pow(F.lit(2.0), power).cast("long")
    part = F.floor(((ns - base) * PARTS) / base)
    return F.when(ns == 0, 0).otherwise(power * PARTS + part).cast("long")


def bucket_low(b: Column) -> Column:
    """Least value of a bucket."""
    base = F.pow(F.lit(2.0), F.floor(b / PARTS)).cast("long")
    return (base + F.floor((b % PARTS) * base / PARTS)).cast("long")


def histogram(samples: DataFrame, column: str) -> DataFrame:
    return samples.groupBy(bucket(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))


def full_histogram(samples: DataFrame, column: str, *keys: str) -> DataFrame:
    """``keys, bucket, n, total, least, most``: a histogram that can be merged with others and still knows sum, minimum and maximum."""
    value = F.col(column)
    return samples.groupBy(*keys, bucket(value).alias("bucket")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def merged_histogram(parts: DataFrame, *keys: str) -> DataFrame:
    """Histograms added up, by ``keys`` and bucket."""
    return parts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def histogram_stats(hist: DataFrame, *keys: str) -> DataFrame:
    """``keys, n, total, least, most, mean`` of histograms."""
    out = hist.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    return out.withColumn("mean", F.col("total") / F.col("n"))


def _targets(spark: SparkSession, percents: Sequence[float]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(float(p),) for p in percents], "percentile double"))


def histogram_percentiles(samples: DataFrame, column: str, percents: Sequence[float]) -> DataFrame:
    """For each percentile, the low end of the first bucket at which the running count reaches its share (rounded down, 1 at least)."""
    # at most 64 * 64 buckets, whatever the number of samples
    counts = histogram(samples, column)
    so_far = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select("bucket", F.sum("n").over(so_far).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    want = _targets(samples.sparkSession, percents)
    reached = counts.crossJoin(want).where(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("total") * F.col("percentile") / 100)))
    return reached.groupBy("percentile").agg(F.min("bucket").alias("b")).select("percentile", bucket_low(F.col("b")).alias("latency"))


def sample_percentiles(samples: DataFrame, column: str, percents: Sequence[float]) -> DataFrame:
    """The sorted sample at index floor(n * p / 100): the bucket is found first, and only its rows are sorted."""
    counts = histogram(samples, column)
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select("bucket", "n", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    want = _targets(samples.sparkSession, percents)
    at = counts.crossJoin(want).withColumn("idx", F.least(F.floor(F.col("total") * F.col("percentile") / 100), F.col("total") - 1))
    at = at.where("idx < upto and idx >= upto - n").select("bucket", "percentile", (F.col("idx") - F.col("upto") + F.col("n")).alias("nth"))
    rows = samples.select(F.col(column).alias("latency")).withColumn("bucket", bucket(F.col("latency")))
    rows = rows.join(F.broadcast(at.select("bucket").distinct()), "bucket")
    rows = rows.withColumn("nth", (F.row_number().over(Window.partitionBy("bucket").orderBy("latency")) - 1).cast("long"))
    return rows.join(F.broadcast(at), ["bucket", "nth"]).select("percentile", "latency")


def throughput(events: DataFrame, time: str, width: str) -> DataFrame:
    w = F.window(F.col(time).cast("timestamp"), width)
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("start"), "n", "bytes")


def amplification(samples: DataFrame, column: str, active: str) -> DataFrame:
    """99th percentile while ``active`` over that while not."""
    q = lambda c: F.percentile(F.when(c, F.col(column)), 0.99)
    out = samples.agg(q(F.col(active)).alias("during"), q(~F.col(active)).alias("quiet"))
    return out.withColumn("ratio", F.round(F.col("during") / F.col("quiet"), 6))
