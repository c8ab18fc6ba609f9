"""Histograms and summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import casts
from lattica.functions import reducers as R
from lattica.functions.cells import _flag
from lattica.operators.positions import order_struct


def histogram(df: DataFrame, v: str, step: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bucket_low, bucket_high, n): buckets [s, s + step) from low, the last one closed at high; empty ones count 0.

    Bounds default to the least and greatest value. Values outside are ignored; low = high or no values give no buckets.
    """
    if low is None or high is None:
        least, greatest = df.agg(F.min(v), F.max(v)).first()
        low, high = least if low is None else low, greatest if high is None else high
    n = math.ceil((high - low) / step) if low is not None and high is not None and high > low else 0
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "bucket_low double, bucket_high double, n bigint")
    at = F.least(F.floor((F.col(v) - F.lit(low)) / F.lit(step)), F.lit(n - 1)).cast("long")
    counts = df.where((F.col(v) >= low) & (F.col(v) <= high)).groupBy(at.alias("id")).agg(F.count("*").alias("n"))
    start = F.lit(float(low)) + F.col("id") * F.lit(float(step))
    return spark.range(n).join(counts, "id", "left").select(start.alias("bucket_low"), F.least(start + F.lit(float(step)), F.lit(float(high))).alias("bucket_high"), F.coalesce("n", F.lit(0)).alias("n"))


def summary(frame) -> DataFrame:
    """(column, Mean, Median, Max, Min, and their flags) of each column read as a number; one pass over the rows."""
    order = order_struct(frame.order)
    kinds = (("Mean", R.Mean()), ("Median", R.Median()), ("Max", R.Max()), ("Min", R.Min()))
    aggs, entries = [], []
    for i, c in enumerate(frame.columns):
        cell = casts.cast(c.cell, frame._kind(c), "double")[0]
        got = [(name, r.agg(cell, order)) for name, r in kinds]
        aggs += [g.v.cast("double").alias(f"{name}{i}") for name, g in got] + [_flag(got[0][1].nm).alias(f"nm{i}")]
        entries.append(F.struct(F.lit(str(c.key)).alias("column"), *(F.col(f"{name}{i}").alias(name) for name, _ in kinds), F.col(f"nm{i}").alias("nm")))
    return frame.df.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
