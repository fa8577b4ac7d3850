"""Arrival rates and lags by buckets of time, and totals of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEPING_UP_MS = 100.0
LAG_TAG = r"^\[LLB:(\d+)\] "


def rate_windows(arrivals: DataFrame, seconds: float = 1.0, ts: str = "arrival_us", lag: str = "lag_ns", by: tuple = ("stream_id",)) -> DataFrame:
    """Lines, rate, tagged lines and lag percentiles (ms) of each bucket from the first arrival on. Empty buckets give no row.

    ts is in microseconds, lag in nanoseconds or null. A percentile is the element at floor((n - 1) * q) of the bucket's lags
    in order, without interpolation. Lags are counted by value first, so a bucket's memory is bounded whatever its rate.
    """
    first = arrivals.groupBy(*by).agg(F.min(ts).alias("_first"))
    d = arrivals.join(first, list(by)) if by else arrivals.crossJoin(F.broadcast(first))
    width = int(seconds * 1e6)
    d = d.withColumn("bucket", F.expr(f"({ts} - _first) div {width}"))
    values = d.groupBy(*by, "bucket", F.col(lag).alias("_lag")).agg(F.count("*").alias("_n"))
    bucket = Window.partitionBy(*by, "bucket")
    tagged = F.when(F.col("_lag").isNotNull(), F.col("_n")).otherwise(0)  # a null lag comes first and moves nothing
    values = values.withColumn("_upto", F.sum(tagged).over(bucket.orderBy(F.asc_nulls_first("_lag")))).withColumn("_tagged", F.sum(tagged).over(bucket))
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor((F.col("_tagged") - 1) * F.lit(q)), F.col("_lag"))) / 1e6
    g = values.groupBy(*by, "bucket").agg(F.sum("_n").alias("lines"), F.max("_tagged").alias("tagged"), at(0.5).alias("lag_p50_ms"), at(0.95).alias("lag_p95_ms"), at(0.99).alias("lag_p99_ms"), (F.max("_lag") / 1e6).alias("lag_max_ms"))
    return g.select(*by, "bucket", "lines", (F.col("lines") / seconds).alias("rate"), "tagged", "lag_p50_ms", "lag_p95_ms", "lag_p99_ms", "lag_max_ms")


#: Size of the lags' sketches; a percentile's rank is off by about 2.3 / SKETCH ** 0.97 of the lags, 0.35 %.
SKETCH = 800


def lag_sketch(lag: Column, k: int = SKETCH) -> Column:
    """An aggregate that keeps lags as a mergeable sketch of bounded size."""
    return F.kll_sketch_agg_bigint(lag, F.lit(k))


def sketch_percentiles(windows: DataFrame, sketch: str = "lags") -> DataFrame:
    """windows with lag percentiles (ms) out of a sketch, which goes; null where no line had a lag."""
    n = F.kll_sketch_get_n_bigint(sketch)
    at = lambda q: F.when(n > 0, F.kll_sketch_get_quantile_bigint(F.col(sketch), F.lit(q)) / 1e6)
    return windows.select("*", n.alias("tagged"), *[at(q / 100).alias(f"lag_p{q}_ms") for q in (50, 95, 99)]).drop(sketch)


def run_totals(windows: DataFrame, by: tuple = ("stream_id",), keeping_up_ms: float = KEEPING_UP_MS) -> DataFrame:
    """Lines, peak rate, peak rate of buckets that keep up, and greatest lag."""
    kept = F.when(F.col("lag_p95_ms") <= keeping_up_ms, F.col("rate"))
    return windows.groupBy(*by).agg(F.sum("lines").alias("lines"), F.max("rate").alias("peak_rate"), F.coalesce(F.max(kept), F.lit(0.0)).alias("peak_sustained_rate"), F.coalesce(F.max("lag_max_ms"), F.lit(0.0)).alias("max_lag_ms"))


def tagged_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """(stream_id, arrival_us, lag_ns) of lines whose prefix tells when they were written, in nanoseconds since 1970; arrival is the column arrival_us, or now."""
    written = F.regexp_extract(text, LAG_TAG, 1).try_cast("long")
    now = F.col("arrival_us") if "arrival_us" in lines.columns else F.unix_micros(F.current_timestamp())
    return lines.select("stream_id", now.alias("arrival_us"), written.alias("_written")).select("stream_id", "arrival_us", (F.col("arrival_us") * 1000 - F.col("_written")).alias("lag_ns"))


def as_text(windows: DataFrame, seconds: float = 1.0) -> DataFrame:
    """One key=value line for each bucket; t is its begin in seconds from the first arrival."""
    lag = F.format_string(" lag_p50_ms=%.3f lag_p95_ms=%.3f lag_p99_ms=%.3f lag_max_ms=%.3f", "lag_p50_ms", "lag_p95_ms", "lag_p99_ms", "lag_max_ms")
    head = F.format_string("rate_window t=%.3f lines=%d rate=%.0f tagged=%d", F.col("bucket") * F.lit(float(seconds)), "lines", "rate", "tagged")
    return windows.select(F.concat(head, F.when(F.col("tagged") > 0, lag).otherwise("")).alias("text"))


def totals_text(arrivals: DataFrame, windows: DataFrame, ts: str = "arrival_us", by: tuple = ("stream_id",), keeping_up_ms: float = KEEPING_UP_MS) -> DataFrame:
    """(by, ord, text): the key=value lines that end a run: lines, time from the first arrival to the last, throughput, and peaks."""
    span = arrivals.groupBy(*by).agg(((F.max(ts) - F.min(ts)) / 1000.0).alias("_ms"))
    d = run_totals(windows, by, keeping_up_ms).join(windows.groupBy(*by).agg(F.sum("tagged").alias("_tagged")), list(by)).join(span, list(by))
    lagged = F.col("_tagged") > 0
    texts = [
        F.format_string("ingest_lines=%d", "lines"),
        F.format_string("ingest_ms=%.3f", "_ms"),
        F.when(F.col("_ms") > 0, F.format_string("ingest_throughput_lines_per_sec=%.0f", F.try_divide(F.col("lines") * 1000.0, "_ms"))),
        F.format_string("peak_rate_per_sec=%.0f", "peak_rate"),
        F.when(lagged, F.format_string("tagged_lines=%d", "_tagged")),
        F.when(lagged, F.format_string("max_lag_ms=%.3f", "max_lag_ms")),
        F.when(lagged, F.format_string(f"peak_sustained_rate_per_sec=%.0f sustained_p95_threshold_ms={keeping_up_ms:.1f}", "peak_sustained_rate")),
    ]
    return d.select(*by, F.posexplode(F.array_compact(F.array(*texts))).alias("ord", "text"))
