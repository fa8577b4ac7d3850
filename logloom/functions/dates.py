"""Dates and times in lines (an extension): the first date and time of a line, and the time between lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rx

#: What finds a date and time; the first that reads as one counts.
PATTERNS = [r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?", rx.NGINX_DATETIME]


def line_time(raw: Column) -> Column:
    """The first date and time that a line shows, as a timestamp without a zone; null where there is none or none such exists."""
    out = F.lit(None).cast("timestamp_ntz")
    for pattern in reversed(PATTERNS):
        found = F.replace(F.replace(F.regexp_extract(raw, rx.java(pattern), 0), F.lit("T"), F.lit(" ")), F.lit("/"), F.lit("-"))
        out = F.coalesce(F.when(found != "", found).try_cast("timestamp_ntz"), out)
    return out


#: Lines of a chunk that one window orders.
CHUNK = 8192


def since_line_before(lines: DataFrame, raw: str = "raw", by: tuple = ("stream_id",), chunk: int = CHUNK) -> DataFrame:
    """lines with time and seconds since the line before that shows a time.

    In two levels: within chunks of lines, and from chunk to chunk by the last time that each shows.
    """
    d = lines.withColumn("time", line_time(F.col(raw))).withColumn("_chunk", F.expr(f"line_no div {chunk}"))
    last = d.groupBy(*by, "_chunk").agg(F.max_by("time", F.when(F.col("time").isNotNull(), F.col("line_no"))).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*by, "_chunk", F.last("_last", True).over(earlier).alias("_carried"))
    inner = F.last("time", True).over(Window.partitionBy(*by, "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_before", inner).join(last, [*by, "_chunk"])
    return d.withColumn("seconds", F.timestamp_diff("MICROSECOND", F.coalesce("_before", "_carried"), F.col("time")) / 1e6).drop("_chunk", "_before", "_carried")
