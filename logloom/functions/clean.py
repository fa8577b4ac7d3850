"""Cleaning of raw lines, as projections: lag prefix, ANSI escapes, control bytes, tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rx

LAG_PREFIX = r"^\[LLB:([+-]?[0-9]{1,19})\] ?"


def lag_nanos(raw: Column) -> Column:
    """Nanoseconds of a `[LLB:<int64>] ` prefix, or null."""
    return F.regexp_extract(raw, LAG_PREFIX, 1).try_cast("bigint")


def strip_lag_prefix(raw: Column) -> Column:
    """The line without a well-formed lag prefix and one blank after it; other lines as they are."""
    return F.when(lag_nanos(raw).isNotNull(), F.regexp_replace(raw, LAG_PREFIX, "")).otherwise(raw)


def add_lag_prefix(raw: Column, nanos: Column) -> Column:
    return F.concat(F.lit("[LLB:"), nanos.cast("string"), F.lit("] "), raw)


def strip_ansi(raw: Column) -> Column:
    return F.when(F.contains(raw, F.lit("\x1b")), F.regexp_replace(raw, rx.ANSI, "")).otherwise(raw)


def sanitize(raw: Column) -> Column:
    """Control bytes but tab and newline become `?`."""
    return F.regexp_replace(raw, r"[\x00-\x08\x0B-\x1F\x7F]", "?")


def _tabbed(raw: Column, width: int) -> Column:
    """out: the line with its tabs filled to stops of `width` columns; gaps: (start, end) of each filled tab, in characters."""
    cells = F.split(raw, "\t")
    start = F.struct(F.lit("").alias("out"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("gaps"), F.lit(True).alias("first"))

    def step(s: Column, cell: Column) -> Column:
        at = F.length(s["out"])
        to = ((at / width).cast("int") + 1) * width
        gap = F.struct(at.alias("start"), to.alias("end"))
        return F.when(s["first"], F.struct(cell.alias("out"), s["gaps"].alias("gaps"), F.lit(False).alias("first"))).otherwise(
            F.struct(F.concat(s["out"], F.repeat(F.lit(" "), to - at), cell).alias("out"), F.concat(s["gaps"], F.array(gap)).alias("gaps"), F.lit(False).alias("first"))
        )

    return F.aggregate(cells, start, step)


def expand_tabs(raw: Column, width: int = 8) -> Column:
    """struct<out, gaps, first>; lines without tabs skip the work."""
    plain = F.struct(raw.alias("out"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("gaps"), F.lit(False).alias("first"))
    return F.when(F.contains(raw, F.lit("\t")), _tabbed(raw, width)).otherwise(plain)


def clean_lines(lines: DataFrame, text: str = "text", bench: bool = False) -> DataFrame:
    """lines with raw (cleaned text), tab_gaps, and lag_ns where bench is set. One trailing CR goes."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\z", "")
    out = lines.withColumn("lag_ns", lag_nanos(t)) if bench else lines
    t = strip_lag_prefix(t) if bench else t
    out = out.withColumn("_tabs", expand_tabs(sanitize(strip_ansi(t))))
    return out.withColumn("raw", F.col("_tabs.out")).withColumn("tab_gaps", F.col("_tabs.gaps")).drop("_tabs")
