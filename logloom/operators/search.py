"""Search with wrap-around, paging by visual rows, and point look-ups over an ordered stream of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import matches

CHUNK_LINES = 8192


def search_next(lines: DataFrame, query: str, start: int) -> DataFrame:
    """line_no of the first match at or after start, else the first before it; -1 if none. Hidden lines are searched too."""
    return _first(lines, query, (F.col("line_no") < start).cast("int"), F.col("line_no").asc())


def search_prev(lines: DataFrame, query: str, start: int) -> DataFrame:
    """line_no of the last match at or before start, else the last after it; -1 if none."""
    return _first(lines, query, (F.col("line_no") > start).cast("int"), F.col("line_no").desc())


def _first(lines: DataFrame, query: str, wrapped: Column, order: Column) -> DataFrame:
    found = lines.where(matches(F.col("raw"), query)).orderBy(wrapped, order).limit(1)
    return found.agg(F.coalesce(F.max("line_no"), F.lit(-1)).cast("long").alias("line_no"))


def point(lines: DataFrame, line_no: int) -> DataFrame:
    """The line of a number. Lines written by chunk are pruned to one chunk."""
    out = lines.where(F.col("line_no") == line_no)
    return out.where(F.col("chunk_id") == line_no // CHUNK_LINES) if "chunk_id" in lines.columns else out


def with_chunks(lines: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    return lines.withColumn("chunk_id", F.expr(f"line_no div {size}"))


def retain(lines: DataFrame, max_bytes: int, chunk: int = CHUNK_LINES) -> DataFrame:
    """Lines of the newest chunks of each stream that fit in max_bytes; older chunks go whole, the newest stays."""
    sizes = with_chunks(lines, chunk).groupBy("stream_id", "chunk_id").agg(F.sum(F.octet_length("raw")).alias("_bytes"))
    newer = Window.partitionBy("stream_id").orderBy(F.desc("chunk_id"))
    kept = sizes.withColumn("_upto", F.sum("_bytes").over(newer)).withColumn("_nth", F.row_number().over(newer)).where((F.col("_upto") <= max_bytes) | (F.col("_nth") == 1))
    return with_chunks(lines, chunk).join(kept.select("stream_id", "chunk_id"), ["stream_id", "chunk_id"], "left_semi")


def rows_of(raw: Column, width: int, wrap: bool = True, hidden: Column | None = None, tree_rows: Column | None = None, one_row: Column | None = None) -> Column:
    """Visual rows of a line: 0 if hidden, 1 + descendants if expanded, 1 without wrapping, else ceil((3 + bytes) / width)."""
    flat = F.greatest(F.lit(1), F.ceil((F.octet_length(raw) + 3) / F.lit(width))) if wrap and width > 0 else F.lit(1)
    if one_row is not None:
        flat = F.when(one_row, 1).otherwise(flat)
    if tree_rows is not None:
        flat = F.when(tree_rows > 0, tree_rows + 1).otherwise(flat)
    return (F.when(hidden, 0).otherwise(flat) if hidden is not None else flat).cast("long")


def with_prefix(lines: DataFrame, rows: str = "rows", span: int = CHUNK_LINES) -> DataFrame:
    """lines with upto: rows of the stream before and with each line.

    In two levels, so that no task orders a whole stream: sums within chunks of `span` lines, and a running sum over the
    chunks' totals, of which there are few.
    """
    d = with_chunks(lines, span)
    inner = F.sum(rows).over(Window.partitionBy("stream_id", "chunk_id").orderBy("line_no"))
    totals = d.groupBy("stream_id", "chunk_id").agg(F.sum(rows).alias("_total"))
    before = F.sum("_total").over(Window.partitionBy("stream_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1))
    return d.join(totals.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_total"), ["stream_id", "chunk_id"]).withColumn("upto", inner + F.col("_before")).drop("_before", "chunk_id")


def with_peak(lines: DataFrame, value: str, span: int = CHUNK_LINES) -> DataFrame:
    """lines with peak: the greatest value of the stream up to each line, in two levels as in with_prefix(). Null values don't count."""
    d = with_chunks(lines, span)
    order = Window.partitionBy("stream_id", "chunk_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    most = d.groupBy("stream_id", "chunk_id").agg(F.max(value).alias("_most"))
    before = F.max("_most").over(Window.partitionBy("stream_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1))
    out = d.join(most.withColumn("_before", before).drop("_most"), ["stream_id", "chunk_id"])
    return out.withColumn("peak", F.greatest(F.max(value).over(order), "_before")).drop("_before", "chunk_id")


def find_row(prefixed: DataFrame, target: int) -> DataFrame:
    """For each stream, the least line whose upto exceeds target; past the last line if none does."""
    return prefixed.groupBy("stream_id").agg(F.coalesce(F.min(F.when(F.col("upto") > target, F.col("line_no"))), F.max("line_no") + 1).alias("line_no"))


def page(prefixed: DataFrame, top_row: int, height: int, rows: str = "rows") -> DataFrame:
    """The lines of which a row lies in [top_row, top_row + height)."""
    return prefixed.where((F.col("upto") > top_row) & (F.col("upto") - F.col(rows) < top_row + height) & (F.col(rows) > 0))


def last_before(lines: DataFrame, cutoff: int, n: int) -> DataFrame:
    return lines.where((F.col("line_no") >= max(0, cutoff - n)) & (F.col("line_no") < cutoff))
