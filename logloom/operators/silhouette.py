"""A stream's outline: lines scaled to rows of cells, with the extent of text and the worst outcome of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAST = 4096


def last_lines(lines: DataFrame, n: int = LAST) -> DataFrame:
    """The last n lines of each stream, with i counted from their first; max_col is of the whole stream."""
    ends = lines.groupBy("stream_id").agg(F.max("line_no").alias("_last"), F.max("ext_end").alias("max_col"))
    d = lines.join(ends, "stream_id").where(F.col("line_no") > F.col("_last") - n)
    first = F.greatest(F.lit(0), F.col("_last") - (n - 1))
    return d.withColumn("i", F.col("line_no") - first).withColumn("total", F.col("_last") - first + 1).drop("_last")


def silhouette(lines: DataFrame, height: int, width: int, n: int = LAST) -> DataFrame:
    """(stream_id, row, sub_row, beg, end, status) of lines with ext_beg, ext_end and status; blank lines (beg -1) leave no mark.

    Four sub-rows a row and two sub-columns a cell; neither scale exceeds 1. status is the row's.
    """
    sub, cols = height * 4, width * 2
    d = last_lines(lines, n).where("ext_beg >= 0")
    v = F.least(F.lit(1.0), F.lit(float(sub)) / F.col("total"))
    h = F.least(F.lit(1.0), F.lit(float(cols)) / F.greatest(F.lit(1), F.col("max_col")))
    at = F.least(F.lit(sub - 1), F.floor(F.col("i") * v))
    beg = F.floor(F.col("ext_beg") * h)
    end = F.least(F.lit(cols), F.greatest(F.floor(F.col("ext_end") * h), beg + 1))
    d = d.select("stream_id", at.cast("int").alias("at"), beg.cast("int").alias("beg"), end.cast("int").alias("end"), "status")
    d = d.groupBy("stream_id", "at").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.max("status").alias("status"))
    rows = d.groupBy("stream_id", F.expr("at div 4").alias("row")).agg(F.max("status").alias("status"))
    return d.select("stream_id", F.expr("at div 4").alias("row"), (F.col("at") % 4).alias("sub_row"), "beg", "end").join(rows, ["stream_id", "row"])


def braille(marks: DataFrame, width: int) -> DataFrame:
    """(stream_id, row, status, cells): Braille cells of silhouette() rows; dot k of a column is sub-row k."""
    left, right = (0x01, 0x02, 0x04, 0x40), (0x08, 0x10, 0x20, 0x80)
    d = marks.groupBy("stream_id", "row").agg(F.max("status").alias("status"), F.collect_list(F.struct("sub_row", "beg", "end")).alias("_m"))

    def covers(column, k):
        return lambda m: (m["sub_row"] == k) & (column >= m["beg"]) & (column < m["end"])

    def dots(cell):
        total = F.lit(0)
        for k in range(4):
            for side, bits in ((0, left), (1, right)):
                total = total + F.when(F.exists("_m", covers(cell * 2 + side, k)), bits[k]).otherwise(0)
        code = F.lit(0x2800) + total
        utf8 = F.concat(F.lit("E2"), F.hex(F.lit(0x80) + F.shiftright(F.shiftleft(code, 20), 26).bitwiseAND(0x3F)), F.hex(F.lit(0x80) + code.bitwiseAND(0x3F)))
        return F.decode(F.unhex(utf8), "UTF-8")

    return d.select("stream_id", "row", "status", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), dots), "").alias("cells"))
