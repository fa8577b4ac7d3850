"""A stored index of the rows that lines take: sums of blocks of lines, of blocks of blocks, and so on.

A change of one line changes one sum on each level, which is added as a difference; nothing is summed up anew. A look-up reads
one block's parts on each level, FAN rows at most. compact() folds the differences in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 256
SCHEMA = "stream_id string, block long, total long, level int"


class PrefixIndex:
    """Levels count from 0, the lines; the parts of block b of a level are blocks b * FAN .. b * FAN + FAN - 1 of the level below."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, lines: DataFrame, path: str, rows: str = "rows") -> PrefixIndex:
        """Of (stream_id, line_no, rows), a line once. Written to path."""
        out = cls(lines.sparkSession, path)
        levels = [lines.select("stream_id", F.col("line_no").alias("block"), F.col(rows).cast("long").alias("total"))]
        last = lines.agg(F.max("line_no")).first()[0]
        out._write(levels[0], 0, f"{path}/base")
        while (last or 0) >= FAN ** len(levels):
            below = out.spark.read.schema("stream_id string, block long, total long").parquet(f"{path}/base/level={len(levels) - 1}")
            levels.append(below.groupBy("stream_id", F.expr(f"block div {FAN}").alias("block")).agg(F.sum("total").alias("total")))
            out._write(levels[-1], len(levels) - 1, f"{path}/base")
        return out

    @staticmethod
    def _write(d: DataFrame, level: int, path: str) -> None:
        d.repartitionByRange("stream_id", "block").sortWithinPartitions("stream_id", "block").write.parquet(f"{path}/level={level}")

    def _sums(self) -> DataFrame:
        """All sums as they stand, base and differences."""
        base = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/base")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/changes")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return base
        return base.unionByName(self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{self.path}/changes"))

    @property
    def top(self) -> int:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/base").agg(F.max("level")).first()[0] or 0

    def change(self, changes: DataFrame, rows: str = "rows") -> None:
        """Lines (stream_id, line_no, rows) that take other rows than before, such as after a fold or an expansion; each once."""
        new = changes.select("stream_id", F.col("line_no").alias("block"), F.col(rows).cast("long").alias("_new"))
        now = self._sums().where("level = 0").join(F.broadcast(new), ["stream_id", "block"]).groupBy("stream_id", "block").agg((F.max("_new") - F.sum("total")).alias("total"))
        levels = F.explode(F.sequence(F.lit(0), F.lit(self.top))).alias("level")
        each = now.where("total <> 0").select("stream_id", "block", "total", levels)
        power = F.pow(F.lit(FAN), F.col("level")).cast("long")
        each = each.select("stream_id", F.expr("block").alias("_line"), "total", "level", power.alias("_span"))
        each.groupBy("stream_id", F.expr("_line div _span").alias("block"), "level").agg(F.sum("total").alias("total")).select("stream_id", "block", "total", "level").coalesce(1).write.parquet(f"{self.path}/changes/{uuid.uuid4().hex}")

    def _parts(self, stream_id: str, level: int, block: int | None) -> list[tuple[int, int]]:
        """(block, sum) of the parts of a block of the level above, or of all of the top level."""
        d = self._sums().where((F.col("level") == level) & (F.col("stream_id") == stream_id))
        if block is not None:
            d = d.where(F.col("block").between(block * FAN, block * FAN + FAN - 1))
        return sorted((r["block"], r["s"]) for r in d.groupBy("block").agg(F.sum("total").alias("s")).collect())

    def upto(self, stream_id: str, line_no: int) -> int:
        """Rows of the lines before line_no."""
        out, block = 0, None
        for level in range(self.top, -1, -1):
            own = line_no // FAN**level
            out += sum(s for b, s in self._parts(stream_id, level, block) if b < own)
            block = own
        return out

    def find(self, stream_id: str, row: int) -> int | None:
        """The line that a row lies in; past the last line if there are fewer rows, None for an unknown stream."""
        block, left = None, row
        for level in range(self.top, -1, -1):
            parts = self._parts(stream_id, level, block)
            for b, s in parts:
                if left < s:
                    block = b
                    break
                left -= s
            else:
                last = self._sums().where((F.col("level") == 0) & (F.col("stream_id") == stream_id)).agg(F.max("block")).first()[0]
                return None if last is None else last + 1
        return block

    def compact(self, path: str) -> PrefixIndex:
        """The same index at a new path, with the differences folded in."""
        for level in range(self.top + 1):
            self._write(self._sums().where(F.col("level") == level).groupBy("stream_id", "block").agg(F.sum("total").alias("total")), level, f"{path}/base")
        return PrefixIndex(self.spark, path)
