"""A store of lines in chunks, with a manifest that knows what has been evicted.

Lines lie in Parquet by stream and chunk. The manifest has a row for what each append added to a chunk (lines and bytes), and
a tombstone for each evicted one; it is only ever added to, and a write of it is what makes an append or an eviction
count. Chunks' files go after their tombstones are written, so a failure in between loses nothing that still counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.search import CHUNK_LINES

#: Fixed value: what a line shows whose chunk has been evicted.
EVICTED = "[line evicted from disk cache]"
MANIFEST = "stream_id string, chunk_id long, lines long, bytes long, last_line long, evicted boolean"
LINES = "line_no long, text string, stream_id string, chunk_id long"


class Store:
    def __init__(self, spark: SparkSession, base: str, chunk: int = CHUNK_LINES) -> None:
        self.spark, self.base, self.chunk = spark, base, chunk

    def _add(self, rows: DataFrame) -> None:
        rows.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in MANIFEST.split(", ")]).coalesce(1).write.parquet(f"{self.base}/manifest/{uuid.uuid4().hex}")

    def append(self, lines: DataFrame) -> None:
        """Adds (stream_id, line_no, text); numbers that were not there before."""
        d = lines.select("line_no", "text", "stream_id", F.expr(f"line_no div {self.chunk}").alias("chunk_id"))
        part = uuid.uuid4().hex
        d.repartition("stream_id", "chunk_id").sortWithinPartitions("line_no").write.partitionBy("stream_id", "chunk_id").parquet(f"{self.base}/data/{part}")
        d = self.spark.read.schema(LINES).parquet(f"{self.base}/data/{part}")
        self._add(d.groupBy("stream_id", "chunk_id").agg(F.count("*").alias("lines"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.max("line_no").alias("last_line"), F.lit(False).alias("evicted")))

    def chunks(self) -> DataFrame:
        """(stream_id, chunk_id, lines, bytes, last_line, evicted): one row a chunk, by the manifest alone."""
        d = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.base}/manifest")
        return d.groupBy("stream_id", "chunk_id").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.max("last_line").alias("last_line"), F.max("evicted").alias("evicted"))

    def evict(self, max_bytes: int) -> int:
        """Evicts the oldest chunks of each stream until max_bytes are left; the newest chunk stays. Returns how many went."""
        newer = Window.partitionBy("stream_id").orderBy(F.desc("chunk_id"))
        live = self.chunks().where("not evicted").withColumn("_upto", F.sum("bytes").over(newer)).withColumn("_nth", F.row_number().over(newer))
        gone = live.where((F.col("_upto") > max_bytes) & (F.col("_nth") > 1)).select("stream_id", "chunk_id").collect()
        if gone:
            tombs = self.spark.createDataFrame([(r[0], r[1], 0, 0, None, True) for r in gone], MANIFEST)
            self._add(tombs)
            self._delete(gone)
        return len(gone)

    def _delete(self, gone: list) -> None:
        """Files of evicted chunks; those that a failure has left behind are found by the next call."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration())
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for part in fs.listStatus(hadoop(f"{self.base}/data")):
            for stream, chunk in gone:
                fs.delete(hadoop(f"{part.getPath().toString()}/stream_id={escape(stream)}/chunk_id={chunk}"), True)

    def lines(self) -> DataFrame:
        """All lines that are left."""
        d = self.spark.read.schema(LINES)
        parts = [r.getPath().toString() for r in self._parts()]
        out = None
        for p in parts:
            one = d.parquet(p)
            out = one if out is None else out.unionByName(one)
        gone = self.chunks().where("evicted").select("stream_id", "chunk_id")
        return out.join(gone, ["stream_id", "chunk_id"], "left_anti")

    def _parts(self) -> list:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        return list(hadoop(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(hadoop(f"{self.base}/data")))

    def get(self, stream_id: str, line_no: int) -> DataFrame:
        """(stream_id, line_no, text, evicted): the line, from its chunk alone; a placeholder where it has been evicted; no row where there was none."""
        k = line_no // self.chunk
        known = self.chunks().where((F.col("stream_id") == stream_id) & (F.col("chunk_id") == k)).first()
        if known and known["evicted"]:
            gone = [(stream_id, line_no, EVICTED, True)] if line_no <= known["last_line"] else []
            return self.spark.createDataFrame(gone, "stream_id string, line_no long, text string, evicted boolean")
        here = (F.col("stream_id") == stream_id) & (F.col("chunk_id") == k) & (F.col("line_no") == line_no)
        d = self.spark.read.schema(LINES)
        found = [d.parquet(p.getPath().toString()).where(here) for p in self._parts()]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.select("stream_id", "line_no", "text", F.lit(False).alias("evicted"))
