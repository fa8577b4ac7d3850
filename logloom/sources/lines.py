"""Sources of numbered lines, and sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.search import CHUNK_LINES
from .shared import written


def read_text(spark: SparkSession, path: str, stream_id: str | None = None, source: str = "stdin") -> DataFrame:
    """Lines of text files, split at newlines only and one trailing CR dropped; a stream for each file unless named.

    Line numbers are by place in the file: Spark reads a file's splits in order, so numbers are running counts over
    splits, made in two passes without moving the lines.
    """
    d = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", r"\r\z", "").alias("text"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )
    in_split = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_id")) - 1
    counts = d.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_k", in_split).join(counts.withColumn("_before", before).drop("_n"), ["_file", "_block"])
    return d.select((F.lit(stream_id) if stream_id else F.col("_file")).alias("stream_id"), (F.col("_before") + F.col("_k")).alias("line_no"), "text", F.lit(source).alias("source"))


#: Bytes of input to a range of rows.
RANGE_BYTES = 128 << 20


def _parts(d: DataFrame) -> int | None:
    """Ranges that d's size asks for; None: no more than the shuffle partitions, of which Spark joins small ones."""
    size = int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = size // RANGE_BYTES if size < 1 << 56 else 0
    return n if n > int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def lines_from_df(df: DataFrame, text: str | Column, order: list, stream: str | Column | None = None, source: str = "stdin", split: bool = False, ranges: int | None = None) -> DataFrame:
    """Any DataFrame's text column as streams of lines, numbered by order (of any types); split: texts are cut at newlines first.

    Rows are dealt out to ranges of (stream, order), sorted there, and written once with their place in the range; a stream's
    lines before a range are the sum of its rows in earlier ones. No task holds more than a range, whatever a stream's
    length. ranges: how many; by the input's size unless given.
    """
    stream = F.lit("stream") if stream is None else F.col(stream) if isinstance(stream, str) else stream
    d = df.select(stream.cast("string").alias("stream_id"), (F.col(text) if isinstance(text, str) else text).alias("text"), *[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)])
    keys = ["stream_id", *(f"_o{i}" for i in range(len(order)))]
    if split:
        d = d.select(*keys, F.posexplode(F.split("text", "\n")).alias("_pos", "text"))
        keys.append("_pos")
    parts = ranges or _parts(d)
    d = d.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    # an id's lower 33 bits are the row's place in its partition, as it is written
    d = written(d.select("stream_id", "text", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")))
    counts = d.groupBy("stream_id", "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("stream_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("stream_id").alias("_stream"), F.col("_range").alias("_own"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_add"))
    d = d.join(counts, F.col("stream_id").eqNullSafe(F.col("_stream")) & (F.col("_range") == F.col("_own")))
    return d.select("stream_id", (F.col("_add") + F.col("_place")).cast("long").alias("line_no"), "text", F.lit(source).alias("source"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores if it comes in fewer partitions, such as one small file: for costly work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def merged(*sources: DataFrame) -> DataFrame:
    """Several tagged sources as one; from_stderr follows the source."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.withColumn("from_stderr", F.col("source") == "stderr")


def stream_text(spark: SparkSession, path: str, stream_id: str = "stream", files_per_trigger: int = 1) -> DataFrame:
    """Lines of text files as they arrive. Numbers are given downstream, by the stateful fold."""
    return spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.lit(stream_id).alias("stream_id"), F.regexp_replace("value", r"\r\z", "").alias("text"))


def write_chunked(lines: DataFrame, path: str) -> None:
    """Parquet by stream and chunk of lines, so that look-ups by number read one chunk."""
    lines.withColumn("chunk_id", F.expr(f"line_no div {CHUNK_LINES}")).repartition("stream_id", "chunk_id").sortWithinPartitions("line_no").write.mode("append").partitionBy("stream_id", "chunk_id").parquet(path)


def parse_size(text: str) -> int:
    """Bytes of `512`, `64K`, `512M` or `2G`; positive numbers only."""
    m = re.fullmatch(r"\s*(\d+)\s*([KMGkmg]?)[Bb]?\s*", text)
    if not m or not int(m[1]):
        raise ValueError(f"not a positive size: {text!r}")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2].upper()]
