"""A frequency statistic that begins while lines arrive: history up to a cutoff in batch, the stream from it on, each line once.

The cutoff of each stream of lines is read and written down when the statistic is registered, before anything is counted. The
batch part counts the last_n lines below it; the streaming part counts the lines from it on, whenever they came. Counts
of a batch are a folder named by the batch's id, so one that runs again after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.freq import Stat, exact_label, fast_label, rule_index, titled

COUNTS = "rule_idx int, label string, cnt long, batch long"
#: The folder of what was counted before the cutoff.
HISTORY = -1


def _counts(lines: DataFrame, stat: Stat, exact: bool) -> DataFrame:
    label = (exact_label if exact else fast_label)(F.col("json"), stat.path)
    d = lines.where("line_type = 'json' and json is not null").select(label.alias("label")).where("label is not null")
    idx = rule_index(F.col("label"), stat.rules)
    return d.select(idx.alias("rule_idx"), F.when(idx < 0, F.col("label")).alias("label")).groupBy("rule_idx", "label").agg(F.count("*").alias("cnt"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def register(spark: SparkSession, path: str, stat: Stat, base: str, exact: bool = True) -> None:
    """Fixes the cutoffs of the lines (stream_id, line_no, line_type, json) in Parquet at path, and counts what stands before them.

    Lines' numbers grow in each stream, and a line that was written doesn't change. Called again, as after a failure, it
    keeps the cutoffs of the first time. base: the statistic's own folder.
    """
    lines = spark.read.parquet(path)
    if not _exists(spark, f"{base}/cutoffs/_SUCCESS"):
        lines.groupBy("stream_id").agg((F.max("line_no") + 1).alias("cutoff")).write.mode("overwrite").parquet(f"{base}/cutoffs")
    before = lines.join(spark.read.parquet(f"{base}/cutoffs"), "stream_id").where((F.col("line_no") < F.col("cutoff")) & (F.col("line_no") >= F.col("cutoff") - stat.last_n))
    _counts(before, stat, exact).write.mode("overwrite").parquet(f"{base}/counts/batch={HISTORY}")


def follow(spark: SparkSession, path: str, stat: Stat, base: str, exact: bool = True, available_now: bool = False) -> StreamingQuery:
    """Counts the lines from the cutoffs on, as files arrive at path; started again, it goes on where it was."""
    schema = spark.read.parquet(path).schema
    cutoffs = spark.read.parquet(f"{base}/cutoffs")
    lines = spark.readStream.schema(schema).parquet(path).join(cutoffs, "stream_id", "left").where("line_no >= coalesce(cutoff, 0)")

    def write(df: DataFrame, batch: int) -> None:
        _counts(df, stat, exact).write.mode("overwrite").parquet(f"{base}/counts/batch={batch}")

    w = lines.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w).start()


def counts(spark: SparkSession, stat: Stat, base: str) -> DataFrame:
    """The statistic as it stands, in the form of freq.freq()."""
    d = spark.read.schema(COUNTS).parquet(f"{base}/counts").groupBy("rule_idx", "label").agg(F.sum("cnt").cast("long").alias("cnt"))
    return titled(d, stat.rules)
