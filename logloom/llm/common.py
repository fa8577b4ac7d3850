"""Helpers that the operators share: shared folders, sizes, bounded training samples."""

from __future__ import annotations

import ctypes
import gc
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = " \\t\\n\\x0B\\f\\r"  # a Java class of \x20 and \x09-\x0D
WORD_RX = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on one machine, a folder of our own. On a cluster it must be set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        d = "/tmp/logloom-checkpoint"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


_WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: later jobs neither repeat nor lose it."""
    path = f"{shared_dir(df.sparkSession)}/logloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that written() has made in this process; call it when no result that rests on them is needed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Hands memory that training has freed back to the system, where the C library can: the driver's process lives on."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def n_parts(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Groups to hash rows into: at least the shuffle partitions, and one for each bytes_each of input.

    The plan's statistics tell the input's size, but for joins, whose sizes they multiply: there the texts are measured.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size > 1 << 56 or "Join" in str(plan):
        texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if f.dataType == T.StringType()]
        each = reduce(lambda x, y: x + y, texts, F.lit(8 * len(df.columns)))
        size = df.agg(F.sum(each.cast("long"))).first()[0] or 0
    return max(least, -(-size // bytes_each))


def crc_mod(col, m: int):
    """crc32 of a doc_id as text, modulo m; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % m


#: A text is large from this part of its value's share of a sample's bytes on.
LARGE = 16
#: Labels or languages that a sample is drawn for, most frequent first; a classifier knows no others.
MOST_VALUES = 1000


def bounded_sample(docs: DataFrame, keys: DataFrame, by: str, most_rows: int, most_bytes: int, most_values: int = MOST_VALUES) -> list:
    """Rows (doc_id, text, by) of docs whose doc_id is in keys (doc_id, by): about most_rows for each of the most_values most frequent values of `by`, and most_bytes of text in all.

    Rows without text are passed over. Values have equal shares of most_bytes; what one does not need goes to those that
    need more. Texts above a LARGE-th of their value's share come after all others of it, so that one does not crowd
    them out. The choice is by a hash of doc_id, so it is the same on every run and does not follow the table's order.
    What reaches the driver, ids and sizes first and then the chosen texts, is bounded.
    """
    spark = docs.sparkSession
    keys = keys.select("doc_id", by).where(F.col("doc_id").isNotNull() & F.col(by).isNotNull())
    counts = keys.groupBy(by).count().orderBy(F.desc("count"), by).limit(most_values).collect()
    if not counts:
        return []
    fine = 1 << 40
    u = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id").cast("string")), F.lit(fine))
    share = spark.createDataFrame([(r[by], min(fine, int(fine * 1.2 * most_rows / r["count"]))) for r in counts], keys.select(by).schema.add("_most", "long"))
    ids = keys.join(F.broadcast(share), by).where(u < F.col("_most")).select("doc_id", by, u.alias("_u")).orderBy("_u", "doc_id").limit(2000 + 2 * most_rows * len(counts))
    sizes = docs.select("doc_id", F.octet_length("text").alias("_size")).where("_size > 0").join(F.broadcast(ids), "doc_id").collect()
    of = {}
    for r in sorted(sizes, key=lambda r: (r["_u"], str(r["doc_id"]), str(r[by]), r["_size"])):
        of.setdefault(r[by], []).append(r)
    need = {k: sum(r["_size"] for r in v[:most_rows]) for k, v in of.items()}
    keep, left = {}, most_bytes
    for turn, k in enumerate(sorted(of, key=lambda k: (need[k], str(k)))):
        share = left // (len(of) - turn)
        rows = total = 0
        for r in sorted(of[k], key=lambda r: r["_size"] * LARGE > share):
            if r["doc_id"] not in keep and rows < most_rows and total + r["_size"] <= share:
                keep[r["doc_id"]] = k
                rows, total = rows + 1, total + r["_size"]
        left -= total
    if not keep:
        return []
    chosen = spark.createDataFrame(list(keep.items()), keys.schema)
    rows = docs.select("doc_id", "text").where("octet_length(text) > 0").join(F.broadcast(chosen), "doc_id").limit(2 * len(keep)).collect()
    return sorted(rows, key=lambda r: (str(r["doc_id"]), r["text"]))


def new_columns(docs: DataFrame, new: list[T.StructField]) -> tuple[list[T.StructField], T.StructType]:
    """The fields of docs that stay beside new ones of the given names, and the schema with both."""
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]
    return kept, T.StructType(kept + new)


def arrow_map(docs: DataFrame, new: list[T.StructField], make, text: str = "text") -> DataFrame:
    """docs with new columns: make() gives, in each task, a function from a text column to a list of arrays, one for each new column."""
    kept, schema = new_columns(docs, new)
    names = [f.name for f in kept]

    def run(batches):
        import pyarrow as pa

        f = make()
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            yield pa.RecordBatch.from_arrays([cols[n] for n in names] + f(cols[text]), names=[*names, *(x.name for x in new)])

    return docs.mapInArrow(run, schema)
