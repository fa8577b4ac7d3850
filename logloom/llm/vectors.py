"""Vector columns as whole numbers: rows without a usable vector go, the others are written once for the passes that follow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: An entry of a vector counts in steps of a 1024-th.
STEPS_OF_ONE = 1024
#: Entries are below this in size, so that squared distances and sums of billions of rows are longs.
LARGEST = 1 << 16


def kept_vectors(df: DataFrame, key: str, vector: str, label: str | None = None) -> tuple[DataFrame, int]:
    """Rows (key, label if named, q: floor(1024 * entry) of each entry) with a usable vector, written to the shared folder, and their dimension.

    A row goes whose vector is null or has a null, NaN or infinite entry. Vectors of one table have one length; where they
    don't, the most frequent length is the table's (of equally frequent ones the greater) and rows of others go. Null and
    repeated keys, null labels and repeated vectors stay. Other columns are not read. An entry of LARGEST or more in size
    ends the query with an error. No row kept: an empty table, dimension 0.
    """
    entry = lambda x: x.cast("double")
    usable = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(entry(x)) & (F.abs(entry(x)) < float("inf")))
    d = df.where(F.coalesce(F.col(vector).isNotNull() & usable, F.lit(False)))
    whole = lambda x: F.when(F.abs(entry(x)) < LARGEST, F.floor(entry(x) * STEPS_OF_ONE)).otherwise(F.raise_error(F.lit(f"a vector's entry is {LARGEST} or more in size")).cast("long"))
    rows = written(d.select(F.col(key).alias("key"), *([F.col(label).alias("label")] if label else []), F.transform(F.col(vector), whole).cast(T.ArrayType(T.IntegerType())).alias("q")))
    lengths = rows.groupBy(F.size("q").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(2).collect()
    if len(lengths) > 1:
        rows = rows.where(F.size("q") == lengths[0]["dim"])
    return rows, lengths[0]["dim"] if lengths else 0


def blocks(batch: pa.RecordBatch, dim: int, most: int = 1 << 17) -> Iterator[tuple[int, np.ndarray]]:
    """The batch's vectors as rows of longs, `most` entries at once: where each block begins, and the block."""
    col = batch.column(batch.schema.get_field_index("q"))
    flat, step = np.asarray(col.flatten()), max(1, most // max(1, dim))
    for lo in range(0, len(col), step):
        hi = min(len(col), lo + step)
        yield lo, flat[lo * dim : hi * dim].reshape(hi - lo, dim).astype(np.int64)


def summed(rows: DataFrame, make, kind: str) -> np.ndarray:
    """Sum over all tasks of the array that make() yields in each: make() gives (a function of a batch, the array it adds to).

    Tasks send one row for each entry that isn't zero; Spark adds them up. The array's size, not the rows', bounds what
    comes to the driver.
    """
    def run(batches):
        add, total = make()
        for b in batches:
            add(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at])], names=["slot", "value"])

    got = rows.mapInArrow(run, f"slot int, value {kind}").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    total = make()[1]
    total.ravel()[[r["slot"] for r in got]] = [r["value"] for r in got]
    return total
