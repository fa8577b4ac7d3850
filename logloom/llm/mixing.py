"""Mixing sources to target weights by subset-sum budget fitting.

Targets are a water-filling of the budget over the sources. A source gives whole passes first; for the rest, its
documents are counted by exact length, an equal share of each length is taken, and a bounded-knapsack dynamic program
over the remaining counts fits the remaining budget, exactly where a sum of lengths can. Which documents of a length
are taken is a matter of a seeded hash: counts by hash bucket settle all buckets but one of a length, and only that one
is ranked, so no source and no length is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_RX, written

WEIGHTS, BUDGET, MOST_TIMES, SEED = (3, 1, 2), 1.5, 2, 11
#: Most distinct sources, which reach the driver as (source, size) rows.
MOST_SOURCES = 100_000
HASH_BITS = 10
#: The dynamic program's table has at most so many sums.
MOST_SUMS = 1 << 18
#: Names of columns in between.
OWN = tuple(f"_mix_{x}" for x in ("src", "name", "whole", "rest", "h", "t", "b", "bcut", "hcut", "tcut"))


def targets(sizes: list[float], weights: list[float], budget: float, most_times: float = MOST_TIMES) -> list[float]:
    """Shares of the budget by weight; a share above most_times its size stops there, and the excess is shared again."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), budget
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most_times * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most_times * sizes[i])
            left -= out[i]
        stopped = set(full)
        open_ = [i for i in open_ if i not in stopped]
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, for a sum as near to the budget as can be, at most half a shortest step away."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    slack = min(budget, MOST_SUMS // 4, max(8 * int(lengths.max()), MOST_SUMS // 16))  # left to the table, so that it has room
    take = np.array([int(c) * (budget - slack) // total for c in counts.tolist()], np.int64)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):  # what rounding left over: long ones first, down to what the table holds
        if left <= MOST_SUMS // 2:
            break
        k = max(0, min(int(counts[i] - take[i]), (left - MOST_SUMS // 4) // int(lengths[i])))
        take[i] += k
        left -= k * int(lengths[i])
    free = np.minimum(counts - take, left // np.maximum(1, lengths) + 1)
    items = []  # (length x copies, index, copies): binary parts of each count
    for i in np.flatnonzero((free > 0) & (lengths > 0)):
        k, n = 1, int(free[i])
        while n:
            c = min(k, n)
            items.append((int(lengths[i]) * c, int(i), c))
            n -= c
            k *= 2
    items.sort()
    most = 2 * left + 1
    mask, reach, steps = (1 << most + 1) - 1, 1, []
    for size, _, _ in items:
        new = (reach | reach << size) & mask
        steps.append(new & ~reach)
        reach = new
        if reach >> left & 1:
            break
    best = next(s for d in range(left + 2) for s in (left - d, left + d) if s >= 0 and reach >> s & 1)
    for k in range(len(steps) - 1, -1, -1):
        if steps[k] >> best & 1:
            size, i, c = items[k]
            take[i] += c
            best -= size
    return take


def _fit(table: pa.Table) -> pa.Table:
    t = table.combine_chunks().sort_by("size")
    budget = t.column("_rest")[0].as_py() if len(t) else 0
    take = fit_counts(t.column("size").to_numpy(), t.column("count").to_numpy(), budget)
    return pa.Table.from_arrays([t.column("_src"), t.column("size"), pa.array(take, pa.int64())], names=["_src", "size", "_take"])


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with size (words) and _mix_h, a seeded hash of all columns; columns of mix's names go."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RX)), F.lit(0)).cast("long")
    d = docs.drop("size", "source_size", "target", "taken", *OWN)
    hashable = [F.col(f"`{f.name}`") for f in d.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return d.withColumn("size", size).withColumn("_mix_h", F.xxhash64(F.lit(seed), *hashable))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most_times: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """docs with size (words), source_size, target and taken (words, repeats counted).

    Sources by code point, null last, weigh `weights` in turn and share budget x all sizes; a source's target stops at
    most_times its size. Each document is taken a whole number of times, at most most_times. Null and empty texts have
    size 0 and are never taken. Texts of any length count whole. Documents of one source and length are
    interchangeable: ties go by a seeded hash of all columns, and of rows that are equal in all of them any may be
    taken, so that reruns give equal rows. Columns of the new names (and of OWN's) are replaced; an empty table gives an empty
    result.
    """
    return mixed(written(sized(docs, seed)), weights, budget, most_times)


def mixed(table: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most_times: int = MOST_TIMES) -> DataFrame:
    """mix() of a written table that sized() has made."""
    spark, columns = table.sparkSession, [c for c in table.columns if c != "_mix_h"]
    # a row's place tells equal rows apart
    d = table.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_mix_t"), F.shiftrightunsigned("_mix_h", 64 - HASH_BITS).cast("int").alias("_mix_b"))
    rows = d.select("source", "size", "_mix_h", "_mix_t", "_mix_b")
    narrow = written(rows.groupBy("source", "size", "_mix_b").agg(F.count("*").alias("count")))
    by_source = narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")).limit(MOST_SOURCES + 1).collect()
    if len(by_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # by code point
    sizes = [r["source_size"] for r in by_source]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], budget * sum(sizes), most_times)
    plan = []
    for i, (r, t) in enumerate(zip(by_source, goal, strict=True)):
        whole = min(most_times, int(t // r["source_size"])) if r["source_size"] else 0
        plan.append((i, r["source"], r["source_size"], float(t), whole, round(t - whole * r["source_size"]) if whole < most_times else 0))
    plan = F.broadcast(spark.createDataFrame(plan, "_mix_src int, _mix_name string, source_size long, target double, _mix_whole long, _mix_rest long"))
    counted = narrow.join(plan, narrow["source"].eqNullSafe(plan["_mix_name"])).where("size > 0")
    fit = counted.groupBy("_mix_src", "size").agg(F.sum("count").alias("count"), F.max("_mix_rest").alias("_rest")).withColumnRenamed("_mix_src", "_src")
    take = fit.groupBy("_src").applyInArrow(lambda t: _fit(t), "_src int, size long, _take long").withColumnRenamed("_src", "_mix_src")
    # buckets of a length in order: the whole ones, the one to be ranked, none
    order = Window.partitionBy("_mix_src", "size").orderBy("_mix_b")
    cut = counted.select("_mix_src", "_mix_name", "size", "_mix_b", "count").withColumn("_upto", F.sum("count").over(order)).join(take, ["_mix_src", "size"])
    cut = cut.withColumn("_k", F.col("_take") - F.col("_upto") + F.col("count")).where((F.col("_k") > 0) & (F.col("_k") <= F.col("count")))
    cut = written(cut.select("_mix_src", F.col("_mix_name").alias("_name"), F.col("size").alias("_size"), F.col("_mix_b").alias("_bcut"), "_k"))
    part = rows.join(cut, rows["source"].eqNullSafe(cut["_name"]) & (rows["size"] == cut["_size"]) & (rows["_mix_b"] == cut["_bcut"]))
    rank = F.row_number().over(Window.partitionBy("_mix_src", "_size", "_bcut").orderBy("_mix_h", "_mix_t"))
    last = part.withColumn("_r", rank).where("_r = _k").select("_mix_src", "size", F.col("_bcut").alias("_mix_bcut"), F.col("_mix_h").alias("_mix_hcut"), F.col("_mix_t").alias("_mix_tcut"))
    d = d.join(plan, d["source"].eqNullSafe(plan["_mix_name"])).join(last, ["_mix_src", "size"], "left")
    b, h, t = ((F.col(f"_mix_{x}"), F.col(f"_mix_{x}cut")) for x in "bht")
    once = (b[0] < b[1]) | ((b[0] == b[1]) & ((h[0] < h[1]) | ((h[0] == h[1]) & (t[0] <= t[1]))))
    times = F.col("_mix_whole") + F.when(once, 1).otherwise(0)
    taken = F.when(F.col("size") > 0, F.col("size") * times).otherwise(F.lit(0)).cast("long").alias("taken")
    return d.select(*[F.col(f"`{c}`") for c in columns], "source_size", "target", taken)


def op3(docs: DataFrame) -> DataFrame:
    d = written(sized(docs.select("doc_id", "text", "source")).drop("text"))
    return mixed(d).select("doc_id", "size", "source_size", "target", "taken")
