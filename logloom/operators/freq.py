"""Frequency statistics of JSON fields, with regex rules: a hash aggregation whose label and rule are expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_LINES = 20_000


@dataclass(frozen=True)
class Rule:
    """A label for values that match the pattern as a whole; a name left empty is the pattern."""

    pattern: str
    name: str = ""

    @property
    def title(self) -> str:
        return self.name or self.pattern

    def anchored(self) -> str:
        return rf"^(?:{self.pattern})\z"


@dataclass
class Stat:
    path: list[str]
    rules: list[Rule] = field(default_factory=list)
    name: str = ""
    kind: str = "frequency"
    last_n: int = SAMPLE_LINES

    def __post_init__(self) -> None:
        if any(not isinstance(p, str) for p in self.path):
            raise ValueError("a path is of object keys")
        if self.last_n < 0:
            raise ValueError("last_n is negative")
        self.rules = [r for r in self.rules if r.pattern or r.name]
        for r in self.rules:
            if not r.pattern:
                raise ValueError(f"rule {r.title!r}: empty pattern")
            try:
                re.compile(r.pattern)
            except re.error as e:
                raise ValueError(f"rule {r.title!r}: {e}") from e


class Manager:
    """Gives ids from 1, and names by the path's last key or by the id."""

    def __init__(self) -> None:
        self.stats: dict[int, Stat] = {}

    def add(self, stat: Stat) -> int:
        i = len(self.stats) + 1
        stat.name = stat.name or (stat.path[-1] if stat.path else f"stat-{i}")
        self.stats[i] = stat
        return i


def fast_label(json: Column, path: list[str]) -> Column:
    """Label by Spark's own JSON functions: no Python. JSON nulls count as missing, of equal keys the first counts, and numbers keep their text."""
    return F.get_json_object(json, "$" + "".join(f"['{p}']" for p in path)) if path else json


def exact_label(json: Column, path: list[str]) -> Column:
    """Label with the semantics of jsonx.label, in Arrow batches."""
    from ..functions.columns import json_label

    return json_label(json, F.array(*[F.lit(p) for p in path]) if path else F.expr("cast(array() as array<string>)"))


def rule_index(label: Column, rules: list[Rule]) -> Column:
    """Index of the first rule that matches, or -1."""
    out = F.lit(-1)
    for i, r in reversed(list(enumerate(rules))):
        out = F.when(F.regexp_like(label, F.lit(r.anchored())), i).otherwise(out)
    return out


def titled(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(label, is_rule, rule_idx, cnt) of (rule_idx, label, cnt): rules by their titles, also those that nothing matched."""
    own = counts.where("rule_idx < 0").select("label", F.lit(False).alias("is_rule"), "rule_idx", "cnt")
    if not rules:
        return own
    titles = counts.sparkSession.createDataFrame([(i, r.title) for i, r in enumerate(rules)], "rule_idx int, title string")
    named = F.broadcast(titles).join(counts.where("rule_idx >= 0").select("rule_idx", "cnt"), "rule_idx", "left")
    return named.select(F.col("title").alias("label"), F.lit(True).alias("is_rule"), "rule_idx", F.coalesce("cnt", F.lit(0)).alias("cnt")).unionByName(own)


def freq(labelled: DataFrame, rules: list[Rule] = (), label: str = "label", order: bool = True) -> DataFrame:
    """(label, is_rule, rule_idx, cnt): rules by their titles, also those that nothing matched; other values by themselves. Rows with a null label don't count."""
    rules = list(rules)
    d = labelled.where(F.col(label).isNotNull())
    idx = rule_index(F.col(label), rules)
    counts = d.select(idx.alias("rule_idx"), F.when(idx < 0, F.col(label)).alias("label")).groupBy("rule_idx", "label").agg(F.count("*").alias("cnt"))
    out = titled(counts, rules)
    return out.orderBy(F.desc("cnt"), "label", "is_rule", "rule_idx") if order else out


def top(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("cnt"), "label", "is_rule", "rule_idx").limit(k)


def several(labelled: DataFrame, stats: dict[int, tuple[Column, list[Rule]]]) -> DataFrame:
    """(stat_id, label, is_rule, rule_idx, cnt) of several statistics in one pass over the lines; rules that nothing matched too."""
    each, titles = [], []
    for i, (label, rules) in stats.items():
        rules = list(rules)
        idx = rule_index(label, rules)
        titles += [(i, k, r.title) for k, r in enumerate(rules)]
        each.append(F.struct(F.lit(i).alias("stat_id"), idx.alias("rule_idx"), F.when(idx < 0, label).alias("label"), label.isNotNull().alias("_found")))
    d = labelled.select(F.explode(F.array(*each)).alias("s")).where("s._found")
    counts = d.groupBy("s.stat_id", "s.rule_idx", "s.label").agg(F.count("*").alias("cnt"))
    own = counts.where("rule_idx < 0").select("stat_id", "label", F.lit(False).alias("is_rule"), "rule_idx", "cnt")
    if not titles:
        return own
    names = labelled.sparkSession.createDataFrame(titles, "stat_id int, rule_idx int, title string")
    ruled = F.broadcast(names).join(counts.where("rule_idx >= 0").drop("label"), ["stat_id", "rule_idx"], "left")
    return ruled.select("stat_id", F.col("title").alias("label"), F.lit(True).alias("is_rule"), "rule_idx", F.coalesce("cnt", F.lit(0)).alias("cnt")).unionByName(own)


def totals(counts: DataFrame, by: tuple = ()) -> DataFrame:
    """(total, dropped, pending) of a statistic's counts: all that was counted; Spark holds sources back, so nothing is dropped or waits."""
    return counts.groupBy(*by).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total"), F.lit(0).cast("long").alias("dropped"), F.lit(0).cast("long").alias("pending"))


def statistic(lines: DataFrame, stat: Stat, cutoff: int | None = None, include_multiline: bool = True, exact: bool = True, live: bool = False) -> DataFrame:
    """freq() of the JSON lines among the last_n before cutoff (all lines without one); live: and of all from the cutoff on."""
    d = lines.where("line_type = 'json' and json is not null")
    if not include_multiline:
        d = d.where("group_id = 0")
    if cutoff is not None:
        d = d.where(F.col("line_no") >= max(0, cutoff - stat.last_n))
        d = d if live else d.where(F.col("line_no") < cutoff)
    label = (exact_label if exact else fast_label)(F.col("json"), stat.path)
    return freq(d.select(label.alias("label")), stat.rules)


def merged(*counts: DataFrame) -> DataFrame:
    """Counts of a statistic from several sources, such as history before a cutoff and a stream's from it on, as one."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("label", "is_rule", "rule_idx").agg(F.sum("cnt").cast("long").alias("cnt"))


#: Accuracy of percentiles' sketch.
ACCURACY = 100_000


def numeric(labelled: DataFrame, label: str = "label") -> DataFrame:
    """n, avg, p99, min and max of labels that are numbers (an extension). p99 is an element: a sketch's, of rank error below n / ACCURACY."""
    x = F.col(label).try_cast("double")
    return labelled.agg(F.count(x).alias("n"), F.avg(x).alias("avg"), F.percentile_approx(x, 0.99, ACCURACY).alias("p99"), F.min(x).alias("min"), F.max(x).alias("max"))


def bars(counts: DataFrame, width: int) -> DataFrame:
    """counts with eighths of a cell: cnt * width * 8 div the greatest cnt; and the bar."""
    most = counts.agg(F.max("cnt").alias("_most"))
    d = counts.crossJoin(F.broadcast(most)).withColumn("eighths", F.expr(f"coalesce(cnt * {8 * width} div nullif(_most, 0), 0)")).drop("_most")
    full, part = F.expr("cast(eighths div 8 as int)"), (F.col("eighths") % 8).cast("int")
    return d.withColumn("bar", F.rpad(F.concat(F.repeat(F.lit("█"), full), F.when(part > 0, F.substring(F.lit("▏▎▍▌▋▊▉"), part, F.lit(1))).otherwise("")), width, " "))
