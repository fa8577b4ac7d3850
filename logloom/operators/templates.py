"""Log templates: masked token skeletons, counted by hash, then merged while alike.

Masking and counting are expressions and one distributed aggregation. Only the skeletons of a window, not its lines, are
merged, in their order of first appearance.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rx
from ..sources.shared import written

#: Similarity above which clusters merge: while there are more than the target, and after.
LOOSE, STRICT = 0.6, 0.85
TOKEN = r"(?U)[{}\[\]]|[^\s,;|│┃║{}\[\]]+"
PATH = r"^[\"'(\[]*/"
_RUN = "[A-Za-z0-9+/=]"


def tokens(raw: Column) -> Column:
    """Tokens without white space, commas, semicolons and bars; brackets stand alone."""
    return F.regexp_extract_all(raw, F.lit(TOKEN), F.lit(0))


#: What a plain run lacks, looked for within the run itself.
MIXES = ("[a-z].*[A-Z]|[A-Z].*[a-z]", "[a-zA-Z].*[0-9]|[0-9].*[a-zA-Z]", "[+/=]")


def run_pattern() -> str:
    bound = rx.java(r"\b")
    return rf"{bound}{_RUN}{{16,}}{bound}"


def _mixed_run(t: Column) -> Column:
    """Runs of 16 or more of [A-Za-z0-9+/=] between bounds go if they mix cases, have letters and digits, or a symbol."""
    run = run_pattern()

    def covered(m: Column) -> Column:
        bad = F.lit(False)
        for p in MIXES:
            bad = bad | F.regexp_like(m, F.lit(p))
        return F.when(bad, F.lit("*")).otherwise(m)

    between, runs = F.split(t, run, -1), F.regexp_extract_all(t, F.lit(run), F.lit(0))
    joined = F.array_join(F.flatten(F.zip_with(between, runs, lambda g, m: F.array(g, F.coalesce(covered(m), F.lit(""))))), "")
    return F.when(F.regexp_like(t, F.lit(run)), joined).otherwise(t)


#: A token without any of these is as it was: every mask needs a digit, one of / = . %, or 16 characters.
MASKABLE = r"[0-9/=.%]|[^\n]{16}"


def _chain(t: Column, rules: list[tuple[str, str | None]]) -> Column:
    for pattern, with_ in rules:
        t = F.regexp_replace(t, rx.java(pattern), with_)
    return t


def masked(words: Column) -> Column:
    """An array of tokens, each masked by the rules in order. Three steps, so that no expression holds another twice."""
    at = [w for _, w in rx.MASKS].index(None)
    path = lambda t: F.regexp_like(t, F.lit(PATH))
    some = lambda t, x: F.when(F.regexp_like(t, F.lit(MASKABLE)), x).otherwise(t)
    out = F.transform(words, lambda t: some(t, F.when(path(t), F.lit("*")).otherwise(_chain(t, rx.MASKS[:at]))))
    out = F.transform(out, lambda t: F.when(F.length(t) >= 16, _mixed_run(t)).otherwise(t))
    return F.transform(out, lambda t: some(t, _chain(t, rx.MASKS[at + 1 :])))


def skeleton(raw: Column) -> Column:
    return F.array_join(masked(tokens(raw)), " ")


def collapsed(skeleton_: Column) -> Column:
    """Runs of single stars as one star."""
    return F.regexp_replace(skeleton_, r"(?<!\S)\*( \*)+(?!\S)", "*")


def skeletons(lines: DataFrame, window: str = "window_id", members: bool = False) -> DataFrame:
    """(window, skeleton, n, first_line[, line_indices]) of the lines that aren't hidden."""
    d = lines.where("not hidden") if "hidden" in lines.columns else lines
    d = d.select(window, skeleton(F.col("raw")).alias("skeleton"), "line_no")
    aggs = [F.count("*").alias("n"), F.min("line_no").alias("first_line")] + ([F.array_sort(F.collect_list("line_no")).alias("line_indices")] if members else [])
    return d.groupBy(window, "skeleton").agg(*aggs)


def alike(a: Counter, b: Counter) -> float:
    """Multiset Jaccard similarity; two empty ones are equal."""
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of equals, the one that backs up in `a` first."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        row, last = best[i + 1], best[i]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def split(text: str) -> list[str]:
    import regex

    return regex.findall(r"[{}\[\]]|[^\s,;|│┃║{}\[\]]+", text)


def merged_skeleton(a: str, b: str) -> str:
    """What both have in order, a star for each gap (none after a star)."""
    ta, tb = split(a), split(b)
    words = [ta[i] for i, _ in common(ta, tb)]
    out, ia, ib = [], 0, 0
    for w in [*words, None]:  # None: the ends
        ja, jb = (ta.index(w, ia), tb.index(w, ib)) if w is not None else (len(ta), len(tb))
        if (ja > ia or jb > ib) and out[-1:] != ["*"]:
            out.append("*")
        if w is not None:
            out.append(w)
        ia, ib = ja + 1, jb + 1
    return " ".join(out)


def merge(clusters: list[tuple[str, list]], lines: int) -> list[tuple[str, list]]:
    """Merges the most alike pair (of equals the first) until none is alike enough; (skeleton, members) in order.

    Pairs wait in a heap. Only those that share a word and whose numbers of words allow the least similarity asked for
    are compared: of two empty skeletons there is one only. A merged cluster takes the first one's place.
    """
    target = max(2, math.ceil(math.sqrt(lines)))
    if len(clusters) <= target:
        return clusters
    items = {i: (s, m, Counter(s.split())) for i, (s, m) in enumerate(clusters)}
    size = {i: c.total() for i, (_, _, c) in items.items()}
    holders: dict[str, set[int]] = {}
    for i, (_, _, c) in items.items():
        for w in c:
            holders.setdefault(w, set()).add(i)
    version, heap = dict.fromkeys(items, 0), []

    def offer(i: int, k: int) -> None:
        i, k = min(i, k), max(i, k)
        if min(size[i], size[k]) > LOOSE * max(size[i], size[k]) and (sim := alike(items[i][2], items[k][2])) > LOOSE:
            heapq.heappush(heap, (-sim, i, k, version[i], version[k]))

    for i, (_, _, c) in items.items():
        for k in set().union(*(holders[w] for w in c)) if c else ():
            if k < i:
                offer(i, k)
    while heap and len(items) > 1:
        sim, i, k, vi, vk = heapq.heappop(heap)
        if version.get(i) != vi or version.get(k) != vk:
            continue
        if -sim <= (STRICT if len(items) <= target else LOOSE):
            break
        s = merged_skeleton(items[i][0], items[k][0])
        for n in (i, k):
            for w in items[n][2]:
                holders[w].discard(n)
        items[i] = (s, sorted(items[i][1] + items[k][1]), Counter(s.split()))
        del items[k], version[k]
        size[i], version[i] = items[i][2].total(), version[i] + 1
        for w in items[i][2]:
            holders.setdefault(w, set()).add(i)
        for n in set().union(*(holders[w] for w in items[i][2])) - {i} if items[i][2] else ():
            offer(i, n)
    return [(s, m) for _, (s, m, _) in sorted(items.items())]


def visible_windows(lines: DataFrame, size: int = 4096, first: int = 0) -> DataFrame:
    """lines that are not hidden, with window_id: every `size` line numbers from `first` on make one window of a stream."""
    d = lines.where(~F.coalesce("hidden", F.lit(False))) if "hidden" in lines.columns else lines
    return d.where(F.col("line_no") >= first).withColumn("window_id", F.concat_ws("#", "stream_id", F.expr(f"(line_no - {first}) div {size}").cast("string")))


#: Skeletons of a window that one task merges by itself; a window with more is merged in rounds over all tasks.
MOST_IN_TASK = 4096
#: Neighbours that a cluster is compared with in a bucket, to begin with.
NEAR = 8
CLUSTERS = "skeleton string, n long, first_line long, skeletons array<string>"


def _numbered_words() -> Column:
    """A skeleton's words, the k-th of equal ones with its k: sets of these have the similarity of the words' multisets."""
    words = F.array_sort(F.filter(F.split("skeleton", " "), lambda w: w != ""))
    return F.transform(words, lambda w, i: F.concat(w, F.lit("\0"), (i - F.array_position(words, w)).cast("string")))


def _pairs(d: DataFrame, window: str, near: int) -> tuple[DataFrame, DataFrame]:
    """(window, a, b) of clusters that may be alike enough, a the earlier one; and the sizes of the buckets in which they meet.

    Sets that are more than LOOSE alike share one of their rarest words, as many as the bound leaves over. In the bucket of
    such a word clusters stand in order, and each is paired with the `near` ones after it.
    """
    each = d.select(window, "first_line", F.size("_w").alias("_size"), F.explode("_w").alias("_t"))
    frequency = each.groupBy(window, "_t").agg(F.count("*").alias("_f"))
    rarest = F.row_number().over(Window.partitionBy(window, "first_line").orderBy("_f", "_t"))
    first = each.join(frequency, [window, "_t"]).withColumn("_k", rarest).where(F.col("_k") <= F.col("_size") - F.ceil(F.col("_size") * LOOSE) + 1)
    after = Window.partitionBy(window, "_t").orderBy("_size", "first_line").rowsBetween(1, near)
    met = first.withColumn("_after", F.collect_list("first_line").over(after)).select(window, F.col("first_line").alias("_x"), F.explode("_after").alias("_y"))
    pairs = met.select(window, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()
    return pairs, first.groupBy(window, "_t").agg(F.count("*").alias("_bucket"))


def merge_in_rounds(clusters: DataFrame, window: str) -> DataFrame:
    """merge() for windows of any number of skeletons: (window, skeleton, n, first_line, skeletons).

    Each round merges the pairs that are each other's best, all at once, as long as a window has more clusters than it
    should; below that number only pairs that are STRICT alike. A most alike pair is always among them, but others are
    merged at the same time that merge() would have tried later, so results can differ where similarities are close. Pairs come from word buckets; when none is found, clusters are compared with twice as many neighbours,
    until that is all of each bucket, so no pair that is alike enough is left at the end.
    """
    target = clusters.groupBy(window).agg(F.greatest(F.lit(2), F.ceil(F.sqrt(F.sum("n")))).alias("_target"))
    target, near = written(target), NEAR
    kept = written(clusters.select(window, *[c.split()[0] for c in CLUSTERS.split(", ")]))
    schema = f"{window} {dict(clusters.dtypes)[window]}, {CLUSTERS}"

    def merged(batches):
        for pdf in batches:
            pdf["skeleton"] = [merged_skeleton(x, y) for x, y in zip(pdf["skeleton"], pdf["_other"], strict=True)]
            yield pdf[[window, "skeleton", "n", "first_line", "skeletons"]]

    while True:
        d = kept.withColumn("_w", _numbered_words())
        pairs, buckets = _pairs(d, window, near)
        side = lambda x: d.select(F.col(window).alias(f"_{x}"), F.col("first_line").alias(f"_{x}_id"), F.col("_w").alias(f"_{x}_w"))  # noqa: B023, E731
        p = pairs.join(side("p"), (F.col(window) == F.col("_p")) & (F.col("a") == F.col("_p_id"))).join(side("q"), (F.col(window) == F.col("_q")) & (F.col("b") == F.col("_q_id")))
        both = F.size(F.array_intersect("_p_w", "_q_w"))
        p = p.select(window, "a", "b", (both / (F.size("_p_w") + F.size("_q_w") - both)).alias("sim")).where(F.col("sim") > LOOSE)
        goal = kept.groupBy(window).count().join(target, window).select(window, (F.col("count") - F.col("_target")).alias("_over"))
        nth = F.row_number().over(Window.partitionBy(window).orderBy(F.desc("sim"), "a", "b"))
        # of equals by a hash of the pair: by number all would choose the first one, and a round would merge one pair
        best = F.struct(F.col("sim"), F.xxhash64("a", "b").alias("h"), F.col("a"), F.col("b"))
        ends = p.select(window, "a", "b", best.alias("_best"), F.explode(F.array("a", "b")).alias("_end"))
        chosen = ends.groupBy(window, "_end").agg(F.max("_best").alias("_best"))
        mutual = chosen.groupBy(window, "_best").agg(F.count("*").alias("_c")).where("_c = 2").select(window, "_best.a", "_best.b", "_best.sim")
        mutual = written(mutual.join(goal, window).withColumn("_nth", nth).where((F.col("_nth") <= F.col("_over")) | (F.col("sim") > STRICT)).select(window, "a", "b"))
        if not mutual.take(1):
            open_ = kept.groupBy(window).count().join(target, window).where(F.col("count") > 1).select(window)
            largest = buckets.join(open_, window, "left_semi").agg(F.max("_bucket")).first()[0] or 0
            if largest <= near + 1:
                return kept
            near *= 2
            continue
        one, two = (mutual.select(window, F.col("a").alias("first_line")), mutual.select(window, F.col("b").alias("first_line")))
        other = kept.select(F.col(window).alias("_v"), F.col("first_line").alias("_b"), F.col("skeleton").alias("_other"), F.col("n").alias("_n"), F.col("skeletons").alias("_more"))
        joined = kept.join(mutual, (kept[window] == mutual[window]) & (kept["first_line"] == mutual["a"])).select(kept[window], "skeleton", "n", "first_line", "skeletons", F.col("b").alias("_b0"))
        joined = joined.join(other, (F.col(window) == F.col("_v")) & (F.col("_b0") == F.col("_b"))).select(window, "skeleton", "_other", (F.col("n") + F.col("_n")).alias("n"), "first_line", F.concat("skeletons", "_more").alias("skeletons"))
        rest = kept.join(one.unionByName(two), [window, "first_line"], "left_anti")
        kept = written(rest.unionByName(joined.mapInPandas(merged, schema)))


def templates(lines: DataFrame, window: str = "window_id", most_in_task: int | None = None, order: bool = True) -> DataFrame:
    """(window_id, template, skeleton, n, first_line, skeletons) after merging; skeletons: those that a template stands for.

    A window of up to most_in_task skeletons is merged by merge(), one with more by merge_in_rounds().
    """
    most = most_in_task or MOST_IN_TASK
    found = written(skeletons(lines, window))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_line", kind="stable")
        counts = dict(zip(pdf["skeleton"], zip(pdf["n"], pdf["first_line"], strict=True), strict=True))
        out = merge([(s, [s]) for s in pdf["skeleton"]], int(pdf["n"].sum()))
        rows = [(pdf[window].iloc[0], s, sum(int(counts[m][0]) for m in ms), min(int(counts[m][1]) for m in ms), ms) for s, ms in out]
        return pd.DataFrame(rows, columns=[window, "skeleton", "n", "first_line", "skeletons"])

    large = found.groupBy(window).count().where(F.col("count") > most).select(window)
    small = found.join(large, window, "left_anti") if (some := bool(large.take(1))) else found
    t = small.groupBy(window).applyInPandas(run, f"{window} {dict(found.dtypes)[window]}, {CLUSTERS}")
    if some:
        t = t.unionByName(merge_in_rounds(found.join(large, window, "left_semi").withColumn("skeletons", F.array("skeleton")), window))
    t = t.withColumnRenamed(window, "window_id").withColumn("template", collapsed(F.col("skeleton")))
    return t.orderBy("window_id", F.desc("n"), "first_line") if order else t


def placed(found: DataFrame, window: str = "window_id") -> DataFrame:
    """skeletons() or templates() with place, from 1: each one's place in its window, by lines and then by the first line."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(window).orderBy(F.desc("n"), "first_line")))


def lines_of(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """The lines of chosen templates: a semi-join on the skeletons that they stand for."""
    keys = chosen.select(F.explode("skeletons").alias("_skeleton")).distinct()
    return lines.withColumn("_skeleton", skeleton(F.col("raw"))).join(keys, "_skeleton", "left_semi").drop("_skeleton")
