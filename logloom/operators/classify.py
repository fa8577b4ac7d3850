"""Row-level classification, levels, outcomes and extents: expressions only, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rx

BLANK = r"^[\s ]+|[\s ]+$"


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?U)^\s+|\s+\z", "")


def _has(raw: Column, pattern: str) -> Column:
    return F.regexp_like(raw, F.lit(rx.java(pattern)))


def _group(raw: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(raw, rx.java(pattern), i)


def gotest(raw: Column) -> Column:
    """struct<kind, action, test_name, duration, is_pass, is_fail, is_skip, depth> of test output lines, else null."""
    def made(kind: str, action: Column, name: Column, duration: Column, depth: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), action.alias("action"), name.alias("test_name"), duration.alias("duration"),
            (action == "PASS").alias("is_pass"), (action == "FAIL").alias("is_fail"), (action == "SKIP").alias("is_skip"), depth.cast("int").alias("depth"),
        )

    none, zero = F.lit(""), F.lit(0)
    depth = lambda p: F.floor(F.octet_length(_group(raw, p, 1)) / 4)
    return (
        F.when(_has(raw, rx.GOTEST_MARKER), made("gotest_marker", _group(raw, rx.GOTEST_MARKER, 2), _group(raw, rx.GOTEST_MARKER, 3), none, depth(rx.GOTEST_MARKER)))
        .when(_has(raw, rx.GOTEST_RESULT), made("gotest_result", _group(raw, rx.GOTEST_RESULT, 2), _group(raw, rx.GOTEST_RESULT, 3), _group(raw, rx.GOTEST_RESULT, 4), depth(rx.GOTEST_RESULT)))
        .when(trimmed(raw).isin("PASS", "FAIL"), made("gotest_result", trimmed(raw), none, none, zero))
        .when(_has(raw, rx.GOTEST_PACKAGE_OK), made("gotest_result", F.lit("PASS"), none, none, zero))
        .when(_has(raw, rx.GOTEST_PACKAGE_FAIL), made("gotest_result", F.lit("FAIL"), none, none, zero))
    )


def warning_level(raw: Column) -> Column:
    """ERROR, FATAL, WARN or WARNING of a line that begins so, else null. INFO and DEBUG prefixes leave a line plain."""
    return F.when(_has(raw, rx.ERROR_PREFIX), F.upper(_group(raw, rx.ERROR_PREFIX, 2))).when(_has(raw, rx.WARN_PREFIX), F.upper(_group(raw, rx.WARN_PREFIX, 2)))


def normal_level(word: Column) -> Column:
    w = F.lower(F.trim(word))
    out = F.lit("")
    for level, words in rx.LEVELS.items():
        out = F.when(w.isin(*words), level).otherwise(out)
    return F.coalesce(out, F.lit(""))


def json_level(json: Column) -> Column:
    """Level of a JSON object's top-level string `level`, or ''."""
    v = F.get_json_object(json, "$.level")
    is_text = F.regexp_like(F.get_json_object(json, "$"), F.lit(r'"level"\s*:\s*"'))
    return F.when(is_text, normal_level(v)).otherwise(F.lit(""))


def status(line_type: Column, is_pass: Column, is_fail: Column, level: Column, styles: Column) -> Column:
    """0 neutral, 1 success, 2 failure."""
    bad = F.exists(styles, lambda s: s.isin("level-error", "level-warn", "failed-step", "k8s-event-warning"))
    return (
        F.when(line_type == "warning", 2)
        .when(line_type == "gotest_result", F.when(is_fail, 2).when(is_pass, 1).otherwise(0))
        .when((line_type == "json") & (F.coalesce(level, F.lit("")) != ""), F.when(level.isin("error", "fatal"), 2).otherwise(0))
        .when(F.coalesce(bad, F.lit(False)), 2).otherwise(0).cast("tinyint")
    )


def extent(raw: Column) -> Column:
    """struct<beg, end> in bytes without blanks and tabs at the ends; (-1, 0) of a blank line."""
    left, right = F.regexp_replace(raw, r"^[ \t]+", ""), F.regexp_replace(raw, r"[ \t]+\z", "")
    blank = right == ""
    return F.struct(
        F.when(blank, -1).otherwise(F.octet_length(raw) - F.octet_length(left)).cast("int").alias("beg"),
        F.when(blank, 0).otherwise(F.octet_length(right)).cast("int").alias("end"),
    )


def matches(raw: Column, query: str) -> Column:
    """Case-insensitive substring; an empty query matches nothing."""
    return F.contains(F.lower(raw), F.lit(query.lower())) if query else F.lit(False)


def is_k8s_resource(ref: Column) -> Column:
    """kind.group/name with a known kind, a group of three parts, or a dotless group over 3 bytes."""
    kind_group = F.substring_index(ref, "/", 1)
    kind = F.lower(F.substring_index(kind_group, ".", 1))
    group = F.regexp_replace(kind_group, r"^[^.]*\.", "")
    dots = F.length(group) - F.length(F.replace(group, F.lit("."), F.lit("")))
    likely = kind.isin(*rx.K8S_KINDS) | (dots >= 2) | ((dots == 0) & (F.octet_length(group) > 3))
    return F.contains(ref, F.lit("/")) & F.contains(kind_group, F.lit(".")) & likely


def human_bytes(n: Column) -> Column:
    """1023B, 1.0KiB, ..."""
    step = F.greatest(F.lit(0), F.least(F.lit(6), F.floor(F.log(F.lit(1024.0), F.greatest(n.cast("double"), F.lit(1.0))) + 1e-12)))
    unit = F.element_at(F.array(*[F.lit(u) for u in ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")]), F.greatest(step, F.lit(1)).cast("int"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).otherwise(F.concat(F.format_string("%.1f", n / F.pow(F.lit(1024.0), step)), unit))


def short_bytes(n: Column) -> Column:
    """320B, 12KB, 320MB, 1.2GB: whole kilo- and megabytes, tenths of gigabytes."""
    return (
        F.when(n >= 1 << 30, F.concat(F.format_string("%.1f", n / F.lit(float(1 << 30))), F.lit("GB")))
        .when(n >= 1 << 20, F.concat(F.shiftright(n, 20).cast("string"), F.lit("MB")))
        .when(n >= 1 << 10, F.concat(F.shiftright(n, 10).cast("string"), F.lit("KB")))
        .otherwise(F.concat(n.cast("string"), F.lit("B")))
    )


def truncated(text: Column, width: int) -> Column:
    """At most `width` bytes; where something was cut from more than 3, an ellipsis follows width - 1 bytes. A character that was cut apart goes whole."""
    if width <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    most = width if width <= 3 else width - 1
    begin = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    begin = F.when(F.endswith(begin, F.lit("\ufffd")), F.regexp_replace(begin, "\ufffd+$", "")).otherwise(begin)
    return F.when(F.octet_length(text) <= width, text).otherwise(begin if width <= 3 else F.concat(begin, F.lit("…")))
