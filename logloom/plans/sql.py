"""SQL names for the functions and views over a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import rx
from ..operators import templates


def _text(pattern: str) -> str:
    """A string literal of SQL."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(t: str, pattern: str, with_: str) -> str:
    return f"regexp_replace({t}, {_text(pattern)}, {_text(with_)})"


def clean_sql(s: str, width: int = 8) -> str:
    """functions.clean.clean_lines()'s raw of a text, as SQL."""
    t = _replaced(_replaced(_replaced(f"coalesce({s}, '')", r"\r\z", ""), rx.ANSI, ""), r"[\x00-\x08\x0B-\x1F\x7F]", "?")
    cell = f"if(a.first, named_struct('out', c, 'first', false), named_struct('out', concat(a.out, repeat(' ', {width} - length(a.out) % {width}), c), 'first', false))"
    return f"aggregate(split({t}, '\\t'), named_struct('out', '', 'first', true), (a, c) -> {cell}, a -> a.out)"


def mask_sql(s: str) -> str:
    """operators.templates.skeleton() of a line, as SQL."""
    at = [w for _, w in rx.MASKS].index(None)

    def chain(t: str, rules: list) -> str:
        for pattern, with_ in rules:
            t = _replaced(t, rx.java(pattern), with_)
        return t

    some = lambda x: f"if(regexp_like(t, {_text(templates.MASKABLE)}), {x}, t)"
    run = _text(templates.run_pattern())
    mixed = " or ".join(f"regexp_like(m, {_text(p)})" for p in templates.MIXES)
    joined = f"array_join(flatten(zip_with(split(t, {run}, -1), regexp_extract_all(t, {run}, 0), (g, m) -> array(g, coalesce(if({mixed}, '*', m), '')))), '')"
    steps = [
        some(f"if(regexp_like(t, {_text(templates.PATH)}), '*', {chain('t', rx.MASKS[:at])})"),
        f"if(length(t) >= 16 and regexp_like(t, {run}), {joined}, t)",
        some(chain("t", rx.MASKS[at + 1 :])),
    ]
    words = f"regexp_extract_all({s}, {_text(templates.TOKEN)}, 0)"
    for x in steps:
        words = f"transform({words}, t -> {x})"
    return f"array_join({words}, ' ')"


def register(spark: SparkSession, lines: DataFrame | None = None) -> None:
    """log_clean and log_mask (expressions, without Python); json_label, json_find, spans, json_segments, json_compact, json_slices, json_level_range, json_field_path, json_child_rows, json_node_rows (arrays for inline()) and the table functions json_children and json_tree; views `lines` and `templates` of given lines."""
    from ..functions import columns

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION log_clean(line STRING) RETURNS STRING RETURN {clean_sql('line')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION log_mask(line STRING) RETURNS STRING RETURN {mask_sql('line')}")
    spark.udf.register("json_label", columns.json_label)
    spark.udf.register("json_find", columns.detect_json)
    spark.udf.register("spans", columns.find_spans)
    spark.udf.register("json_segments", columns.json_segments)
    spark.udf.register("json_compact", columns.json_compact)
    spark.udf.register("json_slices", columns.json_slices)
    spark.udf.register("json_level_range", columns.json_level_range)
    spark.udf.register("json_field_path", columns.json_field_path)
    spark.udf.register("json_child_rows", columns.json_child_rows)
    spark.udf.register("json_node_rows", columns.json_node_rows)
    spark.udtf.register("json_children", columns.JsonChildren)
    spark.udtf.register("json_tree", columns.JsonTree)
    if lines is not None:
        lines.createOrReplaceTempView("lines")
        # a window is 4096 lines of a stream: no task merges the templates of a whole one
        templates.templates(templates.visible_windows(lines)).createOrReplaceTempView("templates")
        spark.sql("SELECT l.stream_id, l.line_no, t.* FROM lines l, LATERAL inline(json_node_rows(l.json)) t WHERE l.json IS NOT NULL").createOrReplaceTempView("json_nodes")
