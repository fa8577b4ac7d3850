"""More queries over lines made of the driver's tables: structure, JSON views, tables, sessions, search and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean, columns, dates
from ..operators import classify, freq, rates, search, sequence, silhouette, templates, tree
from ..sources import generate
from ..sources.lines import lines_from_df, merged, spread, write_chunked
from ..sources.shared import shared_path
from .queries import _arrivals, _event_lines, _json_lines, _table, _trees, query


def _made(spark: SparkSession, sf_dir: str, table: str, key: str, stream: str, texts: list) -> DataFrame:
    """Lines of texts (expressions) for each row, in order of key and place."""
    d = _table(spark, sf_dir, table).select(F.expr(stream).alias("s"), F.col(key).alias("k"), F.posexplode(F.array(*[F.expr(t) for t in texts])).alias("p", "text"))
    return lines_from_df(d, "text", ["k", "p"], "s")


@query("SELECT 'json' AS line_type, CASE event_type WHEN 'error' THEN 2 ELSE 0 END AS status, count(*) AS cnt, count(*) AS alone FROM events GROUP BY 2")
def json_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as one stream of JSON lines."""
    text = "concat('{\"level\":\"', case event_type when 'error' then 'ERR' else 'info' end, '\",\"id\":', event_id, ',\"p\":', props, '}')"
    e = _table(spark, sf_dir, "events").select(F.lit("events").alias("stream_id"), F.col("event_id").alias("line_no"), F.expr(text).alias("text"))
    d = sequence.structure(e, columns=["line_type", "status", "group_id"])
    return d.groupBy("line_type", F.col("status").cast("int").alias("status")).agg(F.count("*").alias("cnt"), F.sum((F.col("group_id") == 0).cast("int")).alias("alone"))


_SHORT = "'{\"type\":\"' || event_type || '\",\"user\":' || user_id || ',\"props\":' || props || '}'"


@query(f"""
SELECT event_id, true AS inline, 'type,user,props' AS keys, CASE WHEN strlen(t) > 60 THEN t[:57] || '...' ELSE replace(t, ' ', '') END AS summary, '' AS level
FROM (SELECT event_id, {_SHORT} AS t FROM events)
""")
def json_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(_event_lines(spark, sf_dir)).select(F.col("line_no").alias("event_id"), columns.detect_json(F.concat(F.lit("  "), "json", F.lit(" "))).alias("j"))
    return d.select("event_id", "j.inline", F.array_join("j.keys", ",").alias("keys"), "j.summary", "j.level")


@query("""
SELECT CASE event_id % 7 WHEN 0 THEN '{"id": [' || event_id || ']}' WHEN 1 THEN '{"a":{"b":' || event_id || '}}' WHEN 2 THEN '{"q":' || event_id || '}' ELSE NULL END AS found, event_id FROM events
""")
def json_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare members, JSON within a line, and what only looks like it."""
    raw = """case event_id % 7 when 0 then concat('"id": [', event_id, ']') when 1 then concat('got {"a":{"b":', event_id, '}} end') when 2 then concat('x = \\'{"q":', event_id, '}\\'')
        when 3 then concat('${HOME}/', event_id) when 4 then concat('{%d} of ', event_id) when 5 then concat('- a:b:', event_id) else concat('{} [', event_id, ']') end"""
    return _table(spark, sf_dir, "events").select("event_id", columns.detect_json(F.expr(raw))["raw"].alias("found"))


@query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'plain json level-error json plain' WHEN 'click' THEN 'plain json level-warn json plain' ELSE 'plain json plain' END AS styles,
       CASE event_type WHEN 'error' THEN '"err"' WHEN 'click' THEN '"Warning"' END AS level_text FROM events
""")
def json_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("concat('event ', event_id, ' {\"k\":1,\"level\":\"', case event_type when 'error' then 'err' when 'click' then 'Warning' else 'odd' end, '\",\"z\":[2]} done')")
    d = spread(_table(spark, sf_dir, "events")).select("event_id", columns.json_segments(raw).alias("s"))
    level = F.element_at(F.filter("s", lambda s: F.startswith(s["style"], F.lit("level-"))), F.lit(1))
    return d.select("event_id", F.array_join(F.transform("s", lambda s: s["style"]), " ").alias("styles"), F.when(F.exists("s", lambda s: F.startswith(s["style"], F.lit("level-"))), level["text"]).alias("level_text"))


_ORDER = "concat('{ \"z\" : ', o_orderkey, ', \"who\":{\"cust\":', o_custkey, ', \"tags\": [\"', o_orderstatus, '\", 1.50]}, \"level\":\"warn\"}')"
_FLAT = "'{\"z\": ' || o_orderkey || ', \"who\": {\"cust\": ' || o_custkey || ', \"tags\": [\"' || o_orderstatus || '\", 1.5]}, \"level\": \"warn\"}'"


@query(f"SELECT o_orderkey, {_FLAT} AS wide, CASE WHEN strlen(t) <= 40 THEN t ELSE t[:37] || '...' END AS narrow, t[:3] AS least FROM (SELECT *, {_FLAT} AS t FROM orders)")
def json_one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda w: columns.json_compact(F.expr(_ORDER), F.lit(w))
    return spread(_table(spark, sf_dir, "orders")).select("o_orderkey", shown(500).alias("wide"), shown(40).alias("narrow"), shown(3).alias("least"))


@query("""
SELECT o_orderkey, v.key, CASE v.key WHEN 'z' THEN o_orderkey::VARCHAR WHEN 'level' THEN '"warn"' ELSE '{"cust":' || o_custkey || ', "tags": ["' || o_orderstatus || '", 1.50]}' END AS text, v.key = 'level' AS is_level
FROM orders, (VALUES ('z'), ('who'), ('level')) v(key)
""")
def json_raw_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children as they stand in the text, and the place of the level among them."""
    d = spread(_table(spark, sf_dir, "orders")).select("o_orderkey", F.expr(_ORDER).alias("t")).select("o_orderkey", columns.json_level_range("t").alias("l"), F.explode(columns.json_slices("t")).alias("s"))
    return d.select("o_orderkey", "s.key", "s.text", ((F.col("l.start") == F.col("s.start")) & (F.col("l.end") == F.col("s.end"))).alias("is_level"))


@query("SELECT o_orderkey, 'who.tags' AS to_tags, 'z' AS to_z, true AS through_array, true AS nowhere FROM orders")
def json_field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda *c: columns.json_field_path(F.expr(_ORDER), F.array(*[F.lit(i) for i in c]))
    return spread(_table(spark, sf_dir, "orders")).select("o_orderkey", F.array_join(at(1, 1), ".").alias("to_tags"), F.array_join(at(0), ".").alias("to_z"), at(1, 1, 0).isNull().alias("through_array"), at(7).isNull().alias("nowhere"))


@query("""
SELECT o_orderkey AS line_no, v.* FROM orders, (VALUES ('id', 'who', NULL, 'who', false), ('who', 'who.cust', 'id', 'who.tags', false), ('who.cust', 'who.tags', 'who', 'who.tags', false), ('who.tags', NULL, 'who.cust', NULL, true))
  v(path, next_path, prev_path, next_expandable, is_last)
""")
def tree_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves with the tags collapsed."""
    nodes = _trees(spark, sf_dir).select("line_no", F.inline(columns.json_node_rows("json"))).select("line_no", "ord", "path", "kind", "value")
    shut = nodes.where(F.array_join("path", ".") == "who.tags").select("line_no", "path")
    d = tree.moves(tree.visible(nodes, shut))
    return d.select("line_no", *[F.array_join(c, ".").alias(c) for c in ("path", "next_path", "prev_path", "next_expandable")], "is_last")


@query("""
SELECT 'gotest_result' AS line_type, CASE o_orderstatus WHEN 'F' THEN 'FAIL' ELSE 'PASS' END AS action, '' AS test_name, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 1 END AS status, 2 * count(*) AS cnt FROM orders GROUP BY 2, 4
""")
def gotest_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare results and the summaries of packages."""
    bare, package = "case o_orderstatus when 'F' then ' FAIL' else 'PASS ' end", "concat(case o_orderstatus when 'F' then 'FAIL' else 'ok  ' end, '\\texample.com/p', o_orderkey, '\\t0.12s')"
    d = sequence.structure(_made(spark, sf_dir, "orders", "o_orderkey", "o_custkey % 32", [bare, package]))
    return d.groupBy("line_type", "action", F.coalesce("test_name", F.lit("")).alias("test_name"), F.col("status").cast("int").alias("status")).agg(F.count("*").alias("cnt"))


@query("""
SELECT n_regionkey::VARCHAR AS stream_id, line_type, diff_kind, (count(*) * max(k))::BIGINT AS cnt FROM nation, (VALUES ('diff', 'header-old', 1), ('gotest_result', '', 1), ('plain', '', 2)) v(line_type, diff_kind, k) GROUP BY 1, 2, 3
""")
def diff_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test's result between the headers of a diff ends it."""
    texts = ["concat('--- a/', n_name)", "'--- PASS: TestIt (0.10s)'", "concat('+++ b/', n_name)", "'@@ -1,5 +1,5 @@'"]
    d = sequence.structure(_made(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", texts))
    return d.groupBy("stream_id", "line_type", F.coalesce("diff_kind", F.lit("")).alias("diff_kind")).agg(F.count("*").alias("cnt"))


_PADDED = "rpad(n_name, 20, ' ') || rpad(n_nationkey::VARCHAR, 8, ' ') || 'r' || n_regionkey"


@query("""
SELECT n_regionkey::VARCHAR AS stream_id, rpad(n_name, 19, ' ') || '│' || rpad(n_nationkey::VARCHAR, 7, ' ') || '│r' || n_regionkey AS text, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS is_header, '0,20,28' AS columns FROM nation
""")
def space_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat(rpad(n_name, 20, ' '), rpad(cast(n_nationkey as string), 8, ' '), 'r', n_regionkey)"
    d = sequence.separated_text(sequence.structure(_made(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", [text])))
    return d.select("stream_id", "text", "is_header", F.array_join(F.transform("columns", lambda c: c.cast("string")), ",").alias("columns"))


@query("SELECT n_regionkey::VARCHAR AS stream_id, 'plain' AS line_type, 2 * count(*) AS cnt FROM nation GROUP BY 1")
def tab_indents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that tabs indent, and log lines of two columns, are no tables."""
    d = sequence.structure(_made(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", ["concat('\\t\\t\\t\\t', n_name)", "concat('app', '  ', n_name)"]))
    return d.groupBy("stream_id", "line_type").agg(F.count("*").alias("cnt"))


@query("""
SELECT n_nationkey::VARCHAR AS stream_id, '[ffmpeg] time=00:00:0' || n_nationkey % 9 || '.00' || CASE WHEN n_nationkey > 0 THEN ' frame=' || n_nationkey ELSE '' END || ' speed=1.5x bitrate=12kbits/s' || CASE WHEN n_nationkey > 0 THEN ' size=' || n_nationkey || '.0KiB' ELSE '' END
       || CASE n_nationkey % 2 WHEN 0 THEN ' 100.0% done' ELSE ' 6.0% aborted' END AS raw, CASE n_nationkey % 2 WHEN 0 THEN 1.0 ELSE 0.06 END::DOUBLE AS percent, n_nationkey % 2 = 0 AS ended, 2 AS blocks, 13 AS lines FROM nation
""")
def progress_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each session, ended or cut off by another line, with its text."""
    block = ["concat('frame=', n_nationkey)", "concat('total_size=', n_nationkey * 1024)", "concat('out_time=00:00:0', n_nationkey % 9, '.00')", "'stream_0_0_q=1'", "'speed=  1.5x'", "'bitrate=  12kbits/s'"]
    texts = [*block, "'progress=continue'", *block[:5], "concat('progress=', case when n_nationkey % 2 = 0 then 'end' else 'continue' end)", "'plain text'"]
    d = sequence.structure(_made(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", texts)).where("line_type = 'progress'")
    return d.select("stream_id", "raw", "progress.percent", "progress.ended", F.col("progress.block_count").alias("blocks"), "lines")


_SPANS = [
    ("I0425 10:00:00.123456       1 main.go:12] up", "level-info datetime plain sourceref plain"),
    ("F0425 10:00:00.1 x", "level-error datetime plain"),
    ("12:34:56 x", "timestamp plain"),
    ("err, client: 10.0.0.1, server: web", "plain nginx-field plain ip plain nginx-field plain"),
    ("while reading PROXY protocol, x", "nginx-field plain"),
    ("it failed in step 3/x", "plain failed-step"),
    ("1m   Warning   BackOff   pod/web", "plain k8s-event-warning plain k8s"),
    ("1m   Normal   x", "plain k8s-event-normal plain"),
    ("see a/b.py:3 and http://a.go:4", "plain sourceref plain"),
    ("deployment.apps/web a.b/c svc/x", "k8s plain k8s"),
    ("2024/01/02 03:04:05 [alert] x", "datetime plain level-error plain"),
    ("[emerg] [debug] x", "level-error plain level-debug plain"),
]


@query("SELECT event_id, v.styles FROM events JOIN (VALUES " + ", ".join(f"({i}, '{s}')" for i, (_, s) in enumerate(_SPANS)) + f") v(i, styles) ON v.i = event_id % {len(_SPANS)}")
def span_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(t) for t, _ in _SPANS]), (F.col("event_id") % len(_SPANS)).cast("int") + 1)
    d = _table(spark, sf_dir, "events").select("event_id", columns.find_spans(raw).alias("s"))
    return d.select("event_id", F.array_join(F.transform("s", lambda s: s["style"]), " ").alias("styles"))


@query("SELECT (user_id % 4)::VARCHAR AS stream_id, count(*) AS lines, sum(strlen(event_type))::BIGINT AS bytes, 1 AS at_0, 0 AS at_end FROM events GROUP BY 1")
def chunked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written by chunk, read again, and looked up by number."""
    path = shared_path(spark)
    write_chunked(lines_from_df(_table(spark, sf_dir, "events"), "event_type", ["event_id"], F.col("user_id") % 4), path)
    d = spark.read.schema("line_no long, text string, source string, stream_id string, chunk_id long").parquet(path)
    found = lambda n, name: search.point(d, n).groupBy("stream_id").agg(F.count("*").cast("int").alias(name))
    out = d.groupBy("stream_id").agg(F.count("*").alias("lines"), F.sum(F.octet_length("text")).alias("bytes"))
    for n, name in ((0, "at_0"), (1 << 40, "at_end")):
        out = out.join(found(n, name), "stream_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@query("""
SELECT label, is_rule, rule_idx, cnt FROM (SELECT 'browse' AS label, true AS is_rule, 0 AS rule_idx, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS cnt FROM events WHERE event_id >= 400
UNION ALL SELECT 'never', true, 1, 0 UNION ALL SELECT event_type, false, -1, count(*) FROM events WHERE event_id >= 400 AND event_type NOT IN ('click', 'view') GROUP BY 1)
""")
def statistic_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered after 700 lines: the last 300 of them from history, and the others as a stream, in two runs."""
    from ..streaming.statistic import counts, follow, register

    s = freq.Stat(["type"], [freq.Rule("click|view", "browse"), freq.Rule("never")], last_n=300)
    lines = _event_lines(spark, sf_dir).select(F.lit("events").alias("stream_id"), "line_no", F.lit("json").alias("line_type"), "json")
    base = shared_path(spark)
    write = lambda d: d.write.mode("append").parquet(f"{base}/lines")
    write(lines.where("line_no < 700"))
    register(spark, f"{base}/lines", s, f"{base}/stat", exact=False)
    for part in ("line_no >= 700 and line_no % 2 = 0", "line_no >= 700 and line_no % 2 = 1"):
        write(lines.where(part))
        follow(spark, f"{base}/lines", s, f"{base}/stat", exact=False, available_now=True).awaitTermination()
    return counts(spark, s, f"{base}/stat")


@query("SELECT 1 AS stat_id, (SELECT count(*) FROM events) AS total, 0 AS dropped, 0 AS pending UNION ALL SELECT 2, (SELECT count(*) FROM events), 0, 0")
def stat_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("json")
    return freq.totals(freq.several(_event_lines(spark, sf_dir), {1: (freq.fast_label(j, ["type"]), [freq.Rule("no"), freq.Rule("click")]), 2: (freq.fast_label(j, ["user"]), [])}), ("stat_id",))


@query("SELECT event_type AS label, false AS is_rule, count(*) FILTER (WHERE event_type <> 'click') AS cnt FROM events WHERE event_type <> 'click' GROUP BY 1 UNION ALL SELECT 'no', true, 0 UNION ALL SELECT 'click', true, count(*) FROM events WHERE event_type = 'click'")
def several_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = {1: (freq.fast_label(F.col("json"), ["type"]), [freq.Rule("no"), freq.Rule("click")])}
    return freq.several(_event_lines(spark, sf_dir), stats).select("label", "is_rule", "cnt")


@query("""
WITH a AS (SELECT user_id % 8 AS s, epoch_us(ts) AS us, CASE WHEN event_type <> 'view' THEN (value * 1000000)::BIGINT END AS lag FROM events), t AS (SELECT s, count(*) AS n, (max(us) - min(us)) / 1000.0 AS ms, count(lag) AS tagged, max(lag) / 1e6 AS mx FROM a GROUP BY 1)
SELECT s AS stream_id, unnest(['ingest_lines=' || n, printf('ingest_ms=%.3f', ms::DOUBLE), 'tagged_lines=' || tagged, printf('max_lag_ms=%.3f', mx::DOUBLE)]) AS text FROM t
""")
def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arrivals(spark, sf_dir)
    d = rates.totals_text(a, rates.rate_windows(a, 86400.0), keeping_up_ms=50.0)
    return d.where("text rlike '^(ingest_lines|ingest_ms|tagged_lines|max_lag_ms)='").select("stream_id", "text")


_CELL = " + ".join(f"CASE WHEN 2 * c + {side} >= b AND 2 * c + {side} < e THEN {bit} ELSE 0 END" for side, bit in ((0, 1), (1, 8)))


@query(f"SELECT n_nationkey AS stream_id, 0 AS \"row\", 2 AS status, array_to_string(list_transform(range(0, 8), lambda c: chr(({_CELL})::INT + 10240)), '') AS cells FROM (SELECT n_nationkey, n_nationkey % 7 AS b, n_nationkey % 7 + 1 + n_nationkey % 5 AS e FROM nation)")
def braille_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stream_id"), F.lit(0).alias("line_no"), (F.col("n_nationkey") % 7).alias("ext_beg"), (F.col("n_nationkey") % 7 + 1 + F.col("n_nationkey") % 5).alias("ext_end"), F.lit(2).alias("status"))
    return silhouette.braille(silhouette.silhouette(d, 1, 8), 8)


@query("""
WITH l AS (SELECT event_id AS i, event_id % 7 AS b, event_id % 7 + 1 + event_id % 50 AS e, CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS st FROM events), m AS (SELECT max(i) AS last, max(e) AS mc FROM l),
s AS (SELECT least(31, floor((i - greatest(0, last - 4095)) * least(1.0::DOUBLE, 32.0::DOUBLE / (last - greatest(0, last - 4095) + 1))))::INT AS r, floor(b * h)::INT AS b, least(20, greatest(floor(e * h), floor(b * h) + 1))::INT AS e, st
      FROM (SELECT l.*, last, least(1.0::DOUBLE, 20.0::DOUBLE / mc) AS h FROM l, m) WHERE i > last - 4096),
g AS (SELECT r, min(b) AS beg, max(e) AS "end", max(st) AS st FROM s GROUP BY r)
SELECT r // 4 AS "row", r % 4 AS sub_row, beg, "end", (max(st) OVER (PARTITION BY r // 4))::INT AS status FROM g
""")
def silhouette_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 4096 lines of a stream, with outcomes."""
    beg = F.col("event_id") % 7
    d = _table(spark, sf_dir, "events").select(F.lit("s").alias("stream_id"), F.col("event_id").alias("line_no"), beg.alias("ext_beg"), (beg + 1 + F.col("event_id") % 50).alias("ext_end"), F.expr("case event_type when 'error' then 2 when 'view' then 1 else 0 end").alias("status"))
    return silhouette.silhouette(d, 8, 10).drop("stream_id")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE CASE WHEN event_id % 4 = 1 AND user_id > 0 THEN 1 + user_id ELSE greatest(1, ceil((strlen(props) + 3) / 5.0)) END END::BIGINT AS rows, CASE event_id % 4 WHEN 0 THEN 0 ELSE 1 END::BIGINT AS unwrapped FROM events
""")
def rows_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden lines, expanded trees, lines that never wrap, and others."""
    k = F.col("event_id") % 4
    below = F.when(k == 1, F.col("user_id")).otherwise(0)
    return _table(spark, sf_dir, "events").select("event_id", search.rows_of(F.col("props"), 5, True, k == 0, below, k == 2).alias("rows"), search.rows_of(F.col("props"), 5, False, k == 0).alias("unwrapped"))


_JOB = "concat('job ', replace(n_name, ' ', '_'), ' finished with code zero on host')"


@query("""
SELECT n_regionkey AS window_id, CASE WHEN k <= 3 THEN 'job * finished with code zero on host' ELSE 'job ' || replace(n_name, ' ', '_') || ' finished with code zero on host' END AS template, count(*) AS n, min(n_nationkey) AS first_line
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY 1, 2
""")
def template_merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines a window that differ in one word of eight: they merge down to the root of five, and no further."""
    return templates.templates(_jobs(spark, sf_dir)).select("window_id", "template", "n", "first_line")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("window_id"), F.col("n_nationkey").alias("line_no"), F.expr(_JOB).alias("raw"))


@query("SELECT n_nationkey AS line_no FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) WHERE k <= 3")
def template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the templates that stand for more than one."""
    d = _jobs(spark, sf_dir)
    return templates.lines_of(d, templates.templates(d).where("n > 1")).select("line_no")


@query("SELECT 'e#' || (event_id // 64) AS window_id, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "events").select(F.lit("e").alias("stream_id"), F.col("event_id").alias("line_no"), (F.col("event_id") % 3 == 0).alias("hidden"))
    return templates.visible_windows(d, 64).groupBy("window_id").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN strlen(t) <= 12 THEN t ELSE t[:11] || '…' END AS cut, t[:2] AS least, CASE WHEN b >= 1073741824 THEN printf('%.1fGB', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN (b >> 20) || 'MB' WHEN b >= 1024 THEN (b >> 10) || 'KB' ELSE b || 'B' END AS bytes
FROM (SELECT o_orderkey, o_orderpriority AS t, o_orderkey * (1 + o_custkey % 3 * 40000) AS b FROM orders)
""")
def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, b = F.col("o_orderpriority"), F.expr("o_orderkey * (1 + o_custkey % 3 * 40000)")
    return _table(spark, sf_dir, "orders").select("o_orderkey", classify.truncated(t, 12).alias("cut"), classify.truncated(t, 2).alias("least"), classify.short_bytes(b).alias("bytes"))


@query("SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id % 8 ORDER BY event_id)) / 1e6 AS seconds FROM events")
def line_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("at "), F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" done"))
    d = _table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("stream_id"), F.col("event_id").alias("line_no"), raw.alias("raw"))
    return dates.since_line_before(d).select(F.col("line_no").alias("event_id"), "seconds")


@query("SELECT event_id, '[LLB:' || event_id || '] ' || event_type AS tagged, event_type AS raw, event_id AS lag_ns FROM events")
def lag_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "events").select("event_id", clean.add_lag_prefix(F.col("event_type"), F.col("event_id")).alias("tagged"))
    return clean.clean_lines(d, "tagged", bench=True).select("event_id", "tagged", "raw", "lag_ns")


@query("SELECT v.text, count(*) AS cnt, min(i) AS first_line FROM range(0, 1000) r(i) JOIN (VALUES (0, 'a'), (1, 'b'), (2, 'c')) v(k, text) ON v.k = i % 3 GROUP BY 1")
def template_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.from_template(spark, ["a", "b", "c"], 1000).groupBy("text").agg(F.count("*").alias("cnt"), F.min("line_no").alias("first_line"))


def _integral(rate: str) -> str:
    return f"SELECT i AS tick, floor(sum(CASE WHEN i = 0 THEN 0 ELSE ({rate.format(i='(i - 1)')} + {rate.format(i='i')}) / 2 * 0.001 END) OVER (ORDER BY i) + 1e-6)::BIGINT AS due FROM range(0, 2000) r(i)"


@query(_integral("(100.0::DOUBLE + 900.0 * greatest(0.0, least(1.0, {i} * 0.001::DOUBLE / 1.5)))"))
def load_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.schedule(spark, generate.linear(100.0, 1000.0, 1.5), 2.0).select("tick", "due")


@query(_integral("(100.0::DOUBLE * exp(ln(50.0) * greatest(0.0, least(1.0, {i} * 0.001::DOUBLE / 1.7))))"))
def load_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.schedule(spark, generate.exponential(100.0, 5000.0, 1.7), 2.0).select("tick", "due")


@query("SELECT CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS source, event_type = 'error' AS from_stderr, count(*) AS cnt FROM events GROUP BY 1, 2")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    each = [lines_from_df(e.where(c), "event_type", ["event_id"], F.lit(s), s) for s, c in (("stdout", "event_type <> 'error'"), ("stderr", "event_type = 'error'"))]
    return merged(*each).groupBy("source", "from_stderr").agg(F.count("*").alias("cnt"))


@query("SELECT CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS source, event_type = 'error' AS from_stderr, 'json' AS line_type, count(*) AS cnt FROM events GROUP BY 1, 2")
def typed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tagged channels, structured: each typed line tells where it came from."""
    e = _event_lines(spark, sf_dir)
    error = F.get_json_object("json", "$.type") == "error"
    each = [lines_from_df(e.where(c), "json", ["line_no"], F.lit(s), s) for s, c in (("stdout", ~error), ("stderr", error))]
    return sequence.structure(merged(*each), columns=["source", "from_stderr", "line_type"]).groupBy("source", "from_stderr", "line_type").agg(F.count("*").alias("cnt"))


def _stream(spark: SparkSession, d: DataFrame) -> tuple[DataFrame, str]:
    base = shared_path(spark)
    d.write.parquet(f"{base}/in")
    return spark.readStream.schema(d.schema).parquet(f"{base}/in"), base


#: Lines of a batch of stream_structure.
BATCH_LINES = 1 << 17


@query("SELECT 'json' AS line_type, count(*) AS cnt FROM events")
def stream_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of JSON lines, structured as they come; a whole JSON line is final at once."""
    from ..streaming.live import run_available, structure_stream

    base = shared_path(spark)
    lines = lines_from_df(_event_lines(spark, sf_dir), "json", ["line_no"], "stream_id").drop("source")
    lines.withColumn("_batch", F.expr(f"line_no div {BATCH_LINES}")).repartition("_batch").write.partitionBy("_batch").parquet(f"{base}/batches")
    n = lines.count()
    for k in range(-(-n // BATCH_LINES) or 1):  # files in the order of their lines, one a batch
        part = spark.read.schema(lines.schema).parquet(f"{base}/batches/_batch={k}") if n else lines
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    d = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run_available(structure_stream(d), f"{base}/out", f"{base}/check")
    return spark.read.parquet(f"{base}/out").groupBy("line_type").agg(F.count("*").alias("cnt"))


_HOURS = "SELECT user_id % 8 AS stream_id, epoch_us(date_trunc('hour', ts)) AS begin_us, (value * 1000000)::BIGINT AS lag FROM events"


@query(f"""
SELECT stream_id, begin_us, count(*) AS lines, max(lag) AS lag_max_ns, count(*) AS tagged, true AS p50_near, true AS p99_near
FROM ({_HOURS}) WHERE begin_us + 7200000000 <= (SELECT max(begin_us) FROM ({_HOURS})) GROUP BY 1, 2
""")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rates over a stream in time's order, handed out once the watermark has passed them; *_near: whether a percentile out of the sketch is of a rank within 1 % (or one line) of its own."""
    from ..streaming.live import live_rates, run_available

    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("stream_id"), F.timestamp_micros(_micros()).alias("arrival_ts"), F.round(F.col("value") * 1000000).cast("long").alias("lag_ns"))
    d, base = _stream(spark, e)
    run_available(live_rates(d, 3600, "1 hour"), f"{base}/out", f"{base}/check")
    done = rates.sketch_percentiles(spark.read.parquet(f"{base}/out")).withColumn("begin_us", F.unix_micros("window.start"))
    own = e.withColumn("begin_us", F.unix_micros(F.date_trunc("hour", "arrival_ts")))
    hour = Window.partitionBy("stream_id", "begin_us")
    ranked = own.withColumn("_below", F.rank().over(hour.orderBy("lag_ns")) - 1).withColumn("_n", F.count("*").over(hour))
    ranked = ranked.withColumn("_upto", F.count("*").over(hour.orderBy("lag_ns").rangeBetween(Window.unboundedPreceding, 0)))
    top = own.groupBy().agg(F.max("begin_us").alias("_top"))
    near = lambda q: F.max(F.when((F.col("lag_ns") / 1e6 == F.col(f"lag_p{q}_ms")) & (F.col("_below") <= q / 100 * F.col("_n") + F.greatest(F.lit(1.0), 0.01 * F.col("_n"))) & (F.col("_upto") >= q / 100 * F.col("_n") - F.greatest(F.lit(1.0), 0.01 * F.col("_n"))), True).otherwise(False))
    d = done.join(ranked.select("stream_id", "begin_us", "lag_ns", "_below", "_upto", "_n"), ["stream_id", "begin_us"]).crossJoin(F.broadcast(top)).where("begin_us + 7200000000 <= _top")
    return d.groupBy("stream_id", "begin_us").agg(F.max("lines").alias("lines"), F.max("lag_max_ns").alias("lag_max_ns"), F.max("tagged").alias("tagged"), near(50).alias("p50_near"), near(99).alias("p99_near"))


@query("""
SELECT shape, line_type, count(*) AS n, CASE WHEN line_type IN ('table', 'diff') THEN 1 ELSE 0 END AS groups, sum(lines)::BIGINT AS lines FROM (
  SELECT 'two blanks' AS shape, 'table' AS line_type, 1 AS lines FROM lineitem UNION ALL SELECT 'indented', 'plain', 1 FROM lineitem UNION ALL SELECT 'open brace', 'plain', 1 FROM lineitem
  UNION ALL SELECT 'tabs', 'table', 1 FROM lineitem UNION ALL SELECT 'session', 'progress', count(*) FROM lineitem UNION ALL SELECT 'diff', 'diff', 1 FROM lineitem UNION ALL SELECT 'diff', 'diff', 1 FROM range(3)) GROUP BY 1, 2
""")
def fold_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that no line cuts, each of all line items: one table, one diff, one session, and lines that stay plain."""
    texts = {
        "two blanks": "concat('12:00  INFO  ', l_partkey)", "indented": "concat('    at ', l_partkey)", "open brace": "concat('x { ', l_partkey)", "tabs": "concat(l_orderkey, '\t', l_partkey, '\t', l_suppkey)",
        "session": "concat('frame=', l_partkey)", "diff": "concat(case l_linenumber % 3 when 0 then '+' when 1 then '-' else ' ' end, l_partkey)"}
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("s"), F.expr(t).alias("text")) for k, t in texts.items()])).alias("m")
    li = _table(spark, sf_dir, "lineitem").select(F.lit(3).alias("a"), F.xxhash64("*").alias("k"), made).select("a", "k", "m.s", "m.text")
    head = spark.createDataFrame([(i, 0, "diff", t) for i, t in enumerate(("--- a", "+++ b", "@@ -1 @@"))], li.schema)
    d = sequence.structure(lines_from_df(li.unionByName(head), "text", ["a", "k", "text"], "s"), columns=["stream_id", "line_type", "group_id", "lines"])
    return d.groupBy(F.col("stream_id").alias("shape"), "line_type").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("group_id") > 0, F.col("group_id"))).alias("groups"), F.sum("lines").cast("long").alias("lines"))


@query("SELECT c_nationkey::VARCHAR AS stream_id, line_type, final, count(*) AS n FROM (SELECT c_nationkey, unnest([struct_pack(line_type := 'json', final := true), struct_pack(line_type := 'json', final := true), struct_pack(line_type := 'json', final := true)], recursive := true) FROM customer) GROUP BY 1, 2, 3")
def stream_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-line JSON that arrives line by line in three batches: each line is plain first, and JSON when its group has closed."""
    from ..streaming.live import current_lines, structure_stream, write_revisions

    c = _table(spark, sf_dir, "customer")
    texts = F.array(F.lit("saved {"), F.concat(F.lit('"id": '), F.col("c_custkey").cast("string")), F.lit("}"))
    lines = lines_from_df(c.select("c_nationkey", "c_custkey", F.posexplode(texts).alias("p", "text")), "text", ["c_custkey", "p"], "c_nationkey").drop("source")
    base = shared_path(spark)
    for part in ("line_no < 50", "line_no between 50 and 99", "line_no > 99"):  # a group's lines arrive in different batches
        lines.where(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    d = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    write_revisions(structure_stream(d, provisional=True), f"{base}/out", f"{base}/check").awaitTermination()
    return current_lines(spark, f"{base}/out").groupBy("stream_id", "line_type", "final").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT o_custkey % 4 AS s, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) - 1 AS line_no, strlen(o_orderpriority) AS b FROM orders),
c AS (SELECT s, line_no // 64 AS k, sum(b) AS b, count(*) AS n, max(line_no) AS last FROM l GROUP BY 1, 2),
u AS (SELECT *, sum(b) OVER (PARTITION BY s ORDER BY k DESC) AS upto, row_number() OVER (PARTITION BY s ORDER BY k DESC) AS nth FROM c)
SELECT s::VARCHAR AS stream_id, count(*) FILTER (WHERE upto > 5000 AND nth > 1) AS evicted, (sum(n) FILTER (WHERE NOT (upto > 5000 AND nth > 1)))::BIGINT AS lines, CASE WHEN bool_or(upto > 5000 AND nth > 1) THEN '[line evicted from disk cache]' END AS first_line FROM u GROUP BY 1
""")
def store_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of lines that evicts its oldest chunks: what is gone by the manifest, what is left, and what a look-up of the first line shows where it has gone."""
    from ..sources.store import Store

    o = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("s"), "o_orderkey", "o_orderpriority")
    store = Store(spark, shared_path(spark), 64)
    store.append(lines_from_df(o, "o_orderpriority", ["o_orderkey"], "s"))
    store.evict(5000)
    gone = store.chunks().groupBy("stream_id").agg(F.sum(F.col("evicted").cast("long")).alias("evicted"))
    first = store.get("0", 0)
    for s in ("1", "2", "3"):
        first = first.unionByName(store.get(s, 0))
    first = first.select("stream_id", F.when(F.col("evicted"), F.col("text")).alias("first_line"))
    left = store.lines().groupBy("stream_id").agg(F.count("*").alias("lines"))
    return gone.join(left, "stream_id").join(first, "stream_id", "left")


_TALL = "SELECT o_custkey % 2 AS s, row_number() OVER (PARTITION BY o_custkey % 2 ORDER BY o_orderkey) - 1 AS line_no, 1 + o_orderkey % 3 AS r FROM orders"


@query(f"""
WITH l AS (SELECT s, line_no, CASE WHEN line_no % 500 = 7 THEN r + 40 ELSE r END AS r FROM ({_TALL})), u AS (SELECT *, sum(r) OVER (PARTITION BY s ORDER BY line_no) AS upto FROM l)
SELECT s::VARCHAR AS stream_id, t AS line_no, (sum(r) FILTER (WHERE line_no < t))::BIGINT AS rows_before, coalesce(min(line_no) FILTER (WHERE upto > 2 * t), max(line_no) + 1)::BIGINT AS line_at
FROM u, (VALUES (8), (300), (5000)) v(t) GROUP BY 1, 2
""")
def prefix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index of rows in which some lines have been expanded since: rows before a line, and the line at a row (twice that number)."""
    from ..operators.prefix import PrefixIndex

    o = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 2).alias("s"), "o_orderkey")
    d = lines_from_df(o, F.col("o_orderkey").cast("string"), ["o_orderkey"], "s").select("stream_id", "line_no", (F.col("text").cast("long") % 3 + 1).alias("rows"))
    index = PrefixIndex.build(d, shared_path(spark))
    index.change(d.where("line_no % 500 = 7").withColumn("rows", F.col("rows") + 40))
    found = [(s, t, index.upto(s, t), index.find(s, 2 * t)) for s in ("0", "1") for t in (8, 300, 5000)]
    return spark.createDataFrame(found, "stream_id string, line_no int, rows_before long, line_at long")


@query("SELECT event_type AS text, count(*) AS n FROM events GROUP BY 1")
def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growing files followed by byte offsets, in two runs; the shared folder must be mounted on all machines."""
    from ..sources.tail import TailSource
    from ..streaming.live import run_available

    spark.dataSource.register(TailSource)
    base = shared_path(spark).removeprefix("file://")
    e = _table(spark, sf_dir, "events")
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).select("event_type").write.mode("append").text(f"{base}/logs")
        run_available(spark.readStream.format("tail").option("glob", f"{base}/logs/*.txt").load(), f"{base}/out", f"{base}/check")
    return spark.read.parquet(f"{base}/out").groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT (o_custkey % 16)::VARCHAR AS stream_id, 3 * count(*) AS hidden, count(*) AS heads FROM orders GROUP BY 1")
def hidden_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.structure(_json_lines(spark, sf_dir), columns=["stream_id", "hidden", "group_head"])
    return d.groupBy("stream_id").agg(F.sum(F.col("hidden").cast("long")).alias("hidden"), F.sum(F.col("group_head").cast("long")).alias("heads"))


@query("SELECT event_type AS label, 'id * of * at *' AS mask, count(*) AS n, (sum(user_id))::BIGINT AS users FROM events GROUP BY 1")
def sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered names, used from SQL."""
    from .sql import register

    lines = _event_lines(spark, sf_dir).select(F.lit("events").alias("stream_id"), "line_no", F.col("json").alias("raw"), "json")
    register(spark, lines)
    return spark.sql("""
        SELECT label, mask, count(*) AS n, sum(user) AS users FROM (
            SELECT json_label(json, array('type')) AS label, cast(json_label(json, array('user')) AS bigint) AS user, log_mask(log_clean(concat('id\\t', 10000 + line_no, ' of /x/', line_no, ' at 10.0.0.', line_no % 250, '\\r'))) AS mask FROM lines)
        GROUP BY label, mask""")


def _micros() -> Column:
    return F.expr("unix_micros(cast(ts as timestamp))")
