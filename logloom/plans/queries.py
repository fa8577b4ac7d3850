"""Queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, rx
from ..functions.columns import json_child_rows, json_node_rows
from ..operators import classify, freq, rates, search, sequence, silhouette, templates
from ..sources import generate
from ..sources.lines import lines_from_df, spread
from ..sources.shared import shared_path

RULES = [freq.Rule("click|view", "browse"), freq.Rule("purch.*", "buy"), freq.Rule("refund", "refund")]
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a line of JSON."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("stream_id"), F.col("event_id").alias("line_no"), F.concat(F.lit('{"type":"'), "event_type", F.lit('","user":'), F.col("user_id").cast("string"), F.lit(',"props":'), "props", F.lit("}")).alias("json"))


def _doc_lines(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(stream_id, line_no, raw) of the lines of texts, numbered in each text."""
    return _table(spark, sf_dir, table).select(F.col(key).alias("stream_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).withColumn("line_no", F.col("line_no").cast("long"))


_DOC_LINES = "(SELECT doc_id AS stream_id, (unnest(range(1, len(string_split(text, chr(10))) + 1)) - 1)::BIGINT AS line_no, unnest(string_split(text, chr(10))) AS raw FROM documents)"
_LABEL = "event_type"


@query("""
WITH c AS (SELECT event_type, CASE WHEN regexp_full_match(event_type, 'click|view') THEN 0 WHEN regexp_full_match(event_type, 'purch.*') THEN 1 WHEN regexp_full_match(event_type, 'refund') THEN 2 ELSE -1 END AS rule_idx FROM events)
SELECT r.title AS label, true AS is_rule, r.i AS rule_idx, count(c.rule_idx) AS cnt FROM (VALUES (0, 'browse'), (1, 'buy'), (2, 'refund')) r(i, title) LEFT JOIN c ON c.rule_idx = r.i GROUP BY r.title, r.i
UNION ALL SELECT event_type, false, -1, count(*) FROM c WHERE rule_idx = -1 GROUP BY event_type
""")
def freq_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq.freq(_event_lines(spark, sf_dir).select(freq.fast_label(F.col("json"), ["type"]).alias("label")), RULES)


@query("SELECT props::JSON ->> '$.k' AS label, false AS is_rule, -1 AS rule_idx, count(*) AS cnt FROM events GROUP BY 1")
def freq_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq.freq(_event_lines(spark, sf_dir).select(freq.exact_label(F.col("json"), ["props", "k"]).alias("label")))


@query("SELECT props::JSON ->> '$.k' AS label, false AS is_rule, -1 AS rule_idx, count(*) AS cnt FROM events GROUP BY 1 ORDER BY cnt DESC, label LIMIT 10")
def freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq.top(freq.freq(_event_lines(spark, sf_dir).select(freq.fast_label(F.col("json"), ["props", "k"]).alias("label")), order=False), 10)


@query("SELECT event_type AS label, false AS is_rule, -1 AS rule_idx, count(*) AS cnt FROM events WHERE event_id >= 400 AND event_id < 900 GROUP BY 1")
def freq_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = search.last_before(_event_lines(spark, sf_dir), 900, 500)
    return freq.freq(d.select(freq.fast_label(F.col("json"), ["type"]).alias("label")))


@query("""
SELECT 1 AS stat_id, CASE WHEN regexp_full_match(event_type, 'click|view') THEN 'browse' ELSE event_type END AS label, regexp_full_match(event_type, 'click|view') AS is_rule, count(*) AS cnt FROM events GROUP BY 2, 3
UNION ALL SELECT 2, user_id::VARCHAR, false, count(*) FROM events GROUP BY 2
""")
def multi_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("json")
    return freq.several(_event_lines(spark, sf_dir), {1: (freq.fast_label(j, ["type"]), RULES[:1]), 2: (freq.fast_label(j, ["user"]), [])}).drop("rule_idx")


@query("""
SELECT props::JSON ->> '$.k' AS label, count(*) AS cnt, (count(*) * 160) // (max(count(*)) OVER ()) AS eighths FROM events GROUP BY 1
""")
def freq_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq.bars(freq.freq(_event_lines(spark, sf_dir).select(freq.fast_label(F.col("json"), ["props", "k"]).alias("label"))), 20).select("label", "cnt", "eighths")


@query("SELECT count(*) AS n, round(avg(k), 6) AS avg, min(k) AS min, max(k) AS max FROM (SELECT (props::JSON ->> '$.k')::DOUBLE AS k FROM events)")
def numeric_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = freq.numeric(_event_lines(spark, sf_dir).select(freq.fast_label(F.col("json"), ["props", "k"]).alias("label")))
    return d.select("n", F.round("avg", 6).alias("avg"), "min", "max")


@query("""
SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'fatal' WHEN 'view' THEN 'info' WHEN 'signup' THEN 'warn' ELSE '' END AS level,
       CASE WHEN event_type IN ('error', 'click') THEN 2 ELSE 0 END AS status, count(*) AS cnt FROM events GROUP BY 1, 2
""")
def level_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.expr("case event_type when 'error' then 'ERR' when 'click' then ' Critical' when 'view' then 'notice' when 'signup' then 'Warning' else 'odd' end")
    d = _table(spark, sf_dir, "events").select(classify.json_level(F.to_json(F.struct(F.col("event_id").alias("id"), word.alias("level")))).alias("level"))
    none = F.expr("cast(array() as array<string>)")
    return d.withColumn("status", classify.status(F.lit("json"), F.lit(False), F.lit(False), F.col("level"), none).cast("int")).groupBy("level", "status").agg(F.count("*").alias("cnt"))


_RESULT_LINE = "case o_orderstatus when 'F' then concat('    --- FAIL: TestOrder/', o_orderkey, ' (0.05s)') when 'O' then concat('--- PASS: TestOrder', o_orderkey, ' (1.20s)') else concat('=== RUN   TestOrder', o_orderkey) end"


@query("""
SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN 'gotest_result' ELSE 'gotest_marker' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'RUN' END AS action,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS depth, CASE o_orderstatus WHEN 'F' THEN '0.05s' WHEN 'O' THEN '1.20s' ELSE '' END AS duration, count(*) AS cnt FROM orders GROUP BY ALL
""")
def gotest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "orders").select(classify.gotest(F.expr(_RESULT_LINE)).alias("g"))
    return d.groupBy("g.kind", "g.action", "g.depth", "g.duration").agg(F.count("*").alias("cnt"))


@query("SELECT CASE WHEN event_type IN ('error', 'warn') THEN upper(event_type) ELSE 'PLAIN' END AS level, count(*) AS cnt FROM (SELECT CASE event_type WHEN 'click' THEN 'warn' ELSE event_type END AS event_type FROM events) GROUP BY 1")
def warning_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("case event_type when 'error' then concat('  [Error] at ', event_id) when 'click' then concat('warn: ', event_id) when 'view' then 'INFO: x' else concat('errors: ', event_id) end")
    d = _table(spark, sf_dir, "events").select(F.coalesce(classify.warning_level(raw), F.lit("PLAIN")).alias("level"))
    return d.groupBy("level").agg(F.count("*").alias("cnt"))


@query("""SELECT coalesce((SELECT min(doc_id) FROM documents WHERE contains(lower(text), 'license') AND doc_id >= 500), (SELECT min(doc_id) FROM documents WHERE contains(lower(text), 'license')), -1) AS line_no""")
def search_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_next(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("raw")), "License", 500)


@query("""SELECT coalesce((SELECT max(doc_id) FROM documents WHERE contains(lower(text), 'license') AND doc_id <= 5), (SELECT max(doc_id) FROM documents WHERE contains(lower(text), 'license')), -1) AS line_no""")
def search_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_prev(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("raw")), "License", 5)


def _prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_prefix(_doc_lines(spark, sf_dir).withColumn("rows", search.rows_of(F.col("raw"), 80)), span=64)


_PREFIX = f"(SELECT stream_id, line_no, rows, sum(rows) OVER (PARTITION BY stream_id ORDER BY line_no)::BIGINT AS upto FROM (SELECT stream_id, line_no, greatest(1, ceil((strlen(raw) + 3) / 80.0))::BIGINT AS rows FROM {_DOC_LINES}))"


@query(f"SELECT stream_id, line_no, rows, upto FROM {_PREFIX}")
def rows_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefixed(spark, sf_dir).select("stream_id", "line_no", "rows", "upto")


@query(f"SELECT stream_id, coalesce(min(line_no) FILTER (WHERE upto > 25), max(line_no) + 1) AS line_no FROM {_PREFIX} GROUP BY stream_id")
def rows_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_row(_prefixed(spark, sf_dir), 25)


@query(f"SELECT stream_id, line_no, rows, upto FROM {_PREFIX} WHERE upto > 20 AND upto - rows < 60 AND rows > 0")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(_prefixed(spark, sf_dir), 20, 40).select("stream_id", "line_no", "rows", "upto")


@query(f"""
WITH l AS (SELECT stream_id, line_no // 4 AS chunk_id, sum(strlen(raw)) AS b FROM {_DOC_LINES} GROUP BY 1, 2),
r AS (SELECT *, sum(b) OVER w AS upto, row_number() OVER w AS nth FROM l WINDOW w AS (PARTITION BY stream_id ORDER BY chunk_id DESC))
SELECT d.stream_id, count(*) AS lines, min(d.line_no) AS first_line FROM {_DOC_LINES} d JOIN r ON r.stream_id = d.stream_id AND r.chunk_id = d.line_no // 4 WHERE upto <= 2000 OR nth = 1 GROUP BY 1
""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _doc_lines(spark, sf_dir)
    kept = search.retain(lines, 2000, 4)
    return kept.groupBy("stream_id").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


def _duck_mask() -> str:
    t = "t"
    at = [w for _, w in rx.MASKS].index(None)
    esc = lambda p: p.replace("'", "''")
    for p, w in rx.MASKS[:at]:
        t = f"regexp_replace({t}, '{esc(p)}', '{w}', 'g')"
    run = esc(rx.MASKS[at][0])
    mixed = "(regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')) OR (regexp_matches(m, '[a-zA-Z]') AND regexp_matches(m, '[0-9]')) OR regexp_matches(m, '[+/=]')"
    first = f"list_transform(toks, lambda t: CASE WHEN regexp_matches(t, '^[\"''(\\[]*/') THEN '*' ELSE {t} END)"
    second = f"list_transform(toks, lambda t: CASE WHEN regexp_matches(t, '{run}') THEN array_to_string(list_transform(list_zip(string_split_regex(t, '{run}'), list_transform(regexp_extract_all(t, '{run}'), lambda m: CASE WHEN {mixed} THEN '*' ELSE m END)), lambda z: z[1] || coalesce(z[2], '')), '') ELSE t END)"
    u = "t"
    for p, w in rx.MASKS[at + 1 :]:
        u = f"regexp_replace({u}, '{esc(p)}', '{w}', 'g')"
    third = f"list_transform(toks, lambda t: {u})"
    token = r"[{}\[\]]|[^\s\pZ\x0b\x{85},;|│┃║{}\[\]]+"
    steps = f"SELECT stream_id, line_no, regexp_extract_all(raw, '{token}') AS toks FROM lines"
    for s in (first, second, third):
        steps = f"SELECT stream_id, line_no, {s} AS toks FROM ({steps})"
    return f"SELECT stream_id, line_no, array_to_string(toks, ' ') AS skeleton FROM ({steps})"


@query(f"""
WITH lines AS {_DOC_LINES}, s AS ({_duck_mask()})
SELECT skeleton, count(*) AS n, min(stream_id) AS first_doc FROM s GROUP BY 1
""")
def template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(_doc_lines(spark, sf_dir)).select("stream_id", templates.skeleton(F.col("raw")).alias("skeleton"))
    return d.groupBy("skeleton").agg(F.count("*").alias("n"), F.min("stream_id").alias("first_doc"))


_LOG_LINE = "concat(cast(ts as date), ' [', event_type, '] ', user_id, '#', event_id, ': *', event_id, ' client: 10.0.', user_id % 250, '.', event_id % 250, ', request: \"GET /u/', user_id, ' HTTP/1.1\", took ', value, ' ms id=', case when event_id % 2 = 0 then 'a1B2c3D4e5F6a7B8c9D0' else 'plainwordsonlyhere' end)"


@query(f"""
WITH lines AS (SELECT event_type AS stream_id, event_id AS line_no, {_LOG_LINE} AS raw FROM events), s AS ({_duck_mask()})
SELECT stream_id AS window_id, skeleton, count(*) AS n, min(line_no) AS first_line FROM s GROUP BY 1, 2
""")
def mask_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(_table(spark, sf_dir, "events").select(F.col("event_type").alias("window_id"), F.col("event_id").alias("line_no"), F.expr(_LOG_LINE).alias("raw")))
    return templates.skeletons(d)


@query()
def template_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(_table(spark, sf_dir, "events")).select(F.expr("event_id div 500").alias("window_id"), F.col("event_id").alias("line_no"), F.expr(_LOG_LINE).alias("raw"))
    return templates.templates(d).drop("skeletons")


def _diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    r = _table(spark, sf_dir, "region")
    head = r.select(F.col("r_regionkey").alias("s"), F.posexplode(F.array(F.lit("working"), F.concat(F.lit("--- a/"), "r_name"), F.concat(F.lit("+++ b/"), "r_name"), F.lit("@@ -1,5 +1,5 @@"))).alias("o", "text"))
    body = n.select(F.col("n_regionkey").alias("s"), (F.col("n_nationkey") + 10).alias("o"), F.concat(F.expr("case n_nationkey % 3 when 0 then '+' when 1 then '-' else ' ' end"), "n_name").alias("text"))
    tail = r.select(F.col("r_regionkey").alias("s"), F.lit(1000).alias("o"), F.lit("done").alias("text"))
    return lines_from_df(head.unionByName(body).unionByName(tail), "text", ["o"], "s")


@query("""
SELECT r_regionkey::VARCHAR AS stream_id, k AS diff_kind, 1 AS n, 1 AS groups FROM region, (VALUES ('header-old'), ('header-new'), ('hunk')) v(k)
UNION ALL SELECT n_regionkey::VARCHAR, CASE n_nationkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' ELSE 'context' END, count(*), 1 FROM nation GROUP BY 1, 2
""")
def diff_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.structure(_diff_lines(spark, sf_dir)).where("line_type = 'diff'")
    return d.groupBy("stream_id", "diff_kind").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("groups"))


def _table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    return lines_from_df(n, F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), ["n_nationkey"], "n_regionkey")


@query("""
SELECT n_regionkey::VARCHAR AS stream_id, 1 AS group_id, p AS pos, max(CASE p WHEN 0 THEN strlen(n_nationkey::VARCHAR) WHEN 1 THEN strlen(n_name) ELSE strlen(n_regionkey::VARCHAR) END) AS width
FROM nation, (VALUES (0), (1), (2)) v(p) GROUP BY 1, 3 HAVING count(*) > 1
""")
def table_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.group_widths(sequence.structure(_table_lines(spark, sf_dir)))


@query("SELECT n_regionkey::VARCHAR AS stream_id, count(*) AS n, 1 AS heads, 1 AS groups FROM nation GROUP BY 1 HAVING count(*) > 1")
def table_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.structure(_table_lines(spark, sf_dir)).where("line_type = 'table'")
    return d.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(F.col("is_header").cast("int")).alias("heads"), F.countDistinct("group_id").alias("groups"))


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    parts = F.array(F.lit("saved order {"), F.concat(F.lit('  "id": '), F.col("o_orderkey").cast("string"), F.lit(",")), F.concat(F.lit('  "level": "'), F.expr("case o_orderstatus when 'F' then 'err' else 'info' end"), F.lit('"')), F.lit("}"), F.lit("ok"))
    d = o.select((F.col("o_custkey") % 16).alias("s"), "o_orderkey", F.posexplode(parts).alias("p", "text"))
    return lines_from_df(d, "text", ["o_orderkey", "p"], "s")


@query("""
SELECT (o_custkey % 16)::VARCHAR AS stream_id, CASE o_orderstatus WHEN 'F' THEN 'error' ELSE 'info' END AS level, count(*) AS groups FROM orders GROUP BY 1, 2
""")
def json_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.structure(_json_lines(spark, sf_dir), chunk=1024, columns=["stream_id", "line_type", "group_id", "group_head", "json_prefix", "level"]).where("line_type = 'json' and group_head and json_prefix = 'saved order '")
    return d.groupBy("stream_id", "level").agg(F.countDistinct("group_id").alias("groups"))


@query("""
SELECT t AS line_type, sum(n)::BIGINT AS cnt FROM (
  SELECT 'json' AS t, 4 * count(*) AS n FROM orders UNION ALL SELECT 'plain', count(*) FROM orders UNION ALL SELECT 'diff', 3 * count(*) FROM region
  UNION ALL SELECT 'diff', count(*) FROM nation UNION ALL SELECT 'plain', 2 * count(*) FROM region UNION ALL SELECT 'table', count(*) FROM nation) GROUP BY 1
""")
def line_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [_json_lines(spark, sf_dir), _diff_lines(spark, sf_dir).withColumn("stream_id", F.concat(F.lit("d"), "stream_id")), _table_lines(spark, sf_dir).withColumn("stream_id", F.concat(F.lit("t"), "stream_id"))]
    return sequence.structure(each[0].unionByName(each[1]).unionByName(each[2])).groupBy("line_type").agg(F.count("*").alias("cnt"))


@query("""
SELECT (l_orderkey % 64)::VARCHAR AS stream_id, count(*) FILTER (WHERE last) AS sessions, count(*) FILTER (WHERE last) AS ended, sum(CASE WHEN last THEN f ELSE 0 END)::BIGINT AS frames, count(*) AS blocks
FROM (SELECT l_orderkey, l_linenumber * 100 + l_quantity::INT AS f, rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1 AS last FROM lineitem) GROUP BY 1
""")
def progress_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    last = li.groupBy("l_orderkey").agg(F.max(F.struct(*key)).alias("m"))
    d = li.join(last, "l_orderkey")
    end = F.struct(*key) == F.col("m")
    parts = F.array(F.concat(F.lit("frame="), (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).cast("string")), F.concat(F.lit("[pod-1] speed="), F.col("l_quantity").cast("string"), F.lit("x")), F.concat(F.lit("progress="), F.when(end, "end").otherwise("continue")))
    d = d.select((F.col("l_orderkey") % 64).alias("s"), "l_orderkey", *key, F.posexplode(parts).alias("p", "text"))
    lines = lines_from_df(d, "text", ["l_orderkey", *key, "p"], "s")
    p = sequence.structure(lines, columns=["stream_id", "line_type", "progress"]).where("line_type = 'progress'")
    return p.groupBy("stream_id").agg(F.count("*").alias("sessions"), F.sum(F.col("progress.ended").cast("int")).alias("ended"), F.sum("progress.frame").alias("frames"), F.sum("progress.block_count").alias("blocks"))


_TREE = "to_json(named_struct('id', o_orderkey, 'who', named_struct('cust', o_custkey, 'tags', array(o_orderstatus, o_orderpriority))))"


@query("""
SELECT o_orderkey AS line_no, v.path, v.depth, v.kind, CASE v.path WHEN 'id' THEN o_orderkey::VARCHAR WHEN 'who.cust' THEN o_custkey::VARCHAR WHEN 'who.tags.0' THEN o_orderstatus WHEN 'who.tags.1' THEN o_orderpriority
  WHEN 'who.tags' THEN '["' || o_orderstatus || '","' || o_orderpriority || '"]' ELSE '{"cust":' || o_custkey || ',"tags":["' || o_orderstatus || '","' || o_orderpriority || '"]}' END AS value
FROM orders, (VALUES ('id', 1, 'number'), ('who', 1, 'object'), ('who.cust', 2, 'number'), ('who.tags', 2, 'array'), ('who.tags.0', 3, 'string'), ('who.tags.1', 3, 'string')) v(path, depth, kind)
""")
def json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _trees(spark, sf_dir).select("line_no", F.inline(json_node_rows("json")))
    return nodes.select("line_no", F.array_join("path", ".").alias("path"), "depth", "kind", "value")


@query("""
SELECT o_orderkey AS line_no, v.k AS key, CASE v.k WHEN 'id' THEN '"id": ' || o_orderkey ELSE CASE WHEN strlen(w) > 50 THEN '"who": ' || w[:47] || '...' ELSE '"who": ' || w END END AS shown, v.k = 'who' AS expandable
FROM (SELECT *, '{"cust":' || o_custkey || ',"tags":["' || o_orderstatus || '","' || o_orderpriority || '"]}' AS w FROM orders), (VALUES ('id'), ('who')) v(k)
""")
def json_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir).select("line_no", F.inline(json_child_rows("json"))).select("line_no", "key", "shown", "expandable")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), F.expr(_TREE).alias("json")))


@query(f"""
WITH l AS (SELECT stream_id, line_no, raw, strlen(raw) - strlen(ltrim(raw, ' ' || chr(9))) AS b, strlen(rtrim(raw, ' ' || chr(9))) AS e FROM {_DOC_LINES}),
m AS (SELECT stream_id, max(line_no) + 1 AS total, max(CASE WHEN e = 0 THEN 0 ELSE e END) AS mc FROM l GROUP BY 1),
s AS (SELECT l.stream_id, least(15, floor(line_no * least(1.0::DOUBLE, 16.0::DOUBLE / total)))::INT AS r, floor(b * h)::INT AS b, least(40, greatest(floor(e * h), floor(b * h) + 1))::INT AS e
      FROM (SELECT l.*, total, least(1.0::DOUBLE, 40.0::DOUBLE / greatest(1, mc)) AS h FROM l JOIN m USING (stream_id)) l WHERE e > 0)
SELECT stream_id, r // 4 AS "row", r % 4 AS sub_row, min(b) AS beg, max(e) AS "end", 0 AS status FROM s GROUP BY 1, r
""")
def silhouette_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _doc_lines(spark, sf_dir).withColumn("x", classify.extent(F.col("raw"))).select("stream_id", "line_no", F.col("x.beg").alias("ext_beg"), F.col("x.end").alias("ext_end"), F.lit(0).alias("status"))
    return silhouette.silhouette(d, 4, 20)


_RATE = """
(SELECT user_id % 8 AS stream_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id % 8)) // 86400000000 AS bucket, CASE WHEN event_type <> 'view' THEN (value * 1000000)::BIGINT END AS lag FROM events)
"""
_PCT = "list_sort(list(lag) FILTER (WHERE lag IS NOT NULL))[(floor((count(lag) - 1) * {q}) + 1)::INT] / 1e6"


@query(f"""SELECT stream_id, bucket, count(*) AS lines, count(*) / 86400.0::DOUBLE AS rate, count(lag) AS tagged, {_PCT.format(q='0.5::DOUBLE')} AS lag_p50_ms, {_PCT.format(q='0.95::DOUBLE')} AS lag_p95_ms, {_PCT.format(q='0.99::DOUBLE')} AS lag_p99_ms, max(lag) / 1e6 AS lag_max_ms FROM {_RATE} GROUP BY 1, 2""")
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.rate_windows(_arrivals(spark, sf_dir), 86400.0)


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("stream_id"), F.expr("unix_micros(cast(ts as timestamp))").alias("arrival_us"), F.when(F.col("event_type") != "view", F.round(F.col("value") * 1000000).cast("long")).alias("lag_ns"))


@query(f"""
SELECT stream_id, sum(lines)::BIGINT AS lines, max(rate) AS peak_rate, coalesce(max(rate) FILTER (WHERE p95 <= 50), 0) AS peak_sustained_rate, max(mx) AS max_lag_ms
FROM (SELECT stream_id, count(*) AS lines, count(*) / 86400.0::DOUBLE AS rate, {_PCT.format(q='0.95::DOUBLE')} AS p95, max(lag) / 1e6 AS mx FROM {_RATE} GROUP BY stream_id, bucket) GROUP BY 1
""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.run_totals(rates.rate_windows(_arrivals(spark, sf_dir), 86400.0), keeping_up_ms=50.0)


@query(r"""
SELECT doc_id, regexp_replace('a' || chr(1) || repeat(' ', 6) || left(t, 3) || repeat(' ', (8 - length(left(t, 3)) % 8)::INT) || 'z?', '[\x00-\x08\x0B-\x1F\x7F]', '?', 'g') AS raw, 2 AS n_gaps
FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z]', 'x', 'g') AS t FROM documents)
""")
def sanitize_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.left(F.regexp_replace("text", "[^a-zA-Z]", "x"), F.lit(3))
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a\x01\t"), t, F.lit("\tz\x7f\r")).alias("text"))
    return clean.clean_lines(d).select("doc_id", "raw", F.size("tab_gaps").alias("n_gaps"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 1000 END AS lag_ns, CASE event_id % 3 WHEN 0 THEN '[LLB:x] ' || event_type ELSE event_type END AS raw FROM events")
def lag_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("case event_id % 3 when 0 then concat('[LLB:x] ', event_type) when 1 then concat('[LLB:', event_id * 1000, '] ', event_type) else concat('[LLB:', event_id * 1000, ']', event_type) end")
    return clean.clean_lines(_table(spark, sf_dir, "events").select("event_id", t.alias("text")), bench=True).select("event_id", "lag_ns", "raw")


@query("SELECT event_id, event_type || ' plain' AS raw FROM events")
def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("\x1b[1;31m"), "event_type", F.lit("\x1b[0m \x1b]8;;http://x\x07plain\x1b[K"))
    return _table(spark, sf_dir, "events").select("event_id", clean.strip_ansi(t).alias("raw"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS n_ips, len(regexp_extract_all(text, '\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s+[+-]\d{4})?(?:\s+[A-Z]{2,5})?')) AS n_datetimes FROM documents
""")
def span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda p: F.size(F.regexp_extract_all("text", F.lit(rx.java(p)), F.lit(0)))
    return _table(spark, sf_dir, "documents").select("doc_id", size(rx.IPV4).alias("n_ips"), size(rx.DATETIME).alias("n_datetimes"))


@query("""
SELECT event_id, style, n FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'level-error' WHEN 'click' THEN 'level-info' ELSE NULL END AS level FROM events),
LATERAL (SELECT unnest(['datetime', 'ip', 'plain', level]) AS style, unnest([1, 1, CASE WHEN level IS NULL THEN 2 ELSE 3 END, 1]) AS n) WHERE style IS NOT NULL
""")
def span_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import find_spans

    raw = F.expr("concat('2024/01/02 03:04:05 ', case event_type when 'error' then '[crit]' when 'click' then '[notice]' else '[odd]' end, ' from 10.0.0.', event_id % 250, ' end')")
    d = _table(spark, sf_dir, "events").select("event_id", F.explode(find_spans(raw)).alias("s"))
    return d.groupBy("event_id", "s.style").agg(F.count("*").cast("int").alias("n"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS likely FROM nation")
def k8s_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.expr("concat(case n_nationkey % 4 when 0 then 'deployment.apps' when 1 then 'thing.a.b.c' when 2 then 'thing.apps' else 'a.b.c' end, '/', n_name)")
    return _table(spark, sf_dir, "nation").select("n_nationkey", classify.is_k8s_resource(ref).alias("likely"))


@query("""
SELECT v.check_name, 2000 AS n FROM (VALUES ('level'), ('dd.trace_id'), ('dd.span_id'), ('http.method'), ('http.url'), ('http.headers'), ('error'), ('time'), ('app.tenant_name'), ('http.duration_ms')) v(check_name)
UNION ALL SELECT 'status ' || s, 1 FROM (VALUES (200), (206), (204), (404), (403), (499), (500), (503)) w(s)
""")
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines pass each check of a field; of each status, 1 if its share is within 5 standard deviations of its weight."""
    n = 2000
    d = generate.access_log(spark, n, 7)
    field = lambda name: F.get_json_object("text", f"$['{name}']")
    status = field("http.status_code").cast("int")
    looks = lambda name, pattern: F.regexp_like(field(name), F.lit(pattern))
    level = F.expr("case " + " ".join(f"when s = {s} then '{lev}'" for s, lev, _ in generate.STATUS_MIX) + " end")
    checks = {
        "level": field("level") == level, "dd.trace_id": looks("dd.trace_id", "^[0-9a-f]{16}$") | looks("dd.trace_id", "^[0-9a-f]{32}$"),
        "dd.span_id": looks("dd.span_id", "^[0-9a-f]{8}$") | looks("dd.span_id", "^[0-9a-f]{16}$"), "http.method": field("http.method").isin(*generate.METHODS),
        "http.url": looks("http.url", "^/[a-z]+/archive/%7B[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}%7D/[0-9a-f]+$"),
        "http.headers": F.get_json_object("text", "$['http.headers']['X-Tenant-Name']") == field("app.tenant_name"), "error": (status >= 400) == field("error").isNotNull(),
        "time": looks("time", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), "app.tenant_name": field("app.tenant_name").isin(*generate.TENANTS), "http.duration_ms": field("http.duration_ms").cast("long").between(0, 180_000),
    }
    d = d.withColumn("s", status)
    each = F.array(*[F.struct(F.lit(k).alias("check_name"), F.coalesce(c, F.lit(False)).cast("int").alias("ok")) for k, c in checks.items()])
    fields = d.select(F.explode(each).alias("c")).groupBy("c.check_name").agg(F.sum("c.ok").cast("int").alias("n"))
    total = sum(w for *_, w in generate.STATUS_MIX)
    share = F.expr("case " + " ".join(f"when s = {s} then {w / total}D" for s, _, w in generate.STATUS_MIX) + " end")
    near = F.abs(F.count("*") - n * F.max("p")) <= 5 * F.sqrt(n * F.max("p") * (1 - F.max("p")))
    mix = d.withColumn("p", share).groupBy("s").agg(near.cast("int").alias("n"))
    return fields.unionByName(mix.select(F.concat(F.lit("status "), F.col("s").cast("string")).alias("check_name"), "n"))


@query("SELECT i AS tick, i * 0.001::DOUBLE AS t, i AS due FROM range(0, 1000) r(i)")
def load_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.schedule(spark, generate.stepped([1000.0], 10.0), 1.0)


@query("SELECT event_type AS label, count(*) AS cnt FROM events GROUP BY 1")
def stream_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statistic over the events as a stream of files, run to its end."""
    from ..streaming.live import live_freq, run_available

    base = shared_path(spark)
    _event_lines(spark, sf_dir).select("json").write.parquet(f"{base}/in")
    d = spark.readStream.schema("json string").parquet(f"{base}/in").select(freq.fast_label(F.col("json"), ["type"]).alias("label"))
    run_available(live_freq(d, F.lit(-1)), f"{base}/out", f"{base}/check", "complete")
    return spark.read.parquet(f"{base}/out").select("label", "cnt")


from . import line_queries, value_queries  # noqa: E402, F401  (add their own)
