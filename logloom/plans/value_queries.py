"""Queries over values: labels of every JSON type, places of tabs, cut texts of wide characters, ranks, peaks, defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import classify, freq, search, templates
from ..sources.lines import spread
from .queries import _LOG_LINE, _duck_mask, _event_lines, _table, query


@query(r"""
WITH l AS (
    SELECT CASE o_orderkey % 7 WHEN 0 THEN regexp_replace(o_totalprice::VARCHAR, '\.0$', '') WHEN 1 THEN o_custkey::VARCHAR WHEN 2 THEN 'null'
                WHEN 3 THEN (o_custkey % 2 = 0)::VARCHAR WHEN 4 THEN '{"a":"\u003c' || o_orderstatus || '\u003e","b":[' || o_custkey || ',null]}'
                WHEN 5 THEN o_orderpriority END AS label
    FROM orders)
SELECT label, false AS is_rule, -1 AS rule_idx, count(*) AS cnt FROM l WHERE label IS NOT NULL GROUP BY label
""")
def label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floats, whole floats, nulls, booleans, structures (keys sorted, < and > escaped) and texts; a missing value isn't counted."""
    value = """case o_orderkey % 7 when 0 then concat('"v":', cast(o_totalprice as decimal(18, 2))) when 1 then concat('"v":', o_custkey, '.0')
        when 2 then '"v":null' when 3 then concat('"v":', cast(o_custkey % 2 = 0 as string))
        when 4 then concat('"v": {"b": [', o_custkey, ', null], "a": "<', o_orderstatus, '>"}') when 5 then concat('"v":"', o_orderpriority, '"') else '"w":1' end"""
    d = _table(spark, sf_dir, "orders").select(F.concat(F.lit("{"), F.expr(value), F.lit("}")).alias("json"))
    return freq.freq(d.select(freq.exact_label(F.col("json"), ["v"]).alias("label")), order=False)


@query("""
WITH a AS (SELECT event_id, length(event_type) AS s0, length(user_id::VARCHAR) AS n1, user_id % 11 AS n2 FROM events),
     b AS (SELECT *, (s0 // 8 + 1) * 8 AS e0, (s0 // 8 + 1) * 8 + n1 AS s1 FROM a), c AS (SELECT *, (s1 // 8 + 1) * 8 AS e1, (s1 // 8 + 1) * 8 + n2 AS s2 FROM b)
SELECT event_id, concat_ws(' ', s0 || '-' || e0, s1 || '-' || e1, s2 || '-' || (s2 // 8 + 1) * 8) AS gaps, ((s2 // 8 + 1) * 8 + 1)::INT AS width FROM c
""")
def tab_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tabs of a line were, in characters, with wide characters between them."""
    t = F.expr("concat(event_type, '\\t', user_id, '\\t', repeat('é', cast(user_id % 11 as int)), '\\tz')")
    d = clean.clean_lines(_table(spark, sf_dir, "events").select("event_id", t.alias("text")))
    gaps = F.transform("tab_gaps", lambda g: F.concat_ws("-", g["start"].cast("string"), g["end"].cast("string")))
    return d.select("event_id", F.concat_ws(" ", gaps).alias("gaps"), F.length("raw").alias("width"))


@query("""
SELECT event_id, CASE WHEN a + 2 * n <= 12 THEN t ELSE left(t, (a + (11 - a) // 2)::INT) || '…' END AS cut
FROM (SELECT event_id, length(event_type) AS a, user_id % 9 AS n, event_type || repeat('é', user_id % 9) AS t FROM events)
""")
def cut_wide_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut at a number of bytes, within characters of two bytes, too."""
    t = F.expr("concat(event_type, repeat('é', cast(user_id % 9 as int)))")
    return _table(spark, sf_dir, "events").select("event_id", classify.truncated(t, 12).alias("cut"))


@query("""
SELECT count(l_extendedprice) AS n, quantile_disc(l_quantity, 0.99)::DOUBLE AS p99_quantity, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, true AS p99_near FROM lineitem
""")
def numeric_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentile of few distinct values is exact; that of many is within the sketch's rank error, here three times it and one row at most."""
    d = _table(spark, sf_dir, "lineitem")
    quantity = freq.numeric(d.select(F.col("l_quantity").cast("string").alias("label"))).select(F.col("p99").alias("p99_quantity"))
    price = freq.numeric(d.select(F.col("l_extendedprice").cast("string").alias("label")))
    at = price.select(F.col("p99").alias("_p"), F.col("min").alias("min_price"), F.col("max").alias("max_price"))
    ranks = d.select("l_extendedprice").crossJoin(F.broadcast(at)).groupBy("min_price", "max_price").agg(
        F.count("l_extendedprice").alias("n"), F.count_if(F.col("l_extendedprice") <= F.col("_p")).alias("_upto"))
    near = F.abs(F.col("_upto") - F.col("n") * 0.99) <= 3 * F.col("n") / freq.ACCURACY + 1
    return ranks.crossJoin(F.broadcast(quantity)).select("n", "p99_quantity", "min_price", "max_price", near.alias("p99_near"))


@query("SELECT event_type AS stream_id, event_id AS line_no, max(value) OVER (PARTITION BY event_type ORDER BY event_id) AS peak FROM events")
def running_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "events").select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("line_no"), "value")
    return search.with_peak(d, "value").select("stream_id", "line_no", "peak")


@query(f"""
WITH lines AS (SELECT event_type AS stream_id, event_id AS line_no, {_LOG_LINE} AS raw FROM events), s AS ({_duck_mask()}),
     g AS (SELECT stream_id AS window_id, skeleton, count(*) AS n, min(line_no) AS first_line FROM s GROUP BY 1, 2)
SELECT window_id, skeleton, row_number() OVER (PARTITION BY window_id ORDER BY n DESC, first_line) AS place FROM g
""")
def template_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each skeleton in its window: those of most lines first, then as they appeared."""
    d = spread(_table(spark, sf_dir, "events").select(F.col("event_type").alias("window_id"), F.col("event_id").alias("line_no"), F.expr(_LOG_LINE).alias("raw")))
    return templates.placed(templates.skeletons(d)).select("window_id", "skeleton", "place")


@query("""
WITH l AS (SELECT event_type AS label, user_id::VARCHAR AS user, event_id FROM events WHERE event_id >= 500 AND event_id < 20500)
SELECT 1 AS stat_id, 'type' AS stat, CASE WHEN label IN ('click', 'view') THEN 'click|view' ELSE label END AS label, label IN ('click', 'view') AS is_rule, count(*) AS cnt FROM l GROUP BY 3, 4
UNION ALL SELECT 2, 'users', user, false, count(*) FROM l GROUP BY 3
UNION ALL SELECT 3, 'stat-3', CASE WHEN label = 'error' THEN 'errors' ELSE 'others' END, true, count(*) FROM l GROUP BY 3
""")
def stat_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from 1; names by the path's last key, as given, or by the id; empty rules go; 20 000 lines before the cutoff."""
    lines = _event_lines(spark, sf_dir).withColumn("line_type", F.lit("json")).withColumn("group_id", F.lit(0))
    m = freq.Manager()
    m.add(freq.Stat(["type"], [freq.Rule(""), freq.Rule("click|view")]))
    m.add(freq.Stat(["user"], name="users"))
    m.add(freq.Stat([], [freq.Rule(r'\{"type":"error",.*', "errors"), freq.Rule(".*", "others")]))
    each = [freq.statistic(lines, s, 20_500, exact=False).select(F.lit(i).alias("stat_id"), F.lit(s.name).alias("stat"), "label", "is_rule", "cnt") for i, s in m.stats.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])
