import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import clean
from logloom.operators import freq, rates, search, sequence, templates
from logloom.plans.sql import register
from logloom.sources import generate
from logloom.sources.lines import lines_from_df, parse_size, read_text


def lines(spark, texts, stream="s"):
    return spark.createDataFrame([(stream, i, t) for i, t in enumerate(texts)], "stream_id string, line_no long, text string")


SAMPLE = ["plain"] * 3 + ['{"a": 1}', "--- a", "+++ b", "@@ -1 @@", "+x", "done", "A  B  C", "1  2  3", "4  5  6", "end", "{", '  "k": [', "  1", "  ]", "}", "frame=1", "progress=end", "ok"] + ["text line"] * 450


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_numbering_in_two_levels(spark, ranges):
    r = random.Random(3)
    rows = [(r.choice([None, float("nan"), *range(40)]), i, f"t{i}\nu{i}") for i in range(500)]
    d = spark.createDataFrame([(None if a is None else float(a), b, c) for a, b, c in rows], "a double, b long, c string").repartition(5)
    got = [(x.line_no, x.text) for x in lines_from_df(d, "c", ["a", "b"], split=True, ranges=ranges).orderBy("line_no").collect()]
    key = lambda x: (0 if x[0] is None else 2 if x[0] != x[0] else 1, x[0] if x[0] is not None and x[0] == x[0] else 0, x[1])
    assert got == list(enumerate(t for x in sorted(rows, key=key) for t in x[2].split("\n")))


def test_clean(spark):
    d = lines(spark, ["a\tb", "\x1b[31mred\x1b[0m\x07", "x\r", "[LLB:5] y", "[LLB:z] y"])
    assert [r.raw for r in clean.clean_lines(d, bench=True).orderBy("line_no").collect()] == ["a       b", "red?", "x", "y", "[LLB:z] y"]


def test_rules(spark):
    d = spark.createDataFrame([(x,) for x in ["GetObject", "UploadPart", "PutObject", "HeadObject", "PutObjectRetention", None]], "label string")
    out = [(r.label, r.is_rule, r.cnt) for r in freq.freq(d, [freq.Rule("PutObject|UploadPart", "Upload"), freq.Rule("x", "none")]).collect()]
    assert out == [("Upload", True, 2), ("GetObject", False, 1), ("HeadObject", False, 1), ("PutObjectRetention", False, 1), ("none", True, 0)]
    with pytest.raises(ValueError, match="bad"):
        freq.Stat(["a"], [freq.Rule("(", "bad")])
    with pytest.raises(ValueError):
        freq.Stat(["a"], last_n=-1)
    m = freq.Manager()
    s = freq.Stat(["a", "b"])
    assert m.add(s) == 1 and s.name == "b"


def test_labels(spark):
    d = spark.createDataFrame([('{"a":{"b":42}}',), ('{"a":{"b":null}}',), ('{"a":{}}',), ('{"a":{"b":[2,{"z":1,"y":"<"}]}}',), ("x",)], "json string")
    assert [r[0] for r in d.select(freq.exact_label(F.col("json"), ["a", "b"])).collect()] == ["42", "null", None, '[2,{"y":"\\u003c","z":1}]', None]


def test_templates(spark):
    texts = ["2024-01-02 03:04:05.5 GET /a/b 10.0.0.1 id=123456", "2024-01-03 03:04:05.5 GET /a/c 10.0.0.2 id=987654", "x 1234 5678 y", "x 9999 8888 y"]
    d = lines(spark, texts).select(F.lit(0).alias("window_id"), "line_no", F.col("text").alias("raw"))
    out = {r.skeleton: (r.template, r.n) for r in templates.templates(d).collect()}
    assert out["x * * y"] == ("x * y", 2) and len(out) == 2
    sel = templates.templates(d).where("template = 'x * y'")
    assert [r.line_no for r in templates.lines_of(d, sel).orderBy("line_no").collect()] == [2, 3]


def test_merge():
    assert templates.merged_skeleton("a b c d", "a x c d") == "a * c d"
    assert templates.merged_skeleton("a b", "") == "*"
    many = [(f"job {i} finished with code zero on host", [i]) for i in range(50)]
    out = templates.merge(many, 50)
    assert len(out) <= 10 and sorted(x for _, m in out for x in m) == list(range(50))
    apart = [(" ".join(f"{c}{k}" for k in range(6)), [c]) for c in "abcdefghi"]
    assert templates.merge(apart, 9) == apart


def test_mixed_runs(spark):
    words = ["abcdefghijklmnopqrst", "abcdefghijk1mnopqrst", "ABCDEFGHIJKLMNOPQRST", "abcdefghijklMnopqrst", "x/abcdefghijklmnopqrst", "éabcdefghijklmnopqrst=1", "deadbeefdeadbeef", '"/p"', "/p/q", "12345", "1.5"]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in d.select(templates.masked(F.array("w"))[0]).collect()]
    assert got == ["abcdefghijklmnopqrst", "*", "ABCDEFGHIJKLMNOPQRST", "*", "*", "é*", "*", "*", "*", "*", "*"]


def test_search_and_paging(spark):
    d = lines(spark, ["Aa", "b", "xa", "c"]).withColumnRenamed("text", "raw")
    one = lambda x: x.first()[0]
    assert [one(search.search_next(d, "A", s)) for s in (0, 1, 3)] == [0, 2, 0] and [one(search.search_prev(d, "a", s)) for s in (1, 0, 3)] == [0, 0, 2]
    assert one(search.search_next(d, "zz", 0)) == -1
    rows = [1, 1, 0, 1, 2, 0, 3, 1]
    p = search.with_prefix(spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "stream_id string, line_no long, rows long"), span=3)
    assert [r.upto for r in p.orderBy("line_no").collect()] == [1, 2, 2, 3, 5, 5, 8, 9]
    assert [search.find_row(p, t).first().line_no for t in range(10)] == [0, 1, 3, 4, 4, 6, 6, 6, 7, 8]


def test_rates(spark):
    d = spark.createDataFrame([("s", i * 100_000, lag) for i, lag in enumerate([1_000_000, 2_000_000, 3_000_000, 4_000_000, None, None, None, None, None, None, None])], "stream_id string, arrival_us long, lag_ns long")
    out = rates.rate_windows(d).orderBy("bucket").collect()
    assert [(r.bucket, r.lines, r.tagged, r.lag_p95_ms) for r in out] == [(0, 10, 4, 3.0), (1, 1, 0, None)]
    assert rates.as_text(rates.rate_windows(d)).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rx\n\nlast")
    assert [(r.line_no, r.text) for r in read_text(spark, str(tmp_path / "a.txt"), "a").orderBy("line_no").collect()] == [(0, "one"), (1, "two\rx"), (2, ""), (3, "last")]
    d = lines_from_df(spark.createDataFrame([(1, "b\nc"), (0, "a")], "o int, t string"), "t", ["o"], split=True)
    assert [r.text for r in d.orderBy("line_no").collect()] == ["a", "b", "c"]
    assert parse_size("2G") == 2 << 30 and parse_size("512M") == 512 << 20
    for bad in ("", "0", "-1", "x"):
        with pytest.raises(ValueError):
            parse_size(bad)


def test_generator(spark):
    d = generate.access_log(spark, 3000, 5)
    shares = {r[0]: r[1] / 3000 for r in d.groupBy(F.get_json_object("text", "$.level")).count().collect()}
    assert abs(shares["info"] - 0.75) < 0.05 and abs(shares["error"] - 0.06) < 0.03
    assert d.exceptAll(generate.access_log(spark, 3000, 5)).count() == 0
    assert [r.text for r in generate.from_template(spark, ["a", "b"], 3).orderBy("line_no").collect()] == ["a", "b", "a"]


def test_sql(spark):
    register(spark, sequence.structure(lines(spark, ['{"a": {"b": [1, "x"]}}', "t 1234"])))
    assert [r.shown for r in spark.sql("SELECT shown FROM json_nodes ORDER BY ord").collect()] == ['"a": {"b":[1,"x"]}', '"b": [1,"x"]', "[0]: 1", '[1]: "x"']
    assert spark.sql("SELECT json_label('{\"a\":1.50}', array('a'))").first()[0] == "1.5"


def test_table_text(spark):
    out = sequence.aligned_text(sequence.structure(lines(spark, ["a\tbbb\t\tc", "aaaa\tb\t\tcc"]))).orderBy("line_no").collect()
    assert len(out) == 2 and len({r.text.index("│") for r in out}) == 1


def test_json_views():
    from logloom.functions import jsonview as v

    text = ' {"b" : [1, {"c":"}"}], "level":"ERR", "a\\"q": {"x":1.50}, "level": "info"} '
    assert [(k, text[a:b]) for k, a, b in v.slices(text)] == [("b", '[1, {"c":"}"}]'), ("level", '"ERR"'), ('a"q', '{"x":1.50}'), ("level", '"info"')]
    assert v.slices("[1, [2], ]") and v.slices("x") == [] and v.slices('{"a" 1}') == []
    lo, hi = v.level_range(text)
    assert text[lo:hi] == '"ERR"' and v.level_range('{"level":3}') is None and v.level_range('{"l\\u0065vel":"x"}') is None
    assert v.compact('{"z":1,"a":[true,null,"é"],"n":{}}', 80) == '{"z": 1, "a": [true, null, "é"], "n": {}}'
    assert v.compact('{"z":1,"a":2}', 8) == '{"z":...' and v.compact('{"z":1}', 2) == '{"' and v.compact("[1]", 0) == "" and v.compact("{", 9) is None
    assert v.compact('["日本語"]', 8) == '["日...' and v.compact('["日本語"]', 10) == '["日本語"]'
    from logloom.functions.jsonx import parse

    value = parse('{"a":{"b":[1,{"c":2}]},"d\\"e":3}')
    assert v.field_path(value, [0, 0]) == ["a", "b"] and v.field_path(value, [0, 0, 0]) is None and v.field_path(value, [1]) == ["d\\"] and v.field_path(value, [5]) is None
    order, at = [], []
    while (at := v.next_visible(value, at)) is not None:
        order.append(at)
    assert order == [[0], [0, 0], [0, 0, 0], [0, 0, 1], [0, 0, 1, 0], [1]]
    assert [v.prev_visible(value, x) for x in order] == [None, *order[:-1]] and v.last_visible(value) == [1]
    assert v.next_visible(value, [0], {()}) == [1] and v.prev_visible(value, [1], {(), (0,)}) == [0, 0] and v.last_visible(value, set()) is None
    assert v.next_expandable(value, [0]) == [0, 0] and v.next_expandable(value, [0, 0, 1]) is None


def test_json_segments(spark):
    from logloom.functions import columns

    raw = 'at 10.0.0.1 got {"level":"warn","k":[1]} and {"k":"v"} end'
    d = spark.createDataFrame([(raw,), ("none",), (None,)], "raw string").select(columns.json_segments("raw").alias("s"))
    got = [None if r.s is None else [(x.text, x.style) for x in r.s] for r in d.collect()]
    assert got[0] == [("at ", "plain"), ("10.0.0.1", "ip"), (" got ", "plain"), ('{"level":', "json"), ('"warn"', "level-warn"), (',"k":[1]}', "json"), (" and ", "plain"), ('{"k":"v"}', "json"), (" end", "plain")]
    assert got[1:] == [[], None]


def test_pipe_and_command(spark, tmp_path):
    import io
    import sys

    from logloom.plans import config
    from logloom.sources import process

    d = process.read_pipe(spark, io.BytesIO(b"a\r\nb\n\nc"), str(tmp_path / "p"))
    assert [(r.line_no, r.text) for r in d.orderBy("line_no").collect()] == [(0, "a"), (1, "b"), (2, ""), (3, "c")]
    assert list(process.split_lines([b"a\n" + b"x" * 10, b"y\nb\n"], 8)) == ["a"] and process.read_pipe(spark, io.BytesIO(b""), str(tmp_path / "e")).count() == 0
    code = "import sys; print('out'); print('err', file=sys.stderr); sys.exit(3)"
    d, exit_code = process.run_command(spark, [sys.executable, "-c", code], str(tmp_path / "c"))
    assert exit_code == 3 and sorted((r.text, r.source) for r in d.collect()) == [("err", "stderr"), ("out", "stdout")]
    c = process.Command([sys.executable, "-c", "import signal,time; signal.signal(signal.SIGTERM, signal.SIG_IGN); print('up', flush=True); time.sleep(60)"])
    assert next(c.lines()) == ("up", "stdout") and c.exit_code == -1
    c.stop(0.2)
    assert c.process.wait(10) == -9 and c.exit_code == -1
    o = config.parse(["--no-follow", "-x", "--max-disk", "2K", "--bench", str(tmp_path / "m"), "--odd", "--", "ls", "-l"])
    assert (o.follow, o.exit_on_eof, o.max_disk, o.command, o.unknown, o.mode) == (False, True, 2048, ["ls", "-l"], ["--odd"], "command")
    assert config.parse(["-v"]).mode == "version" and config.parse([]).mode == "pipe" and config.parse(["-h"]).mode == "help"
    for bad in (["--bench"], ["--max-disk", "x"]):
        with pytest.raises(ValueError):
            config.parse(bad)
    typed, code = config.run(spark, config.Options(bench=str(tmp_path / "m")), str(tmp_path / "r"), io.BytesIO(b'[LLB:5] {"a":1}\nplain\n'))
    assert code == -1 and [r.line_type for r in typed.orderBy("line_no").collect()] == ["json", "plain"]
    assert spark.read.text(str(tmp_path / "m")).first()[0].startswith("rate_window t=0.000 lines=2")


def test_statistics_over_a_cutoff(spark):
    d = spark.createDataFrame([(i, "json", f'{{"k":"{i % 3}"}}', 0) for i in range(30)], "line_no long, line_type string, json string, group_id long")
    s = freq.Stat(["k"], [freq.Rule("2", "two"), freq.Rule("9", "nine")], last_n=9)
    counts = lambda d: {(r.label, r.is_rule): r.cnt for r in d.collect()}
    back, both = freq.statistic(d, s, 15), freq.statistic(d, s, 15, live=True)
    assert counts(back) == {("two", True): 3, ("nine", True): 0, ("0", False): 3, ("1", False): 3}
    on = freq.statistic(d.where("line_no >= 15"), s)
    assert counts(freq.merged(back, on)) == counts(both) and freq.totals(both).first().total == 24
    many = freq.several(d.select("json"), {1: (freq.fast_label(F.col("json"), ["k"]), s.rules), 2: (freq.fast_label(F.col("json"), ["z"]), [freq.Rule("a")])})
    assert {(r.stat_id, r.label, r.is_rule): r.cnt for r in many.collect()} == {(1, "two", True): 10, (1, "nine", True): 0, (1, "0", False): 10, (1, "1", False): 10, (2, "a", True): 0}


def test_cut_texts_and_sizes(spark):
    from logloom.operators import classify

    d = spark.createDataFrame([("abcdef",), ("éé",), ("abc",), (None,)], "t string")
    f = lambda w: [r[0] for r in d.select(classify.truncated(F.col("t"), w)).collect()]
    assert f(4) == ["abc…", "éé", "abc", None] and f(3) == ["abc", "é", "abc", None] and f(0)[:3] == ["", "", ""] and f(6)[0] == "abcdef"
    sizes = spark.createDataFrame([(5,), (1536,), (3 << 20,), (3 << 29,)], "n long")
    assert [r[0] for r in sizes.select(classify.short_bytes(F.col("n"))).collect()] == ["5B", "1KB", "3MB", "1.5GB"]


def test_dates(spark):
    from logloom.functions import dates

    d = lines(spark, ["x 2024-01-02 03:04:05.5 y", "none", "2024/01/02 03:04:07 z", "2024-13-01 00:00:00"]).withColumnRenamed("text", "raw")
    assert [r.seconds for r in dates.since_line_before(d).orderBy("line_no").collect()] == [None, None, 1.5, None]


def test_separated_tables(spark):
    d = sequence.structure(lines(spark, ["NAME    READY   STATUS", "a  b    1/1     Running", "long    0/1     Down"]))
    out = [r.text for r in sequence.separated_text(d).orderBy("line_no").collect()]
    assert out == ["NAME   │READY  │STATUS", "a  b   │1/1    │Running", "long   │0/1    │Down"]


def test_merge_by_heap_is_merge_by_table():
    """Against all pairs compared anew at each step."""
    import math
    from collections import Counter

    def plain(clusters, n):
        target, items = max(2, math.ceil(math.sqrt(n))), list(clusters)
        while len(clusters) > target and len(items) > 1:
            sims = [(-templates.alike(Counter(a[0].split()), Counter(b[0].split())), i, i + 1 + j) for i, a in enumerate(items) for j, b in enumerate(items[i + 1 :])]
            sim, i, j = min(sims)
            if -sim <= (templates.STRICT if len(items) <= target else templates.LOOSE):
                break
            items[i] = (templates.merged_skeleton(items[i][0], items[j][0]), sorted(items[i][1] + items[j][1]))
            del items[j]
        return items

    r = random.Random(2)
    for _ in range(60):
        made = list(dict.fromkeys(" ".join(r.choice("abcdef*") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(2, 30))))
        clusters = [(s, [i]) for i, s in enumerate(made)]
        assert templates.merge(clusters, len(made)) == plain(clusters, len(made))


def test_sql_functions_are_expressions(spark):
    """log_clean and log_mask mean what the DataFrame functions do, and put no Python into a plan."""
    from logloom.functions.clean import clean_lines
    from logloom.plans.sql import register

    register(spark)
    r = random.Random(11)
    parts = ["a\tb", "\x1b[31mred\x1b[0m", "\x01", "é", "it's \"q\"", "\\x", "2024-01-02T03:04:05Z", "10.0.0.1:80", "/var/log/x", "abcdefghijk1mnopqrst", "(/p)", "99999", "k=1.5", "{a,b}", "%7Bab-1%7D", "W0425", "\r", "$1"]
    texts = ["", None, *("".join(r.choice(parts) + r.choice(["", " ", "\t"]) for _ in range(r.randrange(9))) for _ in range(300))]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = d.selectExpr("i", "log_clean(text) AS c", "log_mask(log_clean(text)) AS m")
    want = clean_lines(d).select("i", "raw", templates.skeleton(F.col("raw")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_large_windows_are_merged_in_rounds(spark):
    """No pair that is alike enough is left, every line counts once, and clear cases give what one task gives."""
    import math
    from collections import Counter

    r = random.Random(12)
    kinds = ["job {} finished with code zero on host", "user {} logged in from {} at last", "a {} b {} c d e f g", "only {} x"]
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(4))
    texts = [r.choice(kinds).format(word(), word()) for _ in range(70)] + ["", "same line"] * 5
    d = spark.createDataFrame([(w, i, t) for w in ("x", "y") for i, t in enumerate(texts if w == "x" else texts[:20])], "window_id string, line_no long, raw string")
    got = templates.templates(d, most_in_task=30).collect()
    one = templates.templates(d).collect()
    assert sorted((x.template, x.n) for x in got if x.window_id == "y") == sorted((x.template, x.n) for x in one if x.window_id == "y")
    mine = [x for x in got if x.window_id == "x"]
    assert sum(x.n for x in mine) == len(texts) and sorted(s for x in mine for s in x.skeletons) == sorted({" ".join(t.split()) for t in texts})
    assert {x.template for x in mine} == {x.template for x in one if x.window_id == "x"}
    target = max(2, math.ceil(math.sqrt(len(texts))))
    limit = templates.STRICT if len(mine) <= target else templates.LOOSE
    bags = [Counter(x.skeleton.split()) for x in mine]
    assert all(templates.alike(a, b) <= limit for i, a in enumerate(bags) for b in bags[:i])
