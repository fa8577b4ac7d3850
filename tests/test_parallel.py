"""The fold in many tasks and over streams, against one pass over the whole stream."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_fold import tabbed

from logloom.operators import sequence
from logloom.operators.fold import Live, Machine, Row, diff_after, diff_map, fold, joined, key_value, segment
from logloom.plans import line_queries
from logloom.streaming import live

WORDS = [
    "{", "}", "[", "]", '{"k": 1}', "text", "A  B  C", "D  E  F", "a\tb\tc\td", "e\tf\tg", "+x", " x", "  y", "--- a", "+++ b", "@@ -1 @@", "  @@ -1 @@", "  --- q", "frame=1", "progress=end", "progress=continue",
    "out_time_ms=7", "out_time_us=0", "", "PASS", "=== RUN   T", "a } b {", '"k": [', "[[", "1", "ERROR: x", "bitrate=}",
]
SESSION = ["frame={}", "speed=1x", "progress=continue", "fps=2", "out_time_ms=5", "out_time_us=0", "out_time_ms=0", "bitrate= }}", "progress=end"]


def shapes(n=1500):
    r = random.Random(5)
    made = {
        "two blanks": [f"12:{i % 60:02d}  INFO  m{i}" for i in range(n)],
        "tabs": [f"a{i}\tb\tc{i % 7}" for i in range(n)],
        "tables": [("x\t" if i % 450 == 5 else "") + f"a{i}\tb\tc{i % 7}" for i in range(n)],
        "indented": [f"    at frame {i}" for i in range(n)],
        "bullets": [f"- item {i}" for i in range(n)],
        "open braces": [f"x {{ {i}" for i in range(n)],
        "one session": [x for i in range(n // 2) for x in (f"frame={i}", "speed=1x")],
        "blocks": [x for i in range(n // 3) for x in (f"frame={i}", "speed=1x", "progress=continue")],
        "sessions": [x.format(i) for i in range(n // 6) for x in SESSION],
        "diff": ["--- a", "+++ b", "@@ -1 @@"] + [r.choice([" c", "+a", "-r"]) + str(i) for i in range(n)] + ["end"] * 500,
        "indented diff": ["  --- a", "  +++ b", "  @@ -1 @@"] + [r.choice(["   c", "  +a", "  -r"]) + str(i) for i in range(n)] + ["end"] * 500,
        "tests in a diff": ["--- a", "+++ b", "@@ -1 @@"] + ["=== RUN   T"] * n + [" c"] * n,
        "JSON lines": [f'{{"a":{i},"b":[{{"c":"x=1"}}]}}' for i in range(n)],
        "nested JSON": [x for i in range(n // 6) for x in ("saved {", '  "a": {', f'    "id": {i}', "  }", "}", "ok")],
        "long JSON": [x for _ in range(12) for x in (["{"] + [f'"k{j}": {j},' for j in range(150)] + ['"z": 1', "}"])],
        "empty": [""] * n,
    }
    for k in range(3):
        made[f"mixed {k}"] = [r.choice(WORDS) for _ in range(n)]
        few = r.sample(WORDS, 4)
        made[f"few {k}"] = [r.choice(few) for _ in range(n)]
        made[f"rare {k}"] = [r.choice(few) if r.random() < 0.02 else "A  B  C" for _ in range(n)]
    return made


def view(x):
    """All columns of a Row, or of a row of LINES."""
    out = {c: getattr(x, c) for c in sequence.LINES.names if c != "stream_id"}
    out["tab_gaps"] = [tuple(g) for g in out["tab_gaps"]]
    if out["progress"] is not None and not isinstance(out["progress"], dict):
        out["progress"] = out["progress"].asDict()
    return out


def frame(spark, made):
    return spark.createDataFrame([(k, i, t) for k, v in made.items() for i, t in enumerate(v)], "stream_id string, line_no long, text string")


@pytest.mark.parametrize("chunk", [400, 700])
def test_any_shape_is_many_tasks(spark, chunk):
    made = shapes()
    got = {}
    for x in sequence.structure(frame(spark, made).repartition(7), chunk=chunk).collect():
        got.setdefault(x.stream_id, []).append(x)
    for k, texts in made.items():
        assert [view(x) for x in sorted(got[k], key=lambda x: x.line_no)] == [view(x) for x in fold([(i, *tabbed(t)) for i, t in enumerate(texts)])], k


def test_chunks_of_a_long_stream(spark):
    """Streams that no line cuts are dealt out, and their tasks are as long as a chunk."""
    made = {k: v for k, v in shapes(4000).items() if k in ("two blanks", "tabs", "indented", "bullets", "open braces", "diff")}
    rows = sequence.stream_rows(sequence.clean_lines(frame(spark, made)).withColumn("gaps", F.lit(None).cast("string")).withColumn("source", F.lit("x")), chunk=1000)
    assert {r["n"] for r in rows.groupBy("stream_id").agg(F.max(F.expr("row_no div 1000")).alias("n")).collect()} == {3, 4}


def test_without_progress_and_with_some_columns(spark):
    made = {"s": shapes(900)["sessions"] + shapes(900)["tables"]}
    want = fold([(i, *tabbed(t)) for i, t in enumerate(made["s"])], progress=False)
    got = sequence.structure(frame(spark, made), detect_progress=False, chunk=400, columns=["line_no", "line_type", "group_id"]).orderBy("line_no").collect()
    assert [tuple(x) for x in got] == [(x.line_no, x.line_type, x.group_id) for x in want]
    got = sequence.structure(frame(spark, made), detect_progress=False, chunk=400, columns=["line_no", "status"]).orderBy("line_no").collect()
    assert [tuple(x) for x in got] == [(x.line_no, x.status) for x in want]


def test_sources_stay(spark):
    texts = ["text", "frame=1", "progress=end", "frame=2"] + ["x"] * 500 + ["frame=3"] * 600 + ["A  B  C", "D  E  F"]
    d = spark.createDataFrame([("s", i, t, "stderr" if i % 3 == 1 else None if i % 3 else "stdout") for i, t in enumerate(texts)], "stream_id string, line_no long, text string, source string")
    got = sequence.structure(d, chunk=400).collect()
    assert {(x.source, x.from_stderr) for x in got} == {("stderr", True), (None, False), ("stdout", False)} and all((x.source == "stderr") == (x.line_no % 3 == 1) for x in got)


def test_no_lines(spark):
    assert sequence.structure(spark.createDataFrame([], "stream_id string, line_no long, text string")).collect() == []


def test_diff_maps_compose():
    r = random.Random(9)
    words = ["--- a", "  --- a", "+++ b", "@@ -1 @@", "  @@ -1 @@", " @@ x", "+x", "-x", " x", "  +x", "   x", "\t+x", "text", "", "  ", "PASS", "=== RUN   T"]
    for _ in range(800):
        raws = [r.choice(words) for _ in range(r.randrange(0, 24))]
        a, b = sorted((r.randrange(len(raws) + 1), r.randrange(len(raws) + 1)))
        m = Machine()
        for x in raws:
            m.feed(Row(0, x), [], False)
        state = "idle"
        for part in (raws[:a], raws[a:b], raws[b:]):
            state = diff_after(state, diff_map(part))
        assert state == m.diff.snapshot(), raws


def test_parts_of_sessions_join():
    r = random.Random(7)
    pool = ["frame=3", "frame=x", "fps=2", "out_time_ms=7", "out_time_ms=0", "out_time_ms=q", "out_time_us=0", "out_time_us=9", "out_time=1:2", "total_size=5", "progress=continue", "speed= 2x"]
    for _ in range(500):
        texts = [r.choice(pool) for _ in range(r.randrange(1, 30))] + r.choice([[], ["progress=end"]])
        pairs = [key_value(t) for t in texts]
        cuts = sorted({0, len(pairs), *(r.randrange(1, len(pairs) + 1) for _ in range(3))})
        row = joined(Row(0, ""), [segment(pairs[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]).show()
        assert view(row) == view(fold([(i, t, []) for i, t in enumerate(texts)])[0]), texts


def test_live_reads_each_line_once():
    r, most = random.Random(2), 0
    for _ in range(300):
        words = r.sample(WORDS, r.choice([2, 3, 5, 10, len(WORDS)]))
        lines = [(i, *tabbed(r.choice(words))) for i in range(r.choice([10, 60, 400]))]
        one, got = Live(), []
        for line in lines:
            one.feed(*line)
            got += one.settled()
            most = max(most, len(one.machine.rows))
            if r.random() < 0.2:
                one = Live(*one.state())
        assert [view(x) for x in got + one.finish()] == [view(x) for x in fold(lines)], words
    assert 150 < most < 200


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_stream_equals_batch_for_all_types(spark, tmp_path):
    made = {k: v[:700] for k, v in shapes(700).items() if k in ("two blanks", "tables", "sessions", "diff", "nested JSON", "mixed 0", "mixed 1", "few 1")}
    made["tests"] = ["=== RUN   T", "--- PASS: T (0.1s)", "ERROR: x", "WARN: y", "plain"] * 40
    src = f"{tmp_path}/in"
    for part in range(4):  # files in order, each with a quarter of every stream
        cut = {k: v[len(v) * part // 4 : len(v) * (part + 1) // 4] for k, v in made.items()}
        rows = [(k, len(made[k]) * part // 4 + i, t) for k, v in cut.items() for i, t in enumerate(v)]
        spark.createDataFrame(rows, "stream_id string, line_no long, text string").coalesce(1).write.mode("append").parquet(src)
    d = spark.readStream.schema("stream_id string, line_no long, text string").option("maxFilesPerTrigger", 1).parquet(src)
    run(live.write_revisions(live.structure_stream(d, provisional=True), f"{tmp_path}/out", f"{tmp_path}/check"))
    got = {}
    for x in live.current_lines(spark, f"{tmp_path}/out").collect():
        got.setdefault(x.stream_id, []).append(x)
    for k, texts in made.items():
        assert [view(x) for x in sorted(got[k], key=lambda x: x.line_no)] == [view(x) for x in fold([(i, *tabbed(t)) for i, t in enumerate(texts)])], k
    # a batch that runs again replaces what it wrote
    n = spark.read.parquet(f"{tmp_path}/out").count()
    again = spark.read.parquet(f"{tmp_path}/out/batch=2")
    rows = again.collect()
    spark.createDataFrame(rows, again.schema).write.mode("overwrite").parquet(f"{tmp_path}/out/batch=2")
    assert spark.read.parquet(f"{tmp_path}/out").count() == n


def test_stream_hands_on_settled_rows():
    """A batch's typed rows leave the fold in pieces, in order, and the state goes on after the last."""
    class Cell:
        value, rows = None, []
        exists = lambda self: self.value is not None
        get = lambda self: self.value or self.rows
        update = lambda self, v: setattr(self, "value", v)
        clear = lambda self: setattr(self, "rows", [])
        put = lambda self, v: setattr(self, "rows", v)

    f = live.Fold(False, 0, True, False)
    f.machines, f.held = Cell(), Cell()
    lines = lambda lo, hi: pd.DataFrame({"raw": [f'{{"a": {i}}}' for i in range(lo, hi)], "gaps": None, "source": None, "line_no": range(lo, hi)})[::-1]
    for lo in (0, 20_000):
        out = list(f.handleInputRows(("s",), iter([lines(lo + 10_000, lo + 20_000), lines(lo, lo + 10_000)]), None))
        assert max(map(len, out)) <= live.HANDED_ON and [n for x in out for n in x["line_no"]] == list(range(lo, lo + 20_000))


def test_stream_structure_bounds_batches(spark, tmp_path, monkeypatch):
    """Each batch holds BATCH_LINES lines at most, the stream's next ones, whatever the keys are."""
    monkeypatch.setattr(line_queries, "BATCH_LINES", 40)
    monkeypatch.setattr(line_queries, "shared_path", lambda _: f"{tmp_path}/base")
    spark.range(90).selectExpr("id * 1000 + 7 AS event_id", "id AS user_id", "'view' AS event_type", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in line_queries.stream_structure(spark, f"{tmp_path}").collect()] == [("json", 90)]
    files = sorted((p for p in (tmp_path / "base/in").glob("*.parquet")), key=lambda p: p.stat().st_mtime_ns)
    assert [sorted(r.line_no for r in spark.read.parquet(str(p)).collect()) for p in files] == [list(range(40)), list(range(40, 80)), list(range(80, 90))]
    assert len(list((tmp_path / "base/check/commits").glob("[0-9]*"))) == 3


def test_revisions_while_lines_arrive(spark, tmp_path):
    """A table's header and the lines of a JSON group are plain first, and come again."""
    batches = [["text", "A  B  C"], ["4  5  6", "saved {"], ['  "a": 1', "}"], ["frame=1"], ["frame=2", "over"]]
    src, out, seen, no = f"{tmp_path}/in", f"{tmp_path}/out", [], 0
    for texts in batches:
        spark.createDataFrame([("s", no + i, t) for i, t in enumerate(texts)], "stream_id string, line_no long, text string").coalesce(1).write.mode("append").parquet(src)
        no += len(texts)
        d = spark.readStream.schema("stream_id string, line_no long, text string").option("maxFilesPerTrigger", 1).parquet(src)
        run(live.write_revisions(live.structure_stream(d, provisional=True), out, f"{tmp_path}/check"))  # stops and starts again
        seen.append([(x.line_no, x.line_type, x.final) for x in live.current_lines(spark, out).orderBy("line_no").collect()])
    assert seen[0] == [(0, "plain", True), (1, "plain", False)] and (1, "table", True) in seen[1] and (3, "plain", False) in seen[1]
    assert [t for _, t, _ in seen[2]] == ["plain", "table", "table", "json", "json", "json"]
    assert seen[3][-1] == (6, "progress", False) and seen[4][6:] == [(6, "progress", True), (8, "plain", True)]
    last = live.current_lines(spark, out).where("line_no = 6").first()
    assert last.progress.frame == 2 and last.progress.frozen and last.lines == 2
