import random

import pytest

from logloom.functions import jsonx
from logloom.functions.spans import spans
from logloom.operators.fold import duration, fold, key_value, size, space_columns


def tabbed(text):
    out, gaps = "", []
    for i, cell in enumerate(text.split("\t")):
        if i:
            at, to = len(out), (len(out) // 8 + 1) * 8
            out += " " * (to - at)
            gaps.append((at, to))
        out += cell
    return out, gaps


def folded(text, **options):
    return fold([(i, *tabbed(x)) for i, x in enumerate(text.split("\n"))], **options)


def types(text):
    return [r.line_type for r in folded(text)]


def test_gotest():
    rows = folded("=== RUN   TestA\n    --- FAIL: TestA/b (0.01s)\n--- SKIP: TestC (0.00s)\nFAIL\nok  \tpkg\t0.3s\nFAIL\tpkg\t1.2s\n PASS ")
    assert [(r.line_type, r.action, r.depth) for r in rows] == [("gotest_marker", "RUN", 0), ("gotest_result", "FAIL", 1), ("gotest_result", "SKIP", 0), ("gotest_result", "FAIL", 0), ("gotest_result", "PASS", 0), ("gotest_result", "FAIL", 0), ("gotest_result", "PASS", 0)]
    assert [r.status for r in rows] == [0, 2, 0, 2, 1, 2, 1]


def test_diff():
    rows = folded("x\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n ctx\n-old\n+new\n\nend\n--- lone\nplain")
    assert [r.diff_kind for r in rows] == [None, "header-old", "header-new", "hunk", "context", "remove", "add", "context", None, "header-old", None]
    assert len({r.group_id for r in rows if r.line_type == "diff"}) == 2


def test_gotest_inside_a_diff_body_does_not_end_it():
    rows = folded("--- a\n+++ b\n@@ -1 @@\nPASS\n+x")
    assert [r.line_type for r in rows] == ["diff", "diff", "diff", "gotest_result", "diff"]


@pytest.mark.parametrize("line,level", [("Warning: x", "WARNING"), (" [error] x", "ERROR"), ("FATAL x", "FATAL"), ("warn]x", "WARN")])
def test_warning(line, level):
    assert folded(line)[0].level == level


@pytest.mark.parametrize("line", ["INFO: x", "DEBUG: y", "errors: z", "- item: value", "${HOME}/x", "{%d} of {0}", "{}", "'", "http://a/b", "a:b:c"])
def test_stays_plain(line):
    assert types(line) == ["plain"]


def test_json():
    assert types('{"a": 1}\n[1, 2]\n\'{"a": 1}\'\n"k": {"x": 1}\nsent {"a": 1} ok\n{"a": NaN}\n[1') == ["json"] * 5 + ["plain"] * 2
    assert folded('x {"level": "ERR"}')[0].status == 2
    assert [p[2] for p in jsonx.embedded('a {"x": {"y": 1}} b {"z": 2}')] == ['{"x": {"y": 1}}', '{"z": 2}']


def test_multiline_json():
    rows = folded('start {\n  "a": {\n    "b": 1\n  }\n}\nafter')
    assert [r.line_type for r in rows] == ["json"] * 5 + ["plain"]
    assert rows[0].json_prefix == "start " and len({r.group_id for r in rows[:5]}) == 1 and [r.hidden for r in rows] == [False, True, True, True, True, False]
    assert types('{\n  "a": 1\n},') == ["plain"] * 3
    assert types("{\n" + "x\n" * 250 + "}")[0] == "plain"


def test_table():
    rows = folded("NAME    READY   AGE\npod-a   1/1     3d\npod-b   0/1     4d\nplain")
    assert [r.line_type for r in rows] == ["table", "table", "table", "plain"] and rows[0].is_header
    assert types("a\tbb\tccc\nd\tee\tfff") == ["table", "table"]
    assert "table" not in types("\t\tat x\n\t\tat y")
    assert space_columns("é  b  c") == [0, 4, 7]


def test_mismatch_costs_the_next_table_a_row():
    rows = folded("A  B  C\na        b        c\na        b        c\na        b        c")
    assert [r.line_type for r in rows] == ["plain", "plain", "table", "table"]


def test_progress():
    rows = folded("frame=10\nspeed=2.0x\nprogress=continue\nframe=20\nprogress=end\nnext\n[x] frame=3\nbye")
    assert [r.line_type for r in rows] == ["progress", "plain", "progress", "plain"]
    p = rows[0].progress
    assert (p["frame"], p["block_count"], p["percent"], p["ended"]) == (20, 2, 1.0, True) and rows[0].raw.endswith("done")
    assert rows[2].progress["frozen"] and rows[2].raw.endswith("aborted")
    assert key_value("a stream_0_q= 1") == ("stream_0_q", "1") and key_value("frame=") is None and key_value("x=1") is None
    assert types("speed=3x") == ["progress"] and [r.line_type for r in folded("speed=3x", progress=False)] == ["plain"]


def test_summary_parts():
    assert duration(3_723_400_000) == "1h2m3s" and duration(59_000_000) == "59s" and size(1023) == "1023B" and size(1536) == "1.5KiB"


def test_numbers_and_dumps():
    assert [jsonx.number(x) for x in (42.0, 1.5, 1234567.5, 1e-5, 123456.7, -0.00012)] == ["42", "1.5", "1.2345675e+06", "1e-05", "123456.7", "-0.00012"]
    assert jsonx.dumped({"b": [1.0, None, True], "a": "<&>"}) == '{"a":"\\u003c\\u0026\\u003e","b":[1,null,true]}'
    assert jsonx.label(jsonx.parse("null")) == "null" and jsonx.parse('{"a":1,"a":2}') == {"a": 2.0}
    assert jsonx.summary('{"a": 1}') == '{"a":1}' and len(jsonx.summary("x" * 70)) == 60


def test_spans_cover_the_line():
    r = random.Random(3)
    parts = ["2024/01/02 03:04:05", "[error]", "10.0.0.1", "main.go:12", "deployment.apps/web", "x ", " Normal  ", "I0425 00:17:20.844", "client: ", "é", "failed in step a"]
    for _ in range(300):
        raw = "".join(r.choice(parts) + r.choice(["", " ", "  "]) for _ in range(r.randrange(6)))
        s = spans(raw)
        assert s is None or ("".join(x[2] for x in s) == raw and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False)))
    assert ("level-warn" in [x[3] for x in spans("W0425 00:17:20.84 x")]) and spans("plain") is None
    assert [x[3] for x in spans("http://a/b/main.go:12") or []].count("sourceref") == 0
