"""Stored things that go on: the chunk store, the prefix index, the tailing source, statistics from a cutoff on, live rates."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.functions import dates
from logloom.operators import freq, rates
from logloom.operators.prefix import PrefixIndex
from logloom.sources import tail
from logloom.sources.store import EVICTED, Store
from logloom.streaming import live, statistic

LINES = "stream_id string, line_no long, text string"


def test_store_keeps_what_fits_and_tells_what_went(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", chunk=10)
    made = lambda s, lo, hi: spark.createDataFrame([(s, i, f"line {i:04d}") for i in range(lo, hi)], LINES)
    store.append(made("a", 0, 35))
    store.append(made("a", 35, 60).unionByName(made("b/x=1", 0, 12)))
    assert [tuple(r) for r in store.chunks().where("stream_id = 'a' and chunk_id in (0, 3)").select("lines", "bytes", "evicted").orderBy("chunk_id").collect()] == [(10, 90, False)] * 2
    assert store.evict(200) == 4
    assert [r.text for r in store.get("a", 7).collect()] == [EVICTED] and store.get("a", 7).first().evicted
    assert [(r.text, r.evicted) for r in store.get("a", 47).collect()] == [("line 0047", False)]
    assert store.get("a", 999).collect() == [] and [r.text for r in store.get("b/x=1", 3).collect()] == ["line 0003"]
    assert store.evict(200) == 0
    assert {r.line_no for r in store.lines().where("stream_id = 'a'").collect()} == set(range(40, 60))
    plan = store.get("a", 47)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "chunk_id" in plan  # one chunk is read
    store.evict(1)
    assert {r.line_no for r in store.lines().where("stream_id = 'a'").collect()} == set(range(50, 60))  # the newest stays


def test_prefix_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("logloom.operators.prefix.FAN", 8)
    r = random.Random(3)
    rows = {"a": [r.choice([0, 1, 1, 2, 5]) for _ in range(700)], "b": [1] * 9}
    flat = lambda rows: spark.createDataFrame([(s, i, n) for s, v in rows.items() for i, n in enumerate(v)], "stream_id string, line_no long, rows long")
    index = PrefixIndex.build(flat(rows), f"{tmp_path}/index")

    def agrees(index):
        for s, line in (("a", 0), ("a", 1), ("a", 63), ("a", 64), ("a", 333), ("a", 699), ("b", 8)):
            assert index.upto(s, line) == sum(rows[s][:line])
        for s, row in (("a", 0), ("a", 5), ("a", 400), ("a", sum(rows["a"]) - 1), ("a", 10**6), ("b", 3)):
            want = next((i for i in range(len(rows[s])) if sum(rows[s][: i + 1]) > row), len(rows[s]))
            assert index.find(s, row) == want

    assert index.top == 3
    agrees(index)
    for line, n in ((5, 40), (333, 0), (5, 2)):
        rows["a"][line] = n
        index.change(spark.createDataFrame([("a", line, n)], "stream_id string, line_no long, rows long"))
    changes = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/index/changes")
    assert changes.groupBy("level").count().agg(F.max("count")).first()[0] <= 3  # one sum a level for each change
    agrees(index)
    agrees(index.compact(f"{tmp_path}/new"))
    assert index.find("none", 1) is None


def test_whole_lines_and_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "STEP", 7)
    r, path = random.Random(4), str(tmp_path / "f.log")
    for _ in range(60):
        text = "".join(r.choice(["\n", "a", "bc", "\r\n", "é"]) for _ in range(r.randrange(80))).encode()
        with open(path, "wb") as f:
            f.write(text)
        end = tail.whole_lines(path, 0)
        assert end == text.rfind(b"\n") + 1
        step, got = r.randrange(1, 30), []
        for lo in range(0, end, step):
            got += [(at, t) for _, at, t in tail.lines_of(tail.Range(path, lo, min(lo + step, end), 0))]
        assert [t for _, t in got] == [x.removesuffix(b"\r").decode() for x in text[:end].split(b"\n")[:-1]] and len({at for at, _ in got}) == len(got)


def test_tailing_growing_files(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    (tmp_path / "logs").mkdir()
    a, b = tmp_path / "logs/a.log", tmp_path / "logs/b.log"

    def turn():
        d = spark.readStream.format("tail").option("glob", f"{tmp_path}/logs/*.log").option("range", 50).load()
        live.run_available(d, f"{tmp_path}/out", f"{tmp_path}/check")
        rows = spark.read.parquet(f"{tmp_path}/out").orderBy("stream_id", "offset").collect()
        return [[x.text for x in rows if x.stream_id.endswith(n)] for n in ("a.log", "b.log")]

    a.write_text("".join(f"line {i}\n" for i in range(30)) + "half")
    assert turn() == [[f"line {i}" for i in range(30)], []]
    with a.open("a") as f:
        f.write(" done\nmore\n")
    b.write_text("x\n\ny")
    assert turn() == [[f"line {i}" for i in range(30)] + ["half done", "more"], ["x", ""]]
    assert turn() == [[f"line {i}" for i in range(30)] + ["half done", "more"], ["x", ""]]  # nothing comes twice


def test_statistic_from_a_cutoff_on(spark, tmp_path, monkeypatch):
    stat = freq.Stat(["t"], [freq.Rule("a|b", "ab"), freq.Rule("never")], last_n=40)
    r, base, no = random.Random(5), f"{tmp_path}/stat", 0
    kinds = [r.choice("abcde") for _ in range(400)]

    def arrive(n):
        nonlocal no
        rows = [("s", i, "json", f'{{"t":"{kinds[i]}"}}') for i in range(no, no + n)]
        spark.createDataFrame(rows, "stream_id string, line_no long, line_type string, json string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/lines")
        no += n

    def expected(lo):
        c = Counter("ab" if k in "ab" else k for k in kinds[lo:no])
        return sorted([(k, k == "ab", n) for k, n in c.items()] + [("never", True, 0)])

    now = lambda: sorted((x.label, x.is_rule, x.cnt) for x in statistic.counts(spark, stat, base).collect())
    run = lambda: statistic.follow(spark, f"{tmp_path}/lines", stat, base, available_now=True)
    arrive(100)
    plain = statistic._counts
    monkeypatch.setattr(statistic, "_counts", lambda lines, *a: arrive(30) or plain(lines, *a))  # lines come while it registers
    statistic.register(spark, f"{tmp_path}/lines", stat, base)
    monkeypatch.setattr(statistic, "_counts", plain)
    statistic.register(spark, f"{tmp_path}/lines", stat, base)  # again, as after a failure: the cutoff stays
    run().awaitTermination()
    assert now() == expected(60)
    arrive(50)

    def dies(lines, *a):
        plain(lines, *a).write.mode("overwrite").parquet(f"{base}/counts/batch=1")  # written, but the batch isn't committed
        raise RuntimeError("killed")

    monkeypatch.setattr(statistic, "_counts", dies)
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination()
    monkeypatch.setattr(statistic, "_counts", plain)
    arrive(20)
    run().awaitTermination()
    run().awaitTermination()
    assert now() == expected(60)


def test_rates_by_plain_sorting(spark):
    r = random.Random(6)
    rows = [(r.choice("ab"), r.randrange(5_000_000), r.choice([None, 5, 7, r.randrange(10**9)])) for _ in range(500)] + [("c", 7, None)]
    got = {(x.stream_id, x.bucket): x for x in rates.rate_windows(spark.createDataFrame(rows, "stream_id string, arrival_us long, lag_ns long")).collect()}
    first = {s: min(t for x, t, _ in rows if x == s) for s in "abc"}
    by = {}
    for s, t, lag in rows:
        by.setdefault((s, (t - first[s]) // 1_000_000), []).append(lag)
    assert got.keys() == by.keys()
    for k, lags in by.items():
        own = sorted(x for x in lags if x is not None)
        at = lambda q: own[int((len(own) - 1) * q)] / 1e6 if own else None  # noqa: B023, E731
        x = got[k]
        assert (x.lines, x.tagged, x.lag_p50_ms, x.lag_p95_ms, x.lag_p99_ms, x.lag_max_ms) == (len(lags), len(own), at(0.5), at(0.95), at(0.99), at(1.0))


def test_live_rates_drop_late_lines_and_free_state(spark, tmp_path):
    r = random.Random(7)
    start = datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    lags = {k: [r.randrange(10**9) for _ in range(4000)] for k in (0, 1)}
    batches = [[("s", at(k + i / 4000), x) for k in (0, 1) for i, x in enumerate(lags[k])], [("s", at(100), 1)], [("s", at(0.5), 2), ("s", at(200), None)], [("s", at(300), 3)]]
    src, late = f"{tmp_path}/in", 0
    for rows in batches:
        spark.createDataFrame(rows, "stream_id string, arrival_ts timestamp, lag_ns long").coalesce(1).write.mode("append").parquet(src)
        d = spark.readStream.schema("stream_id string, arrival_ts timestamp, lag_ns long").parquet(src)
        q = live.run_available(live.live_rates(d, 1, "10 seconds"), f"{tmp_path}/out", f"{tmp_path}/check")
        late += live.late_rows(q)
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    got = {x.begin.second + 60 * x.begin.minute: x for x in rates.sketch_percentiles(spark.read.parquet(f"{tmp_path}/out")).withColumn("begin", F.col("window.start")).collect()}
    assert late == 1 and left == 1 and sorted(got) == [0, 1, 100, 200]
    for k in (0, 1):
        own = sorted(lags[k])
        assert got[k].lines == got[k].tagged == 4000 and got[k].lag_max_ns == own[-1]
        for q in (50, 95, 99):
            assert abs(sum(x <= got[k][f"lag_p{q}_ms"] * 1e6 for x in own) / 4000 - q / 100) < 0.01
    assert got[200].lag_p50_ms is None and got[200].tagged == 0


def test_times_between_lines_over_chunks(spark):
    r = random.Random(8)
    texts = [r.choice(["none", f"at 2024-01-02 03:{r.randrange(60):02d}:{r.randrange(60):02d} x"]) if not 200 < i < 500 else "none" for i in range(900)]
    d = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "stream_id string, line_no long, raw string").repartition(5)
    got = [x.seconds for x in dates.since_line_before(d, chunk=64).orderBy("line_no").collect()]
    want, last = [], None
    for t in texts:
        now = datetime.datetime.strptime(t[3:22], "%Y-%m-%d %H:%M:%S") if t != "none" else None
        want.append((now - last).total_seconds() if now and last else None)
        last = now or last
    assert got == want


def test_tables_between_steps_are_small(spark):
    from pathlib import Path

    from logloom.sources import shared

    d = shared.written(spark.range(200_000).selectExpr("id AS line_no", "concat('12:00  INFO  ', hash(id) % 20000) AS raw").coalesce(1))
    size = sum(p.stat().st_size for p in Path(shared._WRITTEN[-1]).glob("*.parquet"))
    spark.read.parquet(shared._WRITTEN[-1]).write.option("compression", "snappy").parquet(f"{shared._WRITTEN[-1]}/snappy")
    assert size < 0.8 * sum(p.stat().st_size for p in Path(f"{shared._WRITTEN[-1]}/snappy").glob("*.parquet")) and d.count() == 200_000
