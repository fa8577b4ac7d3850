"""The pipeline's stages, each against a plain rule on its own input."""

import os
import random

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "mixing"] and corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(1)
    words = [f"v{i}" for i in range(500)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    item, passage = say(30), say(60)
    docs = [(i, say(120) + (" vile vile2 vileness" if i % 4 == 1 else ""), "en", f"s{i % 3}", 0) for i in range(160)]
    docs += [(1000, docs[0][1], "en", "s0", 0), (1001, docs[2][1] + " tail", "en", None, 0), (1002, say(40) + " " + item, "en", "s1", 0)]
    docs += [(1003, say(80) + " " + passage, "en", "s1", 0), (1004, say(80) + "\n" + passage + " " + say(5), "en", "s2", 0), (1005, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, made, tmp_path):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, made)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        gone = ids(before) - ids(docs)
        if name == "toxicity":
            assert len(gone & set(range(1, 160, 4))) > 36 and len(gone - set(range(1, 160, 4))) < 4
        elif name == "near_dedup":
            assert {1000, 1001} <= gone and len(gone) < 6
        elif name == "substring_dedup":
            assert not gone
            t = {r.doc_id: r for r in docs.collect()}
            assert len(t[1004].text.split()) == 85 and t[1004].n_chars == len(t[1004].text)
        elif name == "decontamination":
            assert gone == {1002}
        else:
            rows = docs.collect()
            assert all(0 < r.taken <= 2 * r["size"] for r in rows) and docs.columns[-4:] == ["size", "source_size", "target", "taken"]


def test_stages_by_brute_force(spark, made):
    """What each stage keeps, by plain Python over all texts (scores come from the trained model, one text at a time)."""
    import hashlib

    import pyarrow as pa

    from logloom.llm import mixing, textcore as tc, toxicity

    docs = spark.read.parquet(f"{made}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{made}/labels.parquet"))
    score = lambda t: model.scores(tc.Words(next(tc.pieces(pa.array([t or ""], pa.string()))), tc.SPACE_WORD))[0]
    rows = {r.doc_id: r.text for r in docs.collect() if score(r.text) < 0.5}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    words = {d: (t or "").split() for d, t in rows.items()}
    least = {d: d for d in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and abs(len(words[a]) - len(words[b])) < 40 and len(set(words[a]) & set(words[b])) > 50 and distance(words[a], words[b]) <= 0.2 * max(len(words[a]), len(words[b])):
                low = min(least[a], least[b])
                least = {d: low if v in (least[a], least[b]) else v for d, v in least.items()}
    rows = {d: t for d, t in rows.items() if least[d] == d}

    first = {}
    for d in sorted(rows):
        for j in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][j : j + 13]), d)
    for d in list(rows):
        gone = {k for j in range(len(words[d]) - 12) if first[tuple(words[d][j : j + 13])] < d for k in range(j, j + 13)}
        words[d] = [w for k, w in enumerate(words[d]) if k not in gone]
        if gone and not words[d]:
            del rows[d]

    item = spark.read.parquet(f"{made}/benchmark.parquet").first().text.split()
    windows = {tuple(item[j : j + 13]) for j in range(len(item) - 12)}
    for d in list(rows):
        hit = {k for j in range(len(words[d]) - 12) if tuple(words[d][j : j + 13]) in windows for k in range(j, j + 13)}
        if hit and 20 * len(hit) >= len(words[d]):
            del rows[d]

    out = corpus_pipeline.run(spark, made).collect()
    assert {r.doc_id for r in out} <= set(rows) and all(r.text.split() == words[r.doc_id] for r in out)
    sha = lambda d: hashlib.sha256(" ".join(words[d]).encode()).hexdigest()
    source = {r.doc_id: r.source for r in docs.collect()}
    left = spark.createDataFrame([(d, " ".join(words[d]), source[d]) for d in rows], "doc_id long, text string, source string")
    want = {}
    for r in mixing.mix(left).collect():
        want.setdefault((r.source, r.source_size, round(r.target, 6)), []).append(r.taken)
    got = {}
    for r in out:
        got.setdefault((r.source, r.source_size, round(r.target, 6)), []).append(r.taken)
    assert got.keys() == {k for k, v in want.items() if sum(v)} and all(sum(got[k]) == sum(want[k]) for k in got)
    assert len({sha(r.doc_id) for r in out}) == len(out)


def test_run_equals_stages(spark, made):
    a, b = (sorted((r.doc_id or 0, r.text or "", r.taken) for r in corpus_pipeline.run(spark, made).collect()) for _ in range(2))
    assert a == b and a


def test_run_writes_each_stage(spark, made, monkeypatch):
    read = []
    look = lambda name, stage: (name, lambda spark, docs, d: read.append(docs.inputFiles()) or stage(spark, docs, d))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [look(*x) for x in corpus_pipeline.STAGES])
    files = [corpus_pipeline.run(spark, made).inputFiles()]
    files += read[1:]
    assert len(read) == 5 and all(f and not any(made in x for x in f) for f in files)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_sql(spark):
    import duckdb

    from logloom.llm import queries

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        assert sorted(map(tuple, queries.QUERIES[name](spark, SF).collect())) == sorted(c.sql(sql).fetchall())
