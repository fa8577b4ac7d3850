"""Operators across rows, against brute force; edge cases of all."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import common, decontam, langid, licenses, lm, minhash, mixing, quality, substring_dedup, textcore as tc, tokencount, toxicity

VOCAB = [f"w{i}" for i in range(300)]


def corpus(seed=1, n=120):
    r = random.Random(seed)
    say = lambda k: [r.choice(VOCAB) for _ in range(k)]
    passage, base = say(60), say(200)
    rows = []
    for d in range(n):
        w = say(r.choice([0, 3, 12, 13, 14, 40, 150]))
        if d % 5 == 0:
            w = w[:20] + passage[: r.randrange(10, 60)] + w[20:]
        if d % 7 == 0:
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(200)] = r.choice(VOCAB)
        rows.append((d, " ".join(w).replace(" ", "\n", 1), "s%d" % (d % 3)))
    rows += [(500, rows[7][1], None), (501, rows[7][1], "s1"), (7, rows[7][1], "s1"), (None, rows[14][1], "s0"), (502, None, "s2"), (503, "", None), (504, "x " * 3000, "s0")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("chunk", [1, 1 << 24])
def test_substring_dedup(spark, chunk):
    rows = corpus()
    first = {}
    words = [(d, (t or "").encode().split()) for d, t, _ in rows]
    for d, w in words:
        for j in range(len(w) - 12):
            if d is not None:
                k = tuple(w[j : j + 13])
                first[k] = min(d, first.get(k, d))
    want = []
    for d, w in words:
        gone = {k for j in range(len(w) - 12) if d is not None and first[tuple(w[j : j + 13])] < d for k in range(j, j + 13)}
        want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    got = substring_dedup.remove_repeats(frame(spark, rows).select("doc_id", "text").repartition(5), chunk_bytes=chunk).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert ordered(got.collect()) == ordered(want)


def test_substring_dedup_keeps_columns(spark):
    d = frame(spark, corpus()).withColumn("n_words", F.lit("clash")).withColumn("_key", F.lit(1))
    out = substring_dedup.remove_repeats(d)
    assert set(out.columns) == {"doc_id", "text", "source", "n_words", "n_removed", "kept_sha256", "kept_text"}
    untouched = out.where("n_removed = 0").where("not (kept_text <=> text)").count()
    assert untouched == 0 and out.count() == len(corpus())


def distance(a, b):
    """Edit distance by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_near_duplicates(spark):
    """Against all pairs: exact copies, and texts of five words at least of an edit similarity of 0.8."""
    rows = corpus(2)
    texts = {}
    for d, t, _ in rows:
        if d is not None:
            texts.setdefault(tuple((t or "").split()), []).append(d)
    keys = sorted(texts, key=lambda k: min(texts[k]))
    near = [(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys[:i]) if min(len(a), len(b)) >= 5 and distance(a, b) <= 0.2 * max(len(a), len(b))]
    assert near
    of = classes(len(keys), near)
    want = {(d, min(texts[keys[of[i]]])) for i, k in enumerate(keys) for d in texts[k]}
    got = minhash.op4(frame(spark, rows).repartition(3)).collect()
    assert {(r.doc_id, r.class_id) for r in got if r.doc_id is not None} == want and len(got) == len(rows)
    kept = minhash.deduplicated(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in want})


def test_recall_of_planted_edits(spark):
    """Copies with up to 20 % of their words changed at random, or 15 % spread evenly, half of them with a shared long passage: 0.9 of the links at least."""
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows, pairs = [], {}
    for share, even in ((0.01, False), (0.05, False), (0.1, False), (0.15, False), (0.2, False), (0.1, True), (0.15, True)):
        n = round(120 * share)
        for i in range(60):
            w = [r.choice(vocab) for _ in range(120)]
            if i % 2:
                w[30:90] = passage
            copy = list(w)
            for k in [int((j + 0.5) * 120 / n) for j in range(n)] if even else r.sample(range(120), n):
                copy[k] = f"x{r.random()}"
            pairs.setdefault((share, even), []).append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(w), "s"), (len(rows) + 1, " ".join(copy), "s")]
    got = {x.doc_id: x.class_id for x in minhash.op4(frame(spark, rows)).collect()}
    for kind, ps in pairs.items():
        assert sum(got[a] == got[b] for a, b in ps) >= 0.9 * len(ps), kind
    assert len(set(got.values())) >= len(rows) // 2  # texts that only share the passage stay apart


@pytest.mark.parametrize("block", [16, 2048])
def test_all_links_of_large_buckets(spark, monkeypatch, block):
    """With one part and one order, all pairs of texts that share a bucket count, however many texts it holds."""
    monkeypatch.setattr(minhash.rest, "__defaults__", (block,))
    r = random.Random(5)
    say = lambda k: [f"v{r.randrange(3000)}" for _ in range(k)]
    passage, texts = say(60), []
    for _ in range(60):
        w = say(30) + passage + say(30)
        copy = w[: 120 - r.randrange(12)]
        for k in r.sample(range(100), 6):
            copy[k] = f"x{r.random()}"
        texts += [w, copy]
    r.shuffle(texts)
    parts = minhash._sketched(5, 0, 0, 1)(pa.array([" ".join(w) for w in texts]))[3].to_pylist()
    links = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if parts[i] == parts[j] and minhash.within(tc_words(a), tc_words(b), int(0.2 * max(len(a), len(b)) + 1e-9))]
    assert max(Counter(map(tuple, parts)).values()) > 30 and len(links) > 40
    got = minhash.near_duplicates(frame(spark, [(i, " ".join(w), "s") for i, w in enumerate(texts)]), bands=0, depth=0, singles=1, orders=1)
    assert {(x.doc_id, x.class_id) for x in got.collect()} == set(enumerate(classes(len(texts), links)))


@pytest.mark.parametrize("step", [3, 1000])
def test_buckets_a_little_above_the_small_ones(step):
    """All pairs of a bucket come of it, as pairs or by its texts that are handed on, whatever its size."""
    near = 8
    rows = [(-1, -1)] + [(m, 100 * m + i) for m in range(1, 30) for i in range(m)] + [(99, 9999)]
    cols = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([100] * len(rows))]
    t = pa.RecordBatch.from_arrays(cols, names=["key", "text", "n"])
    got = [r for b in minhash._small_buckets((t.slice(i, step) for i in range(0, len(t), step)), 0.8, near) for r in b.to_pylist()]
    pairs = {(r["a"], r["b"]) for r in got if r["key"] is None}
    for m in range(1, 30):
        on = {r["a"] for r in got if r["key"] == m}
        lost = [(a, b) for b in range(100 * m, 101 * m) for a in range(100 * m, b) if (a, b) not in pairs and not {a, b} <= on]
        assert not lost and bool(on) == (m > near + 1), m


def test_pairs_of_large_buckets_stay_in_tasks(spark):
    """Of texts with the same words in other orders all pairs are tried and none is a link; of others one link for each class that joins."""
    r = random.Random(12)
    common = [f"v{i}" for i in range(120)]
    texts = [r.sample(common, 120) for _ in range(300)]
    for w in texts[:20]:
        texts.append(w[:50] + ["x"] + w[51:])
    docs = frame(spark, [(i, " ".join(w), "s") for i, w in enumerate(texts)])
    made = common_of(docs)
    large = made.select("text", F.explode(F.expr("array(1L, 2L)")).alias("key"))
    none = spark.createDataFrame([], "node long, comp long")
    got = [sorted(x) for x in minhash.rest(docs, large, made, none, 0.8).collect()]
    assert sorted(got) == [[i, 300 + i] for i in range(20)]


def test_unlike_texts_of_large_buckets_are_not_aligned(monkeypatch):
    """Texts of the same words in other orders, with a line in common, share too few k-mers for a link: none of their pairs is aligned."""
    r = random.Random(3)
    words, line, tried = [f"v{i}" for i in range(120)], [f"l{i}" for i in range(12)], []
    texts = [line + r.sample(words, 120) for _ in range(60)]
    texts.append(texts[0][:70] + ["x"] + texts[0][71:])
    packed = [np.array([zlib.crc32(x.encode()) for x in w], "<u4") for w in texts]
    n = len(texts)
    t = pa.table({"n": [132] * n, "comp": range(n), "block": [0] * n, "hist": pa.array([bytes(minhash.CELLS)] * n), "below": pa.array([[]] * n, pa.list_(pa.int64())), "words": [w.tobytes() for w in packed]})
    within = minhash.within
    monkeypatch.setattr(minhash, "within", lambda a, b, most: tried.append(1) or within(a, b, most))
    assert minhash._links([1, 0, 0], t, 0.8).to_pylist() == [{"a": n - 1, "b": 0}]
    assert len(tried) == 1


@pytest.mark.parametrize("passes", [((4, 2),), ((3, 3),), ((4, 2), (3, 3))])
def test_texts_that_may_be_in_links(spark, passes):
    """No text with a link to another class goes, at lengths on both sides of the k-mers' limit and with repeated words; texts that only share a line do."""
    r = random.Random(4)
    line, texts = [f"l{i}" for i in range(8)], []
    for length in (5, 6, 9, 15, 31, 32, 33, 39, 40, 41, 48, 49, 50, 51, 100, 160):
        for _ in range(4):
            w = [f"v{r.randrange(length if r.random() < 0.5 else 3000)}" for _ in range(length)]
            copy = list(w)
            for k in range(4, length, 5) if r.random() < 0.5 else r.sample(range(length), length // 5):
                copy[k] = f"x{r.random()}"
            texts += [w, copy if r.random() < 0.7 else w[: length - length // 5]]
    alone = len(texts)
    texts += [line + [f"w{r.random()}" for _ in range(80)] for _ in range(40)]
    packed = [np.array([zlib.crc32(x.encode()) for x in w], "<u4") for w in texts]
    rows = [(i, len(w), i, bytearray(w.tobytes())) for i, w in enumerate(packed)]
    left = spark.createDataFrame(rows, "text long, n long, comp long, words binary").repartition(3)
    for long, short in passes:
        left = minhash.sharing(left, long, short, 0.8)
    left = {x.text for x in left.collect()}
    linked = {i for a in range(alone) for b in range(a) if minhash.within(packed[a], packed[b], int(0.2 * max(len(packed[a]), len(packed[b])) + 1e-9)) for i in (a, b)}
    assert len(linked) > 60 and linked <= left
    assert not any(i >= alone for i in left)
    one = spark.createDataFrame([(i, n, 7, w) for i, n, _, w in rows], "text long, n long, comp long, words binary")
    assert {x.n for x in minhash.sharing(one, *passes[0], 0.8).collect()} <= {4, 5}  # one class has nothing to join


def common_of(docs):
    made = common.arrow_map(docs, minhash.NEW, partial(minhash._sketched, 5, 0, 0, 1))
    return made.select(F.col("_h1").bitwiseXOR(F.col("_h2")).alias("text"), F.col("doc_id").alias("rep"), F.col("_n").alias("n"), F.col("_hist").alias("hist"))


def tc_words(w):
    return [zlib.crc32(x.encode()) for x in w]


@pytest.mark.parametrize("edges", [1, 7, 1 << 18])
def test_components(spark, monkeypatch, edges):
    """Chains, stars and single edges, joined up by tasks of few edges or many."""
    r = random.Random(6)
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    r.shuffle(links)
    monkeypatch.setattr(minhash, "EDGES", edges)
    of = classes(300, links)
    got = minhash.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {(x.node, x.comp) for x in got} == {(i, c) for i, c in enumerate(of) if i != c} and len(got) == len({x.node for x in got})


def test_one_text_of_a_doc_id_stays(spark):
    rows = [(1, "b " * 9, "s"), (1, "a " * 9, "t"), (1, None, "u"), (2, "c " * 9, "s"), (2, "d " * 9, "s")]
    for n in (1, 3):
        assert sorted((x.doc_id, x.text) for x in minhash.deduplicated(frame(spark, rows).repartition(n)).collect()) == [(1, None), (2, "c " * 9)]


def test_large_group_of_near_copies(spark):
    """Hundreds of copies of one text, each edited by itself, beside texts that are not of them, are one class."""
    r = random.Random(9)
    base = [r.choice(VOCAB) for _ in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in r.sample(range(150), r.randrange(1, 12)):
            w[k] = f"x{r.random()}"
        rows.append((i, " ".join(w), "s"))
    rows += [(1000 + i, " ".join(base[:20] + [r.choice(VOCAB) for _ in range(150)]), "s") for i in range(200)]
    got = {x.doc_id: x.class_id for x in minhash.op4(frame(spark, rows)).collect()}
    assert {got[i] for i in range(400)} == {0} and len({got[1000 + i] for i in range(200)}) == 200


def test_chain_of_near_copies(spark):
    """Each is near the next only; the class holds all."""
    r = random.Random(3)
    w, rows = [f"c{i}" for i in range(300)], []
    for d in range(12):
        rows.append((100 - d, " ".join(w), "s"))
        w = list(w)
        for _ in range(5):
            w[r.randrange(300)] = f"n{r.random()}"
    assert {x.class_id for x in minhash.op4(frame(spark, rows)).collect()} == {89}


def test_alignment():
    r = random.Random(4)

    for _ in range(400):
        a = [r.randrange(4) for _ in range(r.randrange(15))]
        b = [r.randrange(4) for _ in range(r.randrange(15))] if r.random() < 0.5 else [x for x in a if r.random() < 0.8]
        for most in range(8):
            assert minhash.within(a, b, most) == (distance(a, b) <= most)



def test_mixing(spark):
    rows = corpus(6, 300)
    out = mixing.op3(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r, s in ((r, s) for r in out for d, t, s in rows if d == r.doc_id and d is not None and d != 7 and len((t or "").split()) == r["size"]):
        by.setdefault(s, [r.source_size, r.target, 0])[2] += r.taken
    assert all(r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in out)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    total = {}
    for r in out:
        total[r.target, r.source_size] = total.get((r.target, r.source_size), 0) + r.taken
    for (target, size), taken in total.items():
        assert size in sizes.values() and target <= 2 * size + 1e-6 and abs(taken - target) <= 2
    assert math.isclose(sum(t for t, _ in total), 1.5 * sum(sizes.values()))
    assert ordered(mixing.op3(frame(spark, rows).repartition(7)).collect()) == ordered(out)


def test_mixing_repeated_rows_and_clashing_columns(spark):
    """Equal rows are taken one by one, so that the source comes to its target; columns of the operator's own names give way."""
    rows = [(1, "a b c", "s0")] * 1000 + [(d, "x " * (d % 40 + 1), "s1") for d in range(2, 400)]
    d = frame(spark, rows).withColumn("taken", F.lit("clash")).withColumn("_mix_b", F.lit(1)).withColumn("extra", F.lit(2))
    out = mixing.mix(d).collect()
    assert len(out) == len(rows) and "extra" in out[0].asDict()
    for s, step in (("s0", 3), ("s1", 1)):
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= step


def test_mixing_fits_like_brute_force():
    """The sum that is taken is as near to the budget as any choice of copies comes."""
    r = random.Random(11)
    for _ in range(40):
        lengths = sorted(r.sample(range(3, 60), r.randrange(1, 5)))
        counts = [r.randrange(1, 5) for _ in lengths]
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {x + n * k for x in sums for k in range(c + 1)}
        budget = r.randrange(0, max(sums) + 1)
        took = int((mixing.fit_counts(np.array(lengths), np.array(counts), budget) * np.array(lengths)).sum())
        assert abs(took - budget) == min(abs(x - budget) for x in sums)


def test_targets_and_fit():
    assert mixing.targets([10, 100, 100], [3, 1, 2], 315) == pytest.approx([20, 295 / 3, 590 / 3])
    r = random.Random(7)
    for _ in range(60):
        lengths = np.array(sorted(r.sample(range(1, 40), r.randrange(1, 8))))
        counts = np.array([r.randrange(1, 9) for _ in lengths])
        budget = r.randrange(0, int((lengths * counts).sum()) + 5)
        take = mixing.fit_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and abs(int((take * lengths).sum()) - min(budget, int((lengths * counts).sum()))) <= lengths.max()


def test_lm(spark):
    rows = corpus(8)
    d = frame(spark, rows)
    out = lm.score_texts(d, flush=100).collect()
    counts, toks = Counter(), []
    for i, t, _ in rows:
        w = [*(t or "").lower().split(), "\0end"]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        toks.append((i, held, w))
        if not held:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = [(i, h, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, h, w in toks]
    assert ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == ordered(want)
    assert all(r.score < 0 for r in out)


def test_lm_repeated_rows_outside_the_head(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 4)
    rows = [(i, " ".join(VOCAB[i : i + 9]), "s") for i in range(40)]
    rows += [(7, rows[7][1], "s")] * 2 + [(None, "w1 w2 unseen", "s")] * 3
    out = lm.score_texts(frame(spark, rows), flush=50).collect()
    counts, held = Counter(), lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t, _ in rows:
        if not held(i):
            counts.update([*t.split(), "\0end"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        w = [*t.split(), "\0end"]
        want.append((i, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    assert ordered((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == ordered(want)
    assert len({round(r.score, 6) for r in out if r.doc_id == 7}) == 1


def test_lm_is_normalised():
    m = lm.LogBilinear(np.array([5.0, 3, 9, 2, 1]))
    m.trainer()(np.array([1, 2, 3, 4, 0, 2, 3, 1] * 40), np.array([0, 100, 320]))
    assert np.allclose((10.0 ** m.log10().astype(np.float64)).sum(-1), 1, atol=1e-4)


@pytest.mark.parametrize("scale", [1, 40])
def test_scores_against_double_precision(scale):
    """Probabilities sum to 1, also where the two words before favour different classes by far."""
    m = lm.LogBilinear(np.arange(30, 0, -1.0), singles=4)
    m.rows[: len(m.of) + m.k, : lm.DIM] *= scale
    r, b, s, sb, c0, c1 = (x.astype(float) for x in m.parts())
    q = r[None] @ c0 + (r @ c1)[:, None]
    z, x = q @ s.T + sb, q @ r.T + b
    want = np.take_along_axis(z - np.logaddexp.reduce(z, 2)[:, :, None], m.of[None, None], 2)
    for c in range(m.singles, m.k):
        lo, hi = m.begin[c : c + 2]
        want[:, :, lo:hi] += x[:, :, lo:hi] - np.logaddexp.reduce(x[:, :, lo:hi], 2)[:, :, None]
    assert np.abs(m.log10() - want / np.log(10)).max() < 1e-5 * scale
    most1, most2 = (r @ c0 @ s.T + sb).argmax(1), (r @ c1 @ s.T).argmax(1)
    assert (most1[None] != most2[:, None]).any()


def test_lm_classes_are_normalised():
    m = lm.LogBilinear(np.arange(30, 0, -1.0), singles=4)
    seq = np.random.default_rng(1).integers(0, 30, 5000)
    m.trainer()(seq, np.array([0, 2000, 5000]))
    assert m.k < 15 and np.allclose((10.0 ** m.log10().astype(np.float64)).sum(-1), 1, atol=1e-4)


def test_lm_order_outside_the_shortlist(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHORTLIST", 2)
    r = random.Random(11)
    pairs = [(f"x{i}", f"y{i}") for i in range(12)]
    say = lambda ps: " ".join(w for p in ps for w in p)
    docs = [(i, say(r.choice(pairs) for _ in range(60)), "s") for i in range(600)]
    swapped = [(a, pairs[(k + 5) % 12][1]) for k, (a, _) in enumerate(pairs)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    out = {x.doc_id: x for x in lm.score_texts(frame(spark, [*docs, (held[0], say(pairs * 4), "s"), (held[1], say(swapped * 4), "s")])).collect()}
    good, bad = out[held[0]], out[held[1]]
    assert math.isclose(good.base_score, bad.base_score) and good.score > bad.score + 10


def test_lm_scores_by_plain_sums():
    """log10 of the class's probability and the symbol's in its class, token by token."""
    r = np.random.default_rng(3)
    m = lm.LogBilinear(np.arange(40, 0, -1.0), singles=5)
    m.rows[:, : lm.DIM + 1] = r.normal(size=m.rows[:, : lm.DIM + 1].shape) * 0.7
    vec, bias, cvec, cbias, c0, c1 = (x.astype(np.float64) for x in m.parts())
    w, one, two = (r.integers(0, 40, 200) for _ in range(3))
    got = m.scorer()(w, one, two)
    for k in range(200):
        q = vec[one[k]] @ c0 + vec[two[k]] @ c1
        z = cvec @ q + cbias
        c = m.of[w[k]]
        p = z[c] - np.log(np.exp(z).sum())
        lo, hi = m.begin[c : c + 2]
        if hi - lo > 1:
            u = vec[lo:hi] @ q + bias[lo:hi]
            p += u[w[k] - lo] - np.log(np.exp(u).sum())
        assert abs(got[k] - p / np.log(10)) < 1e-4


def test_lm_training_step_by_plain_gradients():
    """One batch of several texts against the gradients of each token and its noise, one by one, in double precision."""
    r = np.random.default_rng(4)
    m = lm.LogBilinear(np.arange(40, 0, -1.0), singles=5)
    m.rows[:, : lm.DIM] += r.normal(size=(len(m.rows), lm.DIM)) * 0.2
    n, off = len(m.of), np.array([0, 0, 30, 31, 33, 400])
    w = np.minimum(r.geometric(0.1, 400) - 1, 39)
    w[[29, 30, 32, 399]] = lm.END
    p = m.rows[:, : lm.DIM + 1].astype(float)
    c0, c1 = p[n + m.k : n + m.k + lm.DIM, : lm.DIM], p[n + m.k + lm.DIM :, : lm.DIM]
    draw, bounds = np.random.default_rng(lm.SEED), np.concatenate(([0], np.cumsum(m.share)))
    total = np.cumsum(m.classes)
    noise = np.searchsorted(total, draw.random(lm.NOISE) * total[-1], "right")
    own = sorted({c for c in m.of[w].tolist() if c >= m.singles})
    u = draw.random((len(own), lm.INNER))
    within = {c: np.searchsorted(bounds, bounds[m.begin[c]] + (bounds[m.begin[c + 1]] - bounds[m.begin[c]]) * x, "right") - 1 for c, x in zip(own, u, strict=True)}
    grad = np.zeros_like(p)
    for lo, hi in zip(off[:-1], off[1:], strict=True):
        for t in range(lo, hi):
            one, two, c = w[t - 1] if t > lo else lm.END, w[t - 2] if t > lo + 1 else lm.END, m.of[w[t]]
            q = np.append(p[one, : lm.DIM] @ c0 + p[two, : lm.DIM] @ c1, 1)
            at = [(n + c, lm.NOISE * m.classes[c], 1)] + [(n + x, lm.NOISE * m.classes[x], 0) for x in noise]
            if c >= m.singles:
                at += [(w[t], lm.INNER * m.inner[w[t]], 1)] + [(x, lm.INNER * m.inner[x], 0) for x in within[c]]
            dq = np.zeros(lm.DIM + 1)
            for row, expected, true in at:
                g = 1 / (1 + expected * np.exp(-q @ p[row])) - true
                grad[row] += g * q
                dq += g * p[row]
            dq = dq[: lm.DIM]
            grad[one, : lm.DIM] += c0 @ dq
            grad[two, : lm.DIM] += c1 @ dq
            grad[n + m.k :, : lm.DIM] += np.concatenate((np.outer(p[one, : lm.DIM], dq), np.outer(p[two, : lm.DIM], dq)))
    grad /= len(w)
    m.trainer()(w, off)
    assert np.abs(m.rows[:, : lm.DIM + 1] - (p - lm.RATE * grad / np.sqrt(1e-6 + grad**2))).max() < 1e-4


def test_lm_training_reduces_few_rows_run_by_run(monkeypatch):
    """Rows that reduceat takes run by run, which is slow for short runs: 4.2 a token before."""

    class Counting:
        rows = 0

        def __getattr__(self, name):
            return self if name == "add" else getattr(np, name)

        def reduceat(self, x, at, axis=0):
            self.rows += len(x)
            return np.add.reduceat(x, at, axis=axis)

    share = 1 / np.arange(3, 15_365)
    m = lm.LogBilinear(share / share.sum() * 1e8)
    w = np.random.default_rng(1).choice(len(share), 4 * lm.BATCH, p=share / share.sum())
    train, counting = m.trainer(), Counting()
    monkeypatch.setattr(lm, "np", counting)
    train(w, np.array([0, 5000, len(w)]))
    assert 0 < counting.rows < 1.5 * len(w)


def test_lm_sums_over_runs():
    r = np.random.default_rng(5)
    for n in (1, 7, 900):
        keys = np.minimum(r.geometric(0.02, n), r.integers(1, 300, n))
        g, order = r.normal(size=(n, 3)), np.argsort(keys, kind="stable")
        want = np.zeros((300, 3))
        np.add.at(want, keys, g)
        cut, sizes = lm._runs(keys[order])
        assert sizes.sum() == n and (keys[order][cut] == np.unique(keys)).all()
        for which, out in (lm._sums(g, cut, sizes, order), lm._sums(g[order], cut, sizes)):
            assert np.allclose(out, want[keys[order][cut[which]]]) and len(which) == len(np.unique(keys))


def test_lm_places_of_head_words():
    """Also of hashes that share their highest bits, and the least and the largest one."""
    r = np.random.default_rng(6)
    words = np.unique(np.concatenate((r.integers(0, 1 << 64, 3000, dtype=np.uint64), np.arange(20, dtype=np.uint64) + np.uint64(77 << 40), np.array([0, (1 << 64) - 1], np.uint64))))
    words = r.permutation(words)
    for known in (words, words[:1], words[:0], words[1:2000]):
        head = lm.Head(known, 10, 5)
        want = {x: i for i, x in enumerate(head.words.tolist())}
        asked = np.concatenate((words, words + np.uint64(1), head.words))
        assert head.places(asked).tolist() == [want.get(x, -1) for x in asked.tolist()]
        assert (head.places(asked[:0]).tolist(), head.places(head.words).tolist()) == ([], list(range(len(head.words))))


def test_lm_beats_its_unigrams(spark):
    """Held-out texts of a source with order are likelier than under the counts alone."""
    r = random.Random(31)
    follow = {f"w{i}": [f"w{r.randrange(80)}" for _ in range(3)] for i in range(80)}

    def say(k):
        out = [f"w{r.randrange(80)}"]
        while len(out) < k:
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    out = lm.score_texts(frame(spark, [(d, say(200), "s") for d in range(500)])).where("held_out").collect()
    assert sum(x.score for x in out) > sum(x.base_score for x in out) * 0.9


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    """Trainers follow from the tokens: as many, with the same rows, whatever the table's partitions are."""
    monkeypatch.setattr(lm, "TRAINED", 4000)
    d = frame(spark, corpus(8, 300))
    one, many = ({(r.doc_id, r.n_tokens): r.score for r in lm.op8(d.repartition(k)).collect()} for k in (2, 24))
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_lm_gains_on_the_tables(spark):
    """Held-out log10 a token, against the counts alone, with few and with many partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gain = []
    for k in (4, 64):
        r = lm.op8(docs.repartition(k)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        gain.append((r[0] - r[1]) / r[2])
    assert min(gain) > 0.045 and abs(gain[0] - gain[1]) < 0.1 * max(gain)


def test_lm_learns_order():
    m = lm.LogBilinear(np.ones(6) * 100)
    seq = np.array([2, 3, 4, 5] * 4000)
    train = m.trainer()
    for _ in range(4):
        train(seq, np.array([0, len(seq)]))
    p = 10.0 ** m.log10()
    assert p[2, 3, 4] > 0.5 and p[2, 3, 5] < 0.2


def test_licenses(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0; MIT  license", ""), (2, "xmit license, mit licenses", ""), (3, None, ""), (4, "", ""),
        (5, "GNU General\nPublic License; general public license" + " x" * 3000 + " mit license", ""), (None, "All rights reserved.", ""), (1, "nothing here", ""), (6, "SPDX-License-Identifier: BSD-3-Clause", ""),
    ]
    out = {(r.doc_id, r.n_words): r for r in licenses.op5(frame(spark, rows)).collect()}
    r = out[1, 10]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (2, 3, 8, "apache,mit", "apache,mit")
    assert out[2, 4].n_base == 0 and out[2, 4].first_word is None and out[3, 0].labels == "" and out[4, 0].score == 0
    r = out[5, 3009]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (3, 1, 3007, "gpl,mit") and out[None, 3].labels == "proprietary"
    assert "bsd" in out[6, 6].labels and 0 <= out[6, 6].score <= 1 and len(licenses.rules()) > 200


def said(rx, r):
    """A text that a pattern matches, alternatives and repeats chosen at random."""

    def one(op, arg):
        op = str(op)
        if op == "LITERAL":
            return chr(arg)
        if op == "BRANCH":
            return every(r.choice(arg[1]))
        if op == "SUBPATTERN":
            return every(arg[-1])
        if op == "MAX_REPEAT":
            return "".join(every(arg[2]) for _ in range(r.randint(arg[0], arg[1])))
        if op == "IN":
            return chr(r.choice([c for o, x in arg for c in (range(x[0], x[1] + 1) if str(o) == "RANGE" else [x])]))
        assert op in ("ASSERT", "AT"), op
        return ""

    def every(p):
        return "".join(one(*x) for x in p)

    return every(re._parser.parse(rx)).strip()


def test_licenses_gates_follow_from_rules(spark):
    """Each of the rules finds its example, and finds it as well where other words open all gates."""
    r = random.Random(12)
    rows = []
    for k, rule in enumerate(licenses.rules()):
        for _ in range(6):
            t = said(rule["rx"], r)
            if re.search(rule["rx"], t):
                rows.append((k, t if r.random() < 0.5 else t.upper().replace(" ", ",\n"), ""))
    assert {k for k, _, _ in rows} == set(range(len(licenses.rules()))) and len(licenses.rules()) == 445
    gated = licenses.scan_licenses(frame(spark, rows)).select("doc_id", "text", "detections")
    opened = licenses.scan_licenses(frame(spark, [(k, t + " copyright licen under", "") for k, t, _ in rows])).select("detections")
    for (k, t, found), (wide,) in zip(gated.collect(), opened.collect(), strict=True):
        rule = licenses.rules()[k]
        assert found == wide, t
        assert any(x["label"] == rule["label"] or x["prio"] >= rule["prio"] for x in found), (rule, t)


def test_licenses_against_a_plain_loop(spark):
    """All rules on all texts, without gates, keywords or priorities' arrays."""
    r = random.Random(14)
    rules = licenses.rules()
    filler = ["the", "under", "license", "copyright", "mit", "gnu", "x", "general", "public", "domain", "é2"]
    rows = [(None, None, "")]
    for k in range(150):
        parts = []
        for _ in range(r.randrange(6)):
            parts += [said(r.choice(rules)["rx"], r)] + [r.choice(filler) for _ in range(r.randrange(4))]
        rows.append((k, r.choice([" ", ", ", "\n"]).join(parts), ""))
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    for x in got:
        norm = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x.text or "")))
        hits = [(norm[: m.start()].count(" "), norm[: m.end()].count(" "), q["prio"], q["label"], q["rule"]) for q in rules for m in re.finditer(q["rx"], norm)]

        def hidden(a):
            return any(b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and (b[:2] != a[:2] or b[2] > a[2] or b[4] < a[4]) for b in hits)

        assert sorted(tuple(d) for d in x.detections) == sorted(h for h in hits if not hidden(h)), x.text


def test_licenses_names_that_end_in_license(spark):
    r = random.Random(13)
    names = [(lab, said(name, r)) for _, lab, _, name in licenses.FAMILIES if name.endswith(("license", "licen[cs]e"))]
    assert len(names) == 17
    rows = [(k, f"{before}{name} 2.0", "") for k, (_, name) in enumerate(names) for before in ("this is the ", "see the ")]
    for x in licenses.op5(frame(spark, rows)).collect():
        assert names[x.doc_id][0] in x.labels.split(","), names[x.doc_id]
    assert licenses.op5(frame(spark, [(1, "Mozilla Public License 2.0", "")])).first().labels == "mpl"


def test_licenses_said_shortly(spark):
    """Names without the word license after them, and texts that say nothing of a license."""
    said_ = ["MIT licensed", "Licence: MIT", "code is under ISC", "used under BSD-3-Clause", "it comes under the Apache 2.0", "License: MPL 2.0", "gpl-v3 licensed", "submitted under discussion", "an admitted thing is under mittens"]
    got = {x.doc_id: x.labels for x in licenses.op5(frame(spark, [(i, t, "") for i, t in enumerate(said_)])).collect()}
    assert [got[i] for i in range(len(said_))] == ["mit", "mit", "isc", "bsd", "apache", "mpl", "gpl", "", ""]


def test_licenses_suppress_contained(spark):
    d = licenses.scan_licenses(frame(spark, [(1, "licensed under the mit license", "")])).first()
    assert [(x["lo"], x["hi"]) for x in d.detections] == [(0, 4)]


def test_sample_shares_bytes(spark):
    rows = [(i, "a" * 1000, "common") for i in range(4000)] + [(5000 + i, "b" * 1000, "rare") for i in range(20)] + [(6000 + i, "c" * 15_000, "common") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = common.bounded_sample(d, d.select("doc_id", "lang"), "lang", 100, 60_000)
    n = Counter(r["lang"] for r in got)
    assert n["rare"] == 20 and n["common"] >= 36 and sum(len(r["text"]) for r in got) <= 60_000


EMPTY = "doc_id long, text string, source string, lang string"
OPERATORS = {
    "op1": substring_dedup.op1, "op2": lambda d: toxicity.op2(d, d.sparkSession.createDataFrame([], "doc_id long, toxic int")), "op3": mixing.op3, "op4": minhash.op4, "op5": licenses.op5, "op6": langid.op6,
    "op7": lambda d: quality.op7(d, d.sparkSession.createDataFrame([], "doc_id long, quality int")), "op8": lm.op8, "op9": lambda d: decontam.op9(d, d.sparkSession.createDataFrame([], "item_id long, text string")),
}


CLASH = {"n_words": "x", "score": "x", "_id": 1, "_tag": 2, "_h1": 3, "_bands": 4, "size": 5, "taken": 6, "_b": 7, "key": 8, "base": 9, "_norm": "y", "lang_pred": "z", "kept": "k", "probability": "p", "_text": "t", "bucket": 1, "data": "d", "_part": 1}


def test_clashing_columns_and_long_texts(spark, monkeypatch):
    """Columns that share a name with the operators' own change no result; nor do texts longer than a piece."""
    monkeypatch.setattr(tc, "PIECE_BYTES", 300)
    monkeypatch.setattr(tc.pieces, "__defaults__", (300,))
    plain = frame(spark, [*corpus(9, 60), (900, "word " * 400 + "mit license", "s0")]).withColumn("lang", F.lit("en"))
    odd = plain
    for k, v in CLASH.items():
        odd = odd.withColumn(k, F.lit(v))
    labels = spark.createDataFrame([(d, d % 2, d % 2) for d in range(60)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, plain.where("doc_id = 5").first().text)], "item_id long, text string")
    runs = {
        "op1": substring_dedup.op1, "op2": lambda d: toxicity.op2(d, labels), "op3": mixing.op3, "op4": minhash.op4, "op5": licenses.op5, "op6": langid.op6,
        "op7": lambda d: quality.op7(d, labels), "op8": lm.op8, "op9": lambda d: decontam.op9(d, items),
    }
    for name, run in runs.items():
        rounded = lambda d: ordered(tuple(round(v, 4) if isinstance(v, float) else v for v in x) for x in d.collect())
        assert rounded(run(plain)) == rounded(run(odd)), name


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_and_null(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], EMPTY)).count() == 0
    rows = [(None, None, None, None), (1, None, None, None), (2, "", "s", "en"), (2, "", "s", "en"), (3, " \n ", None, None)]
    assert OPERATORS[name](spark.createDataFrame(rows, EMPTY)).count() == len(rows)


def test_empty_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    assert tokencount.op10(spark.createDataFrame([], EMPTY), public.path("byte_bpe_50k.json")).count() == 0
