"""The additive quality classifier, against plain versions and held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import gam, textcore as tc

SPACE = re.compile("[^\x20\x09-\x0D]+")


def plain(t):
    w = SPACE.findall(t)
    if not w:
        return [0.0] * len(gam.FEATURES)
    n, chars = len(w), len(t)
    size = [len(x) for x in w]
    mean = sum(size) / n
    letters = max(1, sum(c.isascii() and c.isalpha() for c in t))
    share = lambda s: sum(c in s for c in t) / chars
    wins = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeated = {j for i in range(n - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, dup, seen = t.split("\n"), 0, set()
    for x in lines:
        dup += bool(SPACE.search(x)) and x in seen
        seen.add(x)
    return [
        math.log1p(n), mean, math.sqrt(n * sum(s * s for s in size) - sum(size) ** 2) / n, math.log1p(max(size)), share("#*$%&|<>"), share("!?"), share(".,;:"), share("()[]{}\"'`"), share("-_/\\=@+~^"), share("0123456789"),
        sum("A" <= c <= "Z" for c in t) / letters, sum(ord(c) > 127 for c in t) / chars, share(" \t\n\x0b\f\r"), math.log1p(n / len(lines)), dup / len(lines), len(repeated) / n,
        sum(a == b for a, b in zip(w, w[1:])) / n, len(set(w)) / n, max(Counter(w).values()) / n, sum(x[-1] in ".,;:" for x in w) / n, sum("A" <= x[0] <= "Z" for x in w) / n,
    ]


def some_texts(n, seed):
    r = random.Random(seed)
    pool = ["a", "Be", "the", "é", "中文", "x1", "ZZ.", " ", "\n", "\t", "\r\n", "\x0b", ",", "#", "(b)", "\x00", "!", "the end"]
    return ["", " ", "\n\n"] + ["".join(r.choice(pool) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(1, 60))) for _ in range(n)] + ["w " * 3000, "v"]


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_features(most):
    ts = some_texts(200, 5)
    got = np.concatenate([gam.features(p) for p in tc.pieces(pa.array([*ts, None], pa.string()), most)])
    assert np.allclose(got, [plain(t) for t in [*ts, ""]], atol=1e-9)


def test_trees_by_plain_search():
    r = np.random.default_rng(2)
    for _ in range(20):
        g, h = r.normal(size=12), r.uniform(1, 2, 12)
        value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + gam.RIDGE)
        cut = max(range(1, 12), key=lambda c: value(0, c) + value(c, 12))
        two = gam.shallow_tree(g, h, 2)
        assert np.allclose(two, np.where(np.arange(12) < cut, -g[:cut].sum() / (h[:cut].sum() + gam.RIDGE), -g[cut:].sum() / (h[cut:].sum() + gam.RIDGE)))
        assert len(np.unique(gam.shallow_tree(g, h).round(12))) <= 4
        g2, h2 = r.normal(size=(5, 4)), r.uniform(1, 2, (5, 4))
        cells = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 4)), (slice(i, 5), slice(0, j)), (slice(i, 5), slice(j, 4))]
        gain = lambda i, j: sum(g2[c].sum() ** 2 / (h2[c].sum() + gam.RIDGE) for c in cells(i, j))
        i, j = max(((i, j) for i in range(1, 5) for j in range(1, 4)), key=lambda x: gain(*x))
        got, step = gam.quadrants(g2, h2)
        assert abs(got - (gain(i, j) - g2.sum() ** 2 / (h2.sum() + gam.RIDGE))) < 1e-9
        assert all(np.allclose(step[c], -g2[c].sum() / (h2[c].sum() + gam.RIDGE)) for c in cells(i, j))


def test_learns_curves_and_pairs():
    r = np.random.default_rng(4)
    x = r.normal(size=(6000, len(gam.FEATURES)))
    y = ((np.abs(x[:, 3]) > 0.7) ^ (r.uniform(size=6000) < 0.02)).astype(int)  # no line parts these
    m = gam.fit(x[:4000], y[:4000], y.mean())
    assert ((m.scores(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.95 and m.parts()[0][0] == gam.FEATURES[3]
    y = (x[:, 1] * x[:, 2] > 0).astype(int)  # each feature by itself tells nothing
    m = gam.fit(x[:4000], y[:4000], y.mean())
    assert ((m.scores(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.9 and (1, 2) in m.pairs


def test_score_is_a_sum_of_tables():
    r = np.random.default_rng(6)
    x = r.normal(size=(500, len(gam.FEATURES)))
    m = gam.fit(x, (x[:, 0] + x[:, 5] * x[:, 6] > 0).astype(int))
    for row, got in zip(x[:40], m.logits(x[:40]), strict=True):
        b = [sum(v >= e for e in es) for v, es in zip(row, m.edges, strict=True)]
        z = m.bias + sum(m.tables[j][k] for j, k in enumerate(b)) + sum(t[b[i] // 2][b[j] // 2] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        assert abs(z - got) < 1e-9


def test_frequent_values_have_bins_of_their_own():
    x = np.array([0.0] * 50 + [1.0] * 30 + list(np.linspace(0.01, 0.99, 20)))
    e = gam.cuts(x, 8)
    bins = np.searchsorted(e, [0.0, 1e-6, 0.5, 1 - 1e-6, 1.0], "right")
    assert len(e) < 8 and bins[0] < bins[1] <= bins[3] < bins[4]


def test_one_label_or_none():
    x = np.zeros((5, len(gam.FEATURES)))
    assert (gam.fit(x, np.ones(5)).scores(x) > 0.5).all() and (gam.fit(x, np.zeros(5)).scores(x) < 0.5).all() and gam.fit(x[:0], []).scores(x[:1])[0] > 0.5
    assert np.isfinite(gam.fit(x[:2], np.array([0, 1])).scores(x)).all()


def made(n):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeflmnorst") for _ in range(r.randrange(2, 9)))
    docs, labels = [], []
    for d in range(n):
        w = [word() for _ in range(r.randrange(20, 120))]
        bad = d % 4 == 0
        docs.append((d, " ".join(x + "###" if bad and r.random() < 0.7 else x for x in w), "x", 0.5))
        if d % 3:
            labels.append((d, int(not bad)))
    return docs, labels


def test_op13(spark):
    docs, labels = made(600)
    extra = [(600, None, "x", 0.1), (601, "", "x", 0.1), (None, docs[5][1], None, None), (5, docs[5][1], "x", None), (5, docs[5][1], "x", None), (602, "long " * 400_000, "x", 0.0)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, features string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    rows = gam.op13(d.repartition(5), lab).collect()
    assert len(rows) == 606 and sorted(rows[0].asDict()) == ["doc_id", "held_out", "predicted", "score"]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert r["predicted"] == (r["doc_id"] % 4 != 0)
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1 and len({r["score"] for r in rows if r["doc_id"] in (600, 601)}) == 1
    assert {r["doc_id"]: r["score"] for r in gam.op13(d.coalesce(1), lab).collect()} == {r["doc_id"]: r["score"] for r in rows}  # reruns agree
    assert gam.op13(d.limit(0), lab).collect() == []
    assert {r["predicted"] for r in gam.op13(d, lab.limit(0)).collect()} == {1}


def test_held_out_labels_are_not_read(spark):
    docs, labels = made(300)
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    turned = [(i, 1 - q) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q) for i, q in labels]
    one, two = ({r["doc_id"]: r["score"] for r in gam.op13(d, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, turned))
    assert one == two
