"""Whitening and vector codes, against plain versions."""

import hashlib

import numpy as np
import pytest

from logloom.llm import vectorcodes, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, q string, key int, code string, _label int"


def table(spark, rows):
    """Rows (vec_id, embedding, label), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


def some_rows(n, dim, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim))
    rows = [(i, (centres[i % 5] * (1 + i % 3) + r.normal(size=dim) * 0.3).astype(np.float32).tolist(), None if i % 7 == 0 else i % 4) for i in range(n)]
    bad = [float("nan"), float("inf"), -float("inf"), None]
    rows += [(1000 + k, [1.0] * (dim - 1) + [b], 1) for k, b in enumerate(bad)] + [(1010, None, 1), (1011, [0.0] * (dim + 1), 0)]
    return rows + [rows[3], rows[3], (None, rows[4][1], None), (2000, rows[5][1], 2)]


def kept(rows, dim):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and np.isfinite(x) for x in r[1])]


@pytest.mark.parametrize("dim", [1, 3, 12, 40])
def test_whitening_by_plain_eigenvectors(spark, dim):
    rows = some_rows(120, dim)
    got = whitening.op11(table(spark, rows).repartition(5)).collect()
    use = kept(rows, dim)
    x = np.floor(np.array([r[1] for r in use], np.float64) * 1024) + 100000
    z = x - x.mean(0)
    v = z.T @ z / len(x)
    values, vecs = (a[..., ::-1] for a in np.linalg.eigh(v))
    m = min(8, dim)
    want = z @ vecs[:, :m] / np.sqrt(values[:m])
    deviation = [sum((len(use) * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(0), strict=True)) for r in x]
    assert len(got) == m * len(use) and {r["n"] for r in got} == {len(use)} and max(r["identity_error"] for r in got) < 1e-9
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((str(u[0]), d) for u, d in zip(use, deviation, strict=True))
    for k in range(m):
        own = sorted((r["deviation"], r["whitened"]) for r in got if r["component"] == k + 1)
        plain = sorted(zip(deviation, want[:, k], strict=True))
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(own, plain, strict=True)))
        assert np.allclose([a[1] * sign for a in own], [b[1] for b in plain], atol=1e-8)
        assert {round(r["explained"], 12) for r in got if r["component"] == k + 1} == {round(float(values[k] / np.trace(v)), 12)}


def test_whitening_of_little(spark):
    assert whitening.op11(table(spark, [])).collect() == []
    assert whitening.op11(table(spark, [(1, None, 1), (2, [], 1)])).collect() == []
    assert whitening.op11(table(spark, [(1, [0.5, 0.25], 1)] * 3)).collect() == []  # no row differs
    flat = whitening.op11(table(spark, [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)])).collect()  # on one line
    assert {r["component"] for r in flat} == {1} and len(flat) == 9 and abs(flat[0]["explained"] - 1) < 1e-12


@pytest.mark.parametrize("spectrum", [np.arange(1, 61.0), np.geomspace(1e-6, 1e6, 60), np.repeat([1.0, 2.0, 3.0], 20), 1 + np.arange(60) * 1e-5])
def test_lobpcg_certifies(spectrum):
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(60, 60)))[0]
    a = q * spectrum @ q.T
    passes = []
    values, vecs, sizes, _ = whitening.lobpcg(lambda b: passes.append(b.shape) or a @ b, 60, 8)
    top = np.sort(spectrum)[::-1][:8]
    assert np.allclose(values, top, rtol=1e-11) and np.allclose(vecs.T @ vecs, np.eye(8), atol=1e-12)
    assert np.linalg.norm(a @ vecs - vecs * values, axis=0).max() <= 2e-11 * top[0] and sizes.max() <= whitening.CERTIFIED * top[0] and len(passes) < 60


def test_lobpcg_does_not_pass_uncertified():
    a = np.diag(np.linspace(1, 2, 500))
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: a @ b, 500, 8, most_steps=3)


def test_deviation_beyond_a_long():
    assert whitening._deviations(np.array([[3 * 10**9, 10**9], [2 * 10**9, 2 * 10**9], [1, 2]])) == [None, 8 * 10**18, 5]


def plain_codes(rows, dim, entries=256, parts=4, rounds=4):
    use = sorted(kept(rows, dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-dim // parts)
    vec = [[int(np.floor(1024 * float(x))) for x in r[1]] + [0] * (width * parts - dim) for r in use]
    part = [[v[p * width : (p + 1) * width] for v in vec] for p in range(parts)]
    books = [list(part[p][:entries]) for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for v in part[p]:
                of.setdefault(near(p, v)[1], []).append(v)
            for i, vs in of.items():
                books[p][i] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [[near(p, part[p][k]) for p in range(parts)] for k in range(len(use))]
    errors = [sum(f[0] for f in fs) for fs in found]
    by = {}
    for r, e in zip(use, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((str(r[0]), "".join(f"{f[1]:02x}" for f in fs), e, by[r[2]], sha) for r, fs, e in zip(use, found, errors, strict=True)))


@pytest.mark.parametrize(("n", "dim"), [(9, 8), (300, 12), (300, 5), (40, 3)])
def test_codes_by_plain_rounds(spark, n, dim):
    rows = some_rows(n, dim)
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vectorcodes.op12(table(spark, rows).repartition(4)).collect())
    assert got == plain_codes(rows, dim)


def test_codes_of_little(spark):
    assert vectorcodes.op12(table(spark, [])).collect() == []
    assert vectorcodes.op12(table(spark, [(1, None, 1)])).collect() == []
    got = vectorcodes.op12(table(spark, [(1, [], 1), (2, [], None)])).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]


def test_large_entries_end_with_an_error(spark):
    with pytest.raises(Exception, match="or more in size"):
        vectorcodes.op12(table(spark, [(1, [1e9, 0.0, 0.0, 0.0], 1)])).collect()


@pytest.mark.parametrize("spread", [0, 3, 1000, 1 << 26])
@pytest.mark.parametrize("width", [1, 2, 7, 16])
def test_bounds_drop_no_nearest_entry(spread, width):
    r = np.random.default_rng(width)
    entries = r.integers(-spread, spread + 1, (256, width))
    v = np.concatenate((r.integers(-spread, spread + 1, (200, width)), entries[::5], entries[1:100:7] + 1))
    d = ((v[:, None, :] - entries[None]) ** 2).sum(2)
    code, best, measured = vectorcodes.Codebook(entries).nearest(v)
    assert (best == d.min(1)).all() and (code == d.argmin(1)).all()
    own, theirs = vectorcodes.Blocks(v, 1), vectorcodes.Blocks(entries, 1)
    assert (own.bounds(theirs) <= d).all()


def test_bounds_spare_most_measures():
    r = np.random.default_rng(0)
    entries = np.repeat(r.integers(-500, 500, (64, 1)), 16, 1) * np.arange(1, 17) // 8 + r.integers(-20, 20, (64, 16))
    v = entries[r.integers(0, 64, 2000)] + r.integers(-10, 10, (2000, 16))
    assert vectorcodes.Codebook(entries).nearest(v)[2] < 0.25 * 64 * 2000


def test_label_sums_in_salted_parts(spark):
    d = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5, i) for i in range(200)] + [(7, 2, 7)] * 3, "key long, label int, error long")
    few, many = (sorted(map(tuple, vectorcodes.with_label_sums(d, "label", "error", "total", most).collect()), key=str) for most in (100, 1))
    assert few == many and len(few) == 203 and {r[3] for r in few if r[1] is None} == {sum(range(0, 200, 3))}


def test_mixed_lengths_keep_the_most_frequent(spark):
    rows, dim = vectors.kept_vectors(table(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0), (3, [0.5, 0.5], 0), (4, [2.0, 2.0, 2.0], 0)]), "vec_id", "embedding")
    assert dim == 2 and sorted(r["key"] for r in rows.collect()) == [2, 3]
