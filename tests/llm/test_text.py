"""Operators that work row by row, against plain versions in Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import decontam, langid, quality, textcore as tc, tokencount, toxicity

SPACE = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def texts(n, seed, pool=None):
    r = random.Random(seed)
    pool = pool or ["a", "b", "the", "of", "é", "中文", "x1", "Zz", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", " ", ".", ",", "#", "<b>", "\x00", "!", "the end"]
    return ["", " ", "\n"] + ["".join(r.choice(pool) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(60))) for _ in range(n)] + ["w " * 5000]


def pieces(ts, **k):
    return list(tc.pieces(pa.array(ts, pa.string()), **k))


@pytest.mark.parametrize("most", [1, 100, 1 << 20])
def test_words(most):
    ts = texts(200, 1)
    for bytes_, rx, low in ((tc.SPACE_WORD, SPACE, False), (tc.ALNUM_WORD, ALNUM, True)):
        got = []
        for p in pieces(ts, most=most):
            w = tc.Words(p, bytes_, lower=low)
            got += [[w.buf[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.off[:-1], w.off[1:], strict=True)]
        assert got == [rx.findall(t.translate(LOWER) if low else t) for t in ts]


def test_hashes_and_windows():
    ts = texts(300, 2)
    seen, wins = {}, {}
    for p in pieces(ts, most=3000):
        w = tc.Words(p, tc.SPACE_WORD)
        h = w.hashes()
        for s, e, x in zip(w.start, w.end, h.tolist(), strict=True):
            assert seen.setdefault(w.buf[s:e].tobytes(), x) == x
        for i in np.flatnonzero(w.fits(3)):
            key = tuple(w.buf[s:e].tobytes() for s, e in zip(w.start[i : i + 3], w.end[i : i + 3], strict=True))
            x = int(w.windows(h, 3)[i])
            assert wins.setdefault(key, x) == x
    assert len(set(seen.values())) == len(seen) and len(set(wins.values())) == len(wins)


def test_null_is_empty():
    p = pieces([None, "a", None])[0]
    assert tc.Words(p, tc.SPACE_WORD).count.tolist() == [0, 1, 0]


def test_quality_counts():
    ts = texts(300, 3)
    out = quality._scored(quality.fit([], []))(pa.array(ts, pa.string()))
    for k, t in enumerate(ts):
        w = SPACE.findall(t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines, dup, seen = t.split("\n"), 0, set()
        for x in lines:
            dup += bool(SPACE.search(x)) and x in seen
            seen.add(x)
        assert [o[k].as_py() for o in out[:5]] == [len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(repeated)]


def test_quality_lines_of_one_letter():
    ts = ["\n".join(map(chr, range(33, 127)))] * 140
    out = quality._scored(quality.fit([], []))(pa.array(ts, pa.string()))
    assert out[3].to_pylist() == [0] * len(ts) and out[4].to_pylist() == [0] * len(ts)


def test_quality_learns():
    r = random.Random(4)
    good = [" ".join(r.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(r.choice(["LOREM!!", "IPSUM!!", "DOLOR%%"]) for _ in range(80)) for _ in range(60)]
    m = quality.fit(good[:40] + bad[:40], [1] * 40 + [0] * 40)
    p = np.array(quality._scored(m)(pa.array(good[40:] + bad[40:], pa.string()))[5])
    assert (p[:20] > 0.5).all() and (p[20:] < 0.5).all()


def test_quality_verdict_by_plain_sums():
    """The probability from each word's and each four bytes' weight, text by text."""
    r = random.Random(21)
    word = [" ".join(r.choice(["lorem", "ipsum", "dolor", "AMET!!", "x"]) for _ in range(r.randrange(3, 70))) for _ in range(80)]
    m = quality.fit(word, [int("AMET" not in t[:60]) for t in word])
    ts = [*word[:20], "", "é", "ab", "lorem\n\tipsum  中文中文"]
    got = quality._scored(m)(pa.array(ts, pa.string()))[5].to_pylist()
    for t, p in zip(ts, got, strict=True):
        b = t.encode()
        own = [m.word[quality._words(tc.Words(pieces([w])[0], tc.SPACE_WORD), quality.WORD_BITS)[0]] for w in SPACE.findall(t)]
        chars = [m.char[quality.chars4(np.frombuffer(b[i : i + 4], np.uint8), quality.CHAR_BITS)[0]] for i in range(len(b) - 3)]
        z = m.bias + sum(map(float, own)) / max(1, len(own)) + sum(map(float, chars)) / max(1, len(chars))
        assert abs(p - 1 / (1 + np.exp(-(m.scale * z + m.shift)))) < 1e-4


def test_toxicity_by_plain_means():
    """Scores from each word's bag of subwords, word by word and passage by passage."""
    r = random.Random(22)
    m = toxicity.Model(np.array([r.gauss(0, 1) for _ in range(1 << toxicity.BITS)], np.float32), -0.7)

    def bucket(gram):
        h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
        h = (h + gram[0]) & 0xFFFFFFFF
        for c in gram[1:]:
            h = (h * 0x01000193 + c) & 0xFFFFFFFF
        return ((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - toxicity.BITS

    def plain(t):
        words, kept = [w.encode().lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode()) for w in SPACE.findall(t)], []
        for i, w in enumerate(words):
            if not i or words[i - 1] != w:
                whole = int(tc.Words(pieces([w.decode()])[0], tc.SPACE_WORD).hashes()[0]) >> 64 - toxicity.BITS
                padded = b" " + w + b" "
                bag = [whole] + [bucket(padded[k : k + n]) for n in toxicity.GRAMS for k in range(len(padded) - n + 1)]
                kept.append(sum(float(m.value[x]) for x in bag) / len(bag))
        worst = max((sum(kept[k : k + toxicity.PASSAGE]) / toxicity.PASSAGE for k in range(0, len(kept), toxicity.PASSAGE)), default=0.0)
        return 1 / (1 + np.exp(-(m.bias + worst)))

    ts = [t for t in texts(40, 23) if "w w w" not in t]
    got = [x for p in pieces(ts) for x in m.scores(tc.Words(p, tc.SPACE_WORD))]
    assert np.allclose(got, [plain(t) for t in ts], atol=1e-5)


def test_toxicity_learns_misspellings():
    r = random.Random(5)
    plain = ["".join(r.choice(["ka", "to", "mi", "re", "su"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    text = lambda bad: " ".join(r.choice(["idiot", "idiots", "idiotic", "Idiot,"]) if bad and r.random() < 0.08 else r.choice(plain) for _ in range(100))
    y = [i % 2 for i in range(200)]
    m = toxicity.fit([text(b) for b in y], y, 0.5)
    score = lambda ts: m.scores(tc.Words(pieces(ts)[0], tc.SPACE_WORD))
    held = score([text(i % 2) for i in range(100)])
    assert ((held >= 0.5) == (np.arange(100) % 2 == 1)).mean() > 0.95
    assert (score(["", "a", "a b"]) < 0.5).all()
    assert score([" ".join(plain[:30]) + " idiott " + " ".join(plain[30:60])])[0] > score([" ".join(plain[:60])])[0]


def test_langid():
    r = random.Random(6)
    made = {k: [" ".join(r.choice(v) for _ in range(30)) for _ in range(40)] for k, v in {"x": ["the", "then", "than"], "y": ["der", "die", "und"], "z": ["où", "là", "été"]}.items()}
    m = langid.fit([t for v in made.values() for t in v[:30]], [k for k, v in made.items() for _ in v[:30]])
    said, score = langid._scored(m)(pa.array([v[30] for v in made.values()] + [None, "", "123 !!", ".", "½ ²", "③ Ⅷ"], pa.string()))
    assert said.to_pylist() == ["x", "y", "z"] + ["und"] * 6 and all(0 <= s <= 1 for s in score.to_pylist())
    assert langid._scored(langid.fit([], []))(pa.array(["abc"]))[0].to_pylist() == ["und"]


def test_langid_by_plain_kernels(monkeypatch):
    """Kernel values by sets of n-grams, and ridge regression on Nystrom features, without folding anything."""
    monkeypatch.setattr(langid, "LANDMARKS", 12)
    r = random.Random(24)
    pools = {"x": ["the", "then", "than"], "y": ["der", "die", "und"], "z": ["où", "là", "été"]}
    ts, ls = zip(*[(" ".join(r.choice(pools[k]) for _ in range(r.randrange(1, 12))), k) for k in pools for _ in range(15)], strict=True)
    m = langid.fit(list(ts), list(ls))

    def grams(t):
        t, out = t.lower(), []
        for n in langid.ORDERS:
            mask = np.zeros((len(langid.ORDERS), langid.SLOTS), bool)
            langid.present(t, mask)
            out.append(set(np.flatnonzero(mask[langid.ORDERS.index(n)])))
        return out

    def kernel(a, b):
        return sum(len(x & y) / np.sqrt(len(x) * len(y)) for x, y in zip(grams(a), grams(b), strict=True) if x and y) / len(langid.ORDERS)

    by = [[t for t, k in zip(ts, ls, strict=True) if k == n] for n in pools]
    marks = [b[k] for k in range(15) for b in by][:12]
    between = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(between)
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.array([[kernel(t, b) for b in marks] for t in ts]) @ root
    y = np.array([[1.0 if k == n else -1.0 for n in pools] for k in ls])
    w = np.linalg.solve(phi.T @ phi + langid.RIDGE * len(ts) * np.eye(phi.shape[1]), phi.T @ (y - y.mean(0)))
    new = ["the und", "où", "xx yy", "t"]
    want = np.array([[kernel(t, b) for b in marks] for t in new]) @ root @ w + y.mean(0)
    assert np.allclose(m.decide(new), want, atol=2e-3)


def test_wavelet_and_suffixes():
    r = np.random.default_rng(7)
    for n in (1, 2, 50, 400):
        seq = np.append(r.integers(1, 5, n), 0)
        order = decontam.suffix_array(seq)
        assert [tuple(seq[i:]) for i in order] == sorted(tuple(seq[i:]) for i in range(len(seq)))
        wm = decontam.WaveletMatrix(seq, 5)
        c, i = r.integers(0, 5, 100), r.integers(0, len(seq) + 1, 100)
        assert wm.rank(c, i).tolist() == [int((seq[:b] == a).sum()) for a, b in zip(c, i, strict=True)]


def test_fm_index_locates():
    r = np.random.default_rng(8)
    seq = r.integers(1, 4, 500)
    phrases = np.stack([seq[k : k + 6] for k in r.integers(0, 490, 30)])
    index = decontam.FMIndex(seq, 4)
    lo, hi = index.search(phrases, np.full(30, 6))
    for p, a, b in zip(phrases, lo, hi, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(495) if (seq[i : i + 6] == p).all()]


def test_contamination(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)] + [(3, "W1 w2; W3"), (50, None), (51, ""), (None, "w1 w2")]
    docs = []
    for d in range(80):
        t = " ".join(r.choice(vocab + ["zz"]) for _ in range(r.randrange(80)))
        if d % 3 == 0:
            t += "\n" + r.choice(items[:12])[1].upper() + "! " + t[:50]
        docs.append((d, t, "x"))
    docs += [(900, None, None), (None, "w1", "y"), (901, "", "z"), (5, docs[5][1], "copy")]
    wins = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER)) if i is not None else []
        for j in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[j : j + 13]), set()).add(str(i))
    want = []
    for i, t, _ in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(k) for k in wins}:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in wins:
                    hit |= set(range(j, j + size))
                    found |= wins[tuple(w[j : j + size])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string, n_words string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda x: str(x)
    assert sorted((tuple(x) for x in decontam.op9(d, b).collect()), key=key) == sorted(want, key=key)
    one, many = (sorted(map(str, decontam.find_contamination(d, b, block_bytes=n).collect())) for n in (1 << 20, 300))
    assert one == many
    assert decontam.op9(d, b.limit(0)).where("n_hit > 0").count() == 0 and decontam.op9(d.limit(0), b).count() == 0


def test_no_benchmark(spark):
    d = spark.createDataFrame([(1, "w1 w2"), (2, None), (1, "w1 w2")], "doc_id long, text string")
    for items in ([], [(None, "w1 w2"), (3, None)]):
        out = decontam.op9(d, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out) == [(1, 2, 0, 0, False)] * 2 + [(2, 0, 0, 0, False)]


def test_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    r = random.Random(10)
    pool = list("      \n\t\r\x0b\x1c\x85 ab'sS中é٣²𝔘.,!") + ["<|endoftext|>", "'re", "'LL", "the "] + [chr(r.randrange(1, 0x2FFF)) for _ in range(200)]
    ts = ["".join(r.choice(pool) for _ in range(r.randrange(40))) for _ in range(4000)] + ["x" * 5000, " " * 3000]
    t = Tokenizer.from_file(path)
    assert tokencount.counter(path)(ts) == [len(e.ids) for e in t.encode_batch(ts, add_special_tokens=False)]
    d = spark.createDataFrame([(1, "ab", 5), (2, None, 5), (None, "", None), (1, "ab", 5)], "doc_id long, text string, n_tokens int")
    out = tokencount.op10(d, path).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == [(0, 0, 0, False), (1, 2, 1, False), (1, 2, 1, False), (2, 0, 0, False)]
