"""Toxicity: a word is the mean of the vectors of its bag of subwords, a passage the mean of its words (a short one padded with zeros), and a linear softmax over it gives the score.

Vectors and softmax are trained jointly in numpy on a bounded sample of labelled rows. Subwords are the word itself and
its 3 to 5-byte n-grams with the bounds of the word, hashed to buckets, so that misspellings share most of them. A text
is as toxic as its worst passage of PASSAGE words; words that repeat the one before are passed over. Training begins
from how far a subword's texts of the two labels differ beyond chance, then follows the worst passage of each text
(and, for label 0, all others), stops on a fifth of the sample kept aside, and calibrates on that fifth. For scoring,
a bucket's vector and the softmax fold into one number, which changes no result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import arrow_map, bounded_sample, crc_mod, give_back

TRAIN_ROWS, TRAIN_BYTES = 1000, 4 << 20
BITS, DIM, PASSAGE = 17, 8, 16
GRAMS = (3, 4, 5)
STEPS, RATE, DAMP, SOFT, SURE, PATIENCE, SEED = 48, 0.02, 0.03, 2.0, 1.0, 8, 20240
#: Subwords whose gradients are summed at once.
AT_ONCE = 1 << 18
#: A subword of fewer texts than this share of them takes no part in training.
LEAST_SHARE = 0.003
_FOLD = np.where(tc.SPACE_WORD, tc.LOWER, 32).astype(np.uint8)


class Bags:
    """Subword buckets of the words of a piece. For each n, the n-grams of word i begin at first[n][i] .. first[n][i] + count[n][i] - 1."""

    def __init__(self, w: tc.Words) -> None:
        b = np.concatenate(([32], _FOLD[w.piece.buf], [32])).astype(np.uint32)  # the text's byte i is at i + 1
        self.bucket, self.first, self.count = {}, w.start, {}
        size = w.end - w.start
        for n in GRAMS:
            if len(b) >= n:
                h = np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF) + b[: len(b) - n + 1]
                for j in range(1, n):
                    h = h * np.uint32(0x01000193) + b[j : len(b) - n + 1 + j]
                self.bucket[n] = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
            else:
                self.bucket[n] = np.zeros(0, np.uint32)
            self.count[n] = np.maximum(0, size + 3 - n)
        lowered = tc.Words.__new__(tc.Words)
        lowered.__dict__ |= w.__dict__ | {"buf": _FOLD[w.piece.buf]}
        self.word = (lowered.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
        self.size = 1 + sum(self.count.values())

    def flat(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the given words, word after word, and where each word's begin."""
        sizes = self.size[words]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        out, at = np.empty(begin[-1], np.int64), begin[:-1].copy()
        out[at] = self.word[words]
        at += 1
        for n in GRAMS:
            c = self.count[n][words]
            k = np.repeat(at - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
            out[k] = self.bucket[n][np.repeat(self.first[words] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())]
            at += c
        return out, begin[:-1]

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Sum of value over each word's bag."""
        s = value[self.word].astype(np.float64)
        for n in GRAMS:
            c = np.concatenate(([0], np.cumsum(value[self.bucket[n]], dtype=np.float64)))
            lo = np.minimum(self.first, len(c) - 1)  # a short word at the very end has no n-gram to begin at
            s += c[lo + self.count[n]] - c[lo]
        return s


def passages(count: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words: first word of each passage (with the total last), and first passage of each text."""
    n = -(-count // size)
    first = np.concatenate(([0], np.cumsum(n)))
    off = np.concatenate(([0], np.cumsum(count)))
    begin = np.repeat(off[:-1], n) + (np.arange(first[-1]) - np.repeat(first[:-1], n)) * size
    return np.append(begin, off[-1]), first


def fresh_words(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words that differ from the word before them in their text."""
    fresh = np.ones(len(ids) + 1, bool)
    fresh[1:-1] = ids[1:] != ids[:-1]
    fresh[off[:-1]] = True
    return fresh[:-1]


class Model:
    def __init__(self, value: np.ndarray, bias: float) -> None:
        self.value, self.bias = value, bias

    def scores(self, w: tc.Words) -> np.ndarray:
        out = np.full(w.piece.n, self.bias)
        if len(w.start):
            bags = Bags(w)
            fresh = fresh_words(bags.word, w.off)
            begin, first = passages(tc.per_text(fresh, w.off[:-1], w.off[1:]))
            word = np.concatenate(([0], np.cumsum((bags.sums(self.value) / bags.size)[fresh])))
            mean = (word[begin[1:]] - word[begin[:-1]]) / PASSAGE
            has = w.count > 0
            out[has] += np.maximum.reduceat(mean, first[:-1][has])
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, float], float]:
    """Slope and offset that fit weighted labels by logistic regression, and the loss."""
    a, c = 1.0, 0.0
    weight = weight / weight.sum()
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a * z + c, -60, 60)))
        s, d = weight * np.maximum(q * (1 - q), 1e-9), weight * (q - y)
        h = np.array([[(s * z * z).sum() + 1e-9, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, [(d * z).sum(), d.sum()])
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
    q = np.clip(1 / (1 + np.exp(-np.clip(a * z + c, -60, 60))), 1e-9, 1 - 1e-9)
    return (float(a), float(c)), float(-(weight * np.where(y == 1, np.log(q), np.log(1 - q))).sum())


def _ranges(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    n = sizes.astype(np.int64)[which]
    return np.repeat(np.asarray(starts)[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def fit(texts: list[str], labels: list[int], prior: float = 0.5) -> Model:
    """prior: share of label 1 among all labelled rows. With no rows, or one label only, a constant: that label, or 0."""
    y = np.asarray(labels, np.float64)
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 6.0 if len(y) and y[0] else -6.0)
    flat, starts, sizes, ids, counts, known = [], [], [], [], [], {}
    for p in tc.pieces(pa.array(texts, pa.string()), 1 << 18):
        w = tc.Words(p, tc.SPACE_WORD)
        bags = Bags(w)
        low = tc.Words.__new__(tc.Words)
        low.__dict__ |= w.__dict__ | {"buf": _FOLD[p.buf]}
        uniq, at, inverse = np.unique(low.hashes(), return_index=True, return_inverse=True)
        no = np.array([known.setdefault(int(u), len(known)) for u in uniq], np.int64)
        new = no >= len(starts)
        f, s = bags.flat(at[new])
        base = sum(map(len, flat))
        order = np.argsort(no[new])
        flat.append(f.astype(np.int32))
        starts += (s[order] + base).tolist()
        sizes += bags.size[at[new]][order].tolist()
        ids.append(no[inverse])
        counts.append(w.count)
    del known, w, bags, low  # memory follows the arrays that are trained on
    flat, ids, counts = np.concatenate(flat), np.concatenate(ids), np.concatenate(counts)
    sizes = np.array(sizes, np.float32)
    word_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes.astype(np.int64))
    if not (np.diff(starts) == sizes[:-1]).all():  # in the order of `starts`, for reduceat
        flat = flat[_ranges(starts, sizes, np.arange(len(sizes)))]
        starts = np.concatenate(([0], np.cumsum(sizes[:-1].astype(np.int64))))
    off = np.concatenate(([0], np.cumsum(counts)))
    fresh = fresh_words(ids, off)
    ids, counts = ids[fresh], tc.per_text(fresh, off[:-1], off[1:])
    begin, first = passages(counts)
    of_doc = np.repeat(np.arange(len(counts)), np.diff(first))
    of_passage = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    length = np.full(len(begin) - 1, PASSAGE, np.float32)
    test = np.arange(len(y)) % 5 == 4
    texts_of = np.zeros((3, 1 << BITS), np.int64)  # texts with a subword: label 0, label 1 (to learn from), all
    off = np.concatenate(([0], np.cumsum(counts)))
    for i in range(len(counts)):  # text by text, so that memory follows one text
        own = np.unique(flat[_ranges(starts, sizes, np.unique(ids[off[i] : off[i + 1]]))])
        texts_of[2, own] += 1
        if not test[i]:
            texts_of[int(y[i]), own] += 1
    common = texts_of[2] >= max(3, LEAST_SHARE * len(y))
    stay = common[flat]
    flat, word_of = flat[stay], word_of[stay]
    starts = np.searchsorted(word_of, np.arange(len(sizes)))
    some = np.flatnonzero(np.diff(np.append(starts, len(flat))))  # words with a common subword
    rng = np.random.default_rng(SEED)
    # vectors begin along one axis, as far as a subword's texts of the two labels differ beyond chance
    df = texts_of[:2] + 1.0
    odds = np.log(df[1] / (1 + (~test & (y == 1)).sum())) - np.log(df[0] / (1 + (~test & (y == 0)).sum()))
    odds = np.sign(odds) * np.maximum(0, np.abs(odds) - SURE * np.sqrt(1 / df[0] + 1 / df[1])) * common
    axis = rng.normal(size=DIM)
    axis /= np.linalg.norm(axis)
    par = [(odds[:, None] * axis + rng.normal(size=(1 << BITS, DIM)) * 0.01 * common[:, None]).astype(np.float32), np.stack((-SOFT * axis, SOFT * axis), 1).astype(np.float32), np.zeros(2, np.float32)]
    mom = [[np.zeros_like(x), 0.0] for x in par]
    share = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
    balance = np.where(test, 0, np.where(y == 1, 0.5 / max(1, (~test & (y == 1)).sum()), 0.5 / max(1, (~test & (y == 0)).sum())))
    has = counts > 0
    new_text = np.concatenate(([True], np.diff(of_doc) > 0))
    best, since, kept, scale = np.inf, 0, par, (0.0, 0.0)
    for t in range(1, STEPS + 1):
        e, soft, bias = par
        word = np.zeros((len(sizes), DIM), np.float32)
        for d in range(DIM):  # one dimension at a time: a gather of all would be the largest array
            word[some, d] = np.add.reduceat(e[:, d][flat], starts[some]) / sizes[some]
        vec = np.add.reduceat(word[ids], begin[:-1]) / length[:, None]
        z = vec @ soft + bias
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        worst = np.maximum.reduceat(z[:, 1] - z[:, 0], first[:-1][has])
        top = np.lexsort((z[:, 0] - z[:, 1], of_doc))[new_text]
        ac, loss = platt(worst[test[has]], y[has & test], share[has & test])
        since = 0 if loss < best - 1e-5 else since + 1
        if not since:
            best, kept, scale = loss, [x.copy() for x in par], ac
        elif since > PATIENCE:
            break
        own = of_doc[top]
        use = np.where(y == 1, 0, balance / np.maximum(1, np.diff(first)) / 2)[of_doc]
        use[top] += np.where(y[own] == 1, 1, 0.5) * balance[own]
        tok = np.flatnonzero((use > 0)[of_passage])
        g = ((q - np.stack((1 - y, y), 1)[of_doc]) * use[:, None]).astype(np.float32)
        dvec = g @ soft.T / length[:, None]
        grads = [np.empty_like(e), vec.T @ g, g.sum(0)]
        for d in range(DIM):
            dword = np.bincount(ids[tok], dvec[of_passage[tok], d], len(sizes)) / sizes
            grads[0][:, d] = sum(np.bincount(flat[lo : lo + AT_ONCE], dword[word_of[lo : lo + AT_ONCE]], 1 << BITS) for lo in range(0, len(flat), AT_ONCE)) * common
        for x, mv, dx in zip(par, mom, grads, strict=True):
            mv[0] = 0.9 * mv[0] + 0.1 * dx
            mv[1] = 0.98 * mv[1] + 0.02 * dx * dx
            size = np.sqrt(mv[1] / (1 - 0.98**t))
            x -= RATE * (mv[0] / (1 - 0.9**t)) / (size + DAMP * size.max() + 1e-12)
    e, soft, bias = kept
    return Model((e @ (soft[:, 1] - soft[:, 0])).astype(np.float32) * scale[0], float(bias[1] - bias[0]) * scale[0] + scale[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """From labelled rows whose crc32(doc_id) modulo 5 is not 0: at most `rows` of each label and most_bytes of text."""
    keys = labels.where("toxic in (0, 1)").where(crc_mod(F.col("doc_id"), 5) != 0)
    sample = bounded_sample(docs, keys, "toxic", rows, most_bytes)
    model = fit([r["text"] for r in sample], [r["toxic"] for r in sample], keys.agg(F.avg("toxic")).first()[0] or 0.0)
    give_back()
    return model


def _scored(model: Model):
    def f(col):
        out = [model.scores(tc.Words(p, tc.SPACE_WORD)) for p in tc.pieces(col)]
        return [pa.array(np.concatenate(out) if out else [], pa.float64())]

    return f


def score_toxicity(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with a double from 0 to 1. Null and empty texts have the score of no words at all; each row is scored by itself; a column called `into` is replaced; an empty table gives an empty result."""
    return arrow_map(docs, [T.StructField(into, T.DoubleType())], partial(_scored, model))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = score_toxicity(docs.select("doc_id", "text"), train(docs, labels))
    return d.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
