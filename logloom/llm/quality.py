"""Quality rules: plain counts with fixed limits, then logistic regression on hashed word and character n-grams.

The model is fitted on a bounded sample of labelled rows (TRAIN_ROWS for each label, TRAIN_BYTES in all), four fifths
for the weights and one for Platt's calibration. Texts are scored in Arrow batches: a text's logit is the mean weight
of its words plus that of its 4-byte n-grams, so scoring is table look-ups and sums.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import arrow_map, bounded_sample

TRAIN_ROWS, TRAIN_BYTES = 1500, 12 << 20
WORD_BITS, CHAR_BITS = 16, 17
#: Fixed limits: fewest words, most percent of words in repeated 3-word windows, least probability of quality 1.
LEAST_WORDS, MOST_REPEAT_PERCENT, LEAST_PROBABILITY = 50, 50, 0.5
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CONT = (np.arange(256) & 0xC0) != 0x80
STEPS, RATE, L2 = 150, 1.0, 1e-6


def chars4(buf: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of the 4 bytes from each place."""
    b = buf.astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.uint32)
    h = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return h * np.uint32(2654435761) >> np.uint32(32 - bits)


def _words(w: tc.Words, bits: int) -> np.ndarray:
    return (w.hashes() >> np.uint64(64 - bits)).astype(np.int64)


def repeated_words(w: tc.Words, hashes: np.ndarray, k: int = 3) -> np.ndarray:
    """For each text, words in k-word windows found twice or more in it."""
    h, fits, doc = w.windows(hashes, k), w.fits(k), w.doc()
    if not fits.any():
        return np.zeros(w.piece.n, np.int64)
    at = np.flatnonzero(fits)
    key = tc.by_text(h[at], doc[at])
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    diff = np.zeros(len(doc) + 1, np.int64)
    np.add.at(diff, at[twice], 1)
    np.add.at(diff, at[twice] + k, -1)
    return tc.per_text(np.cumsum(diff)[:-1] > 0, w.off[:-1], w.off[1:])


def duplicate_lines(w: tc.Words) -> np.ndarray:
    """For each text, lines with a word that equal an earlier line of it."""
    p = w.piece
    cut = np.flatnonzero(p.buf == 10)
    begin, end = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(p.buf)]))
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[has], end[has]
    doc = np.searchsorted(p.begin, begin, "right") - 1
    pre = tc.prefix_sum(p.buf, tc.BYTE_POWERS)
    h = tc.mix(tc.range_hash(pre, begin, end, tc.BYTE_POWERS) ^ (end - begin).astype(np.uint64))
    key = tc.by_text(h, doc)
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    return np.bincount(doc[again], minlength=p.n).astype(np.int64)


class Model:
    def __init__(self, word: np.ndarray, char: np.ndarray, bias: float, scale: float, shift: float) -> None:
        self.word, self.char, self.bias, self.scale, self.shift = word, char, bias, scale, shift

    def logits(self, p: tc.Piece, w: tc.Words) -> np.ndarray:
        words = tc.per_text(self.word[_words(w, WORD_BITS)], w.off[:-1], w.off[1:]) / np.maximum(1, w.count)
        n = np.maximum(0, p.end - p.begin - 3)
        v = self.char[chars4(p.buf, CHAR_BITS)]
        chars = tc.per_text(v, np.minimum(p.begin, len(v)), np.minimum(p.begin + n, len(v))) / np.maximum(1, n)
        return self.bias + words + chars

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -60, 60)))


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: text, feature, share."""
    parts = []
    base = 0
    for p in tc.pieces(pa.array(texts, pa.string())):
        w = tc.Words(p, tc.SPACE_WORD)
        grams = chars4(p.buf, CHAR_BITS).astype(np.int64)
        n = np.maximum(0, p.end - p.begin - 3)
        cw, cg = w.doc(), np.repeat(np.arange(p.n), n)
        at = np.repeat(p.begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(cg))
        doc = np.concatenate((cw, cg))
        feature = np.concatenate((_words(w, WORD_BITS), grams[at] + (1 << WORD_BITS)))
        share = np.concatenate((1 / np.maximum(1, w.count)[cw], 1 / np.maximum(1, n)[cg]))
        key, inverse = np.unique(doc << 20 | feature, return_inverse=True)
        parts.append(((key >> 20) + base, key & (1 << 20) - 1, np.bincount(inverse, share)))
        base += p.n
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Weights by full-batch Adam on class-balanced log loss. With no rows, or one label only, the model says 1 to all."""
    size = (1 << WORD_BITS) + (1 << CHAR_BITS)
    y = np.asarray(labels, np.float64)
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << WORD_BITS, np.float32), np.zeros(1 << CHAR_BITS, np.float32), 0.0, 0.0, 4.0 if not len(y) or y[0] else -4.0)
    doc, feature, share = _rows(texts)
    test = np.arange(len(y)) % 5 == 4
    if len(set(y[test])) < 2 or len(set(y[~test])) < 2:
        test = np.zeros(len(y), bool)
    weight = np.where(test, 0, np.where(y == 1, 0.5 / max(1, (y[~test] == 1).sum()), 0.5 / max(1, (y[~test] == 0).sum())))
    x, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(doc, share * x[feature], len(y)) + x[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        grad = np.append(np.bincount(feature, share * g[doc], size), g.sum()) + L2 * x
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    z = np.bincount(doc, share * x[feature], len(y)) + x[-1]
    use = test if test.any() else ~test
    a, c = 1.0, 0.0
    target = np.where(y[use] == 1, ((y[use] == 1).sum() + 1) / ((y[use] == 1).sum() + 2), 1 / ((y[use] == 0).sum() + 2))
    for _ in range(200):  # Platt's scaling by Newton's method
        q = 1 / (1 + np.exp(-np.clip(a * z[use] + c, -60, 60)))
        s = np.maximum(q * (1 - q), 1e-9)
        h = np.array([[(s * z[use] ** 2).sum() + 1e-6, (s * z[use]).sum()], [(s * z[use]).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [((q - target) * z[use]).sum(), (q - target).sum()])
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
    return Model(x[: 1 << WORD_BITS].astype(np.float32), x[1 << WORD_BITS : size].astype(np.float32), float(x[-1]), float(a), float(c))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    sample = bounded_sample(docs, labels.where("quality in (0, 1)"), "quality", rows, most_bytes)
    return fit([r["text"] for r in sample], [r["quality"] for r in sample])


NEW = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("probability", T.DoubleType())]


def _scored(model: Model):
    def f(col):
        out = [[] for _ in NEW]
        for p in tc.pieces(col):
            w = tc.Words(p, tc.SPACE_WORD)
            h = w.hashes()
            chars = tc.SPACE_WORD[p.buf] & _CONT[p.buf]
            for k, x in enumerate((w.count, tc.per_text(chars, p.begin, p.end), tc.per_text(SYMBOLS[p.buf], p.begin, p.end), duplicate_lines(w), repeated_words(w, h), model.probability(model.logits(p, w)))):
                out[k].append(x)
        return [pa.array(np.concatenate(x) if x else [], pa.int64() if k < 5 else pa.float64()) for k, x in enumerate(out)]

    return f


def score_quality(docs: DataFrame, model: Model, least_probability: float = LEAST_PROBABILITY) -> DataFrame:
    """docs with the base counts, probability of quality 1, base_failed and kept.

    A null text has no words and fails the base rules, as does an empty one. Rows are judged one by one: repeated rows
    and ties get equal results. Other columns stay, save those of the new names. An empty table gives an empty result;
    a model fitted without labels of both kinds keeps all that passes the base rules.
    """
    d = arrow_map(docs.drop("base_failed", "kept"), NEW, partial(_scored, model))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= least_probability))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
