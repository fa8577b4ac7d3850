"""Quality classifier: a generalised additive model with pairwise interactions over the shape of a text.

A text is described by shares and sizes that need no vocabulary (letters, symbols, repeats, lengths of words and lines).
Each feature is cut at quantiles into bins. Boosting goes round the features; each turn grows a shallow tree over one
feature's bins and adds a part of it to that feature's table. Then the pairs whose quadrants explain most of what is left
get tables of their own in the same way. A score is a sum of table look-ups, so its parts can be read off the tables.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import arrow_map, crc_mod
from .quality import SYMBOLS, duplicate_lines, repeated_words

#: Labelled rows that are learned from, for each label.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 16, 12
CYCLES, PAIR_CYCLES, RATE, RIDGE, LEAVES, LEAST_HESSIAN, PATIENCE = 160, 60, 0.15, 1.0, 4, 0.5, 12

_byte = np.arange(256)


def _of(chars: bytes) -> np.ndarray:
    return np.isin(_byte, np.frombuffer(chars, np.uint8))


UPPER, LOWER, DIGIT, LEAD = (_byte >= 65) & (_byte <= 90), (_byte >= 97) & (_byte <= 122), (_byte >= 48) & (_byte <= 57), (_byte & 0xC0) != 0x80
HIGH, STOP, MARK, BRACKET, JOINT = _byte >= 0xC0, _of(b".,;:"), _of(b"!?"), _of(b"()[]{}\"'`"), _of(b"-_/\\=@+~^")
FEATURES = (
    "words", "chars_a_word", "spread_of_lengths", "longest_word", "symbols", "marks", "stops", "brackets", "joints", "digits", "capitals", "beyond_ascii", "blanks",
    "words_a_line", "repeated_lines", "repeated_windows", "same_as_before", "distinct_words", "most_frequent_word", "words_before_stops", "capital_words",
)


def distinct(w: tc.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its distinct words and the places of its most frequent word."""
    n, doc = w.piece.n, w.doc()
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    key = tc.by_text(hashes, doc)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    of, size = doc[order[first]], np.diff(np.append(first, len(key)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, size)
    return np.bincount(of, minlength=n), most


def features(p: tc.Piece) -> np.ndarray:
    """One row of FEATURES for each text of a piece; an empty text has zeros."""
    w = tc.Words(p, tc.SPACE_WORD)
    h, n, doc = w.hashes(), w.count, w.doc()
    of = lambda table: tc.per_text(table[p.buf], p.begin, p.end)
    chars, letters = of(LEAD), np.maximum(1, of(UPPER) + of(LOWER))
    lead = np.concatenate(([0], np.cumsum(LEAD[p.buf])))
    size = lead[w.end] - lead[w.start]
    some, each = np.maximum(1, n), np.maximum(1, chars)
    total = tc.per_text(size, w.off[:-1], w.off[1:])
    spread = np.sqrt((n * tc.per_text(size**2, w.off[:-1], w.off[1:]) - total**2) / some.astype(np.float64) ** 2)
    longest = np.zeros(p.n)
    np.maximum.at(longest, doc, size)
    lines = of(_byte == 10) + 1
    same = np.zeros(len(doc), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    kinds, most = distinct(w, h)
    at_end, at_start = w.buf[w.end - 1] if len(doc) else w.buf[:0], w.buf[w.start]
    share = lambda flags: tc.per_text(flags.astype(np.int64), w.off[:-1], w.off[1:]) / some
    out = (
        np.log1p(n), total / some, spread, np.log1p(longest), of(SYMBOLS) / each, of(MARK) / each, of(STOP) / each, of(BRACKET) / each, of(JOINT) / each, of(DIGIT) / each, of(UPPER) / letters,
        of(HIGH) / each, of(~tc.SPACE_WORD) / each, np.log1p(n / lines), duplicate_lines(w) / lines, repeated_words(w, h) / some, share(same), kinds / some, most / some, share(STOP[at_end]), share(UPPER[at_start]),
    )
    return np.stack([np.where(n > 0, x, 0.0) for x in out], 1)


class Model:
    def __init__(self, edges: list[np.ndarray], bias: float, tables: np.ndarray, pairs: list[tuple[int, int]], pair_tables: np.ndarray) -> None:
        self.edges, self.bias, self.tables, self.pairs, self.pair_tables = edges, bias, tables, pairs, pair_tables

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), np.int64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[coarse(b[:, i]), coarse(b[:, j])]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x))

    def parts(self) -> list[tuple[str, float]]:
        """How far each feature and pair can move a logit, largest first."""
        own = [(FEATURES[j], float(np.ptp(t))) for j, t in enumerate(self.tables)]
        return sorted(own + [(f"{FEATURES[i]} x {FEATURES[j]}", float(np.ptp(t))) for (i, j), t in zip(self.pairs, self.pair_tables, strict=True)], key=lambda x: -x[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def coarse(bins: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // BINS


def cuts(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Where the bins of a feature begin: quantiles, and right behind a value that several quantiles fall on, so that it has a bin of its own. Fewer than `bins`."""
    at, times = np.unique(np.quantile(x, np.arange(1, bins) / bins), return_counts=True)
    return np.unique(np.concatenate((at, np.nextafter(at[times > 1], np.inf))))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A step for each bin: bins are cut in two, then again where it gains most, up to so many leaves; each leaf's step is Newton's."""
    value = lambda a, b: (g[a:b].sum()) ** 2 / (h[a:b].sum() + RIDGE)
    parts = [(0, len(g))]

    def best_cut(a: int, b: int) -> tuple[float, int]:
        gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        if not len(gl):
            return 0.0, a
        gr, hr = g[a:b].sum() - gl, h[a:b].sum() - hl
        gain = np.where((hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN), gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - value(a, b), 0)
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    while len(parts) < leaves:
        gain, cut, k = max((*best_cut(*p), -k) for k, p in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts[-k]
        parts[-k : -k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four by one cut of each axis: its gain over the grid as one leaf, and a step for each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)

    def four(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        top, left = c[:-1, -1:], c[-1:, :-1]
        return [a, top - a, left - a, c[-1, -1] - top - left + a]

    gains = sum(x**2 / (np.maximum(0, y) + RIDGE) for x, y in zip(four(cg), four(ch), strict=True)) - total
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(gains[i, j]), out


def fit(x: np.ndarray, labels: np.ndarray, prior: float = 0.5) -> Model:
    """x: rows of features; prior: share of label 1 among all labelled rows, which the sample's rows are weighted to.

    A fifth of the rows is kept aside to tell when to stop. No rows, or one label only: the model gives that label's score
    to all, or 1's for no rows.
    """
    y = np.asarray(labels, np.float64)
    n = len(y)
    if len(set(y.tolist())) < 2:
        return Model([], 4.0 if not n or y[0] else -4.0, np.zeros((0, BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    prior = min(max(prior, 0.01), 0.99)
    test = np.arange(n) % 5 == 4
    if len(set(y[test])) < 2 or len(set(y[~test])) < 2:
        test = np.zeros(n, bool)
    train = ~test
    weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum()) * n
    edges = [cuts(x[train, j]) for j in range(x.shape[1])]
    model = Model(edges, float(np.log(prior / (1 - prior))), np.zeros((x.shape[1], BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    b = model.bins(x)
    z = np.full(n, model.bias)
    watch = test if test.any() else train

    def loss() -> float:
        return float((weight[watch] * np.logaddexp(0, np.where(y[watch] == 1, -z[watch], z[watch]))).sum() / weight[watch].sum())

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = sigmoid(z)
        return np.where(train, weight * (q - y), 0), np.where(train, weight * np.maximum(q * (1 - q), 1e-6), 0)

    def boosted(tables: np.ndarray, cells: list[np.ndarray], tree, cycles: int) -> np.ndarray:
        """Goes round the tables until the rows kept aside get no better; z follows the best."""
        nonlocal z
        best, kept, kept_z, since = loss(), tables.copy(), z.copy(), 0
        for _ in range(cycles):
            for k, c in enumerate(cells):
                g, h = slopes()
                size = tables[k].size
                step = RATE * tree(np.bincount(c, g, size).reshape(tables[k].shape), np.bincount(c, h, size).reshape(tables[k].shape))
                tables[k] += step
                z += step.ravel()[c]
            now = loss()
            if now < best - 1e-6:
                best, kept, kept_z, since = now, tables.copy(), z.copy(), 0
            elif (since := since + 1) > PATIENCE:
                break
        z = kept_z
        return kept

    model.tables = boosted(model.tables, [b[:, j] for j in range(x.shape[1])], shallow_tree, CYCLES)
    g, h = slopes()
    cell = lambda i, j: coarse(b[:, i]) * PAIR_BINS + coarse(b[:, j])
    grid = lambda c, v: np.bincount(c, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    gains = {(i, j): quadrants(grid(cell(i, j), g), grid(cell(i, j), h))[0] for i, j in combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = boosted(np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS)), [cell(i, j) for i, j in model.pairs], lambda g, h: quadrants(g, h)[1], PAIR_CYCLES)
    return model


def _described(col) -> list[pa.Array]:
    out = [features(p) for p in tc.pieces(col)]
    flat = np.concatenate(out) if out else np.zeros((0, len(FEATURES)))
    return [pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32()), pa.array(flat.ravel()))]


def described(docs: DataFrame, into: str = "features") -> DataFrame:
    """docs with an array of FEATURES; a null text is an empty one."""
    return arrow_map(docs, [T.StructField(into, T.ArrayType(T.DoubleType()))], lambda: _described)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """From labels.quality in (0, 1) of rows whose crc32(doc_id) modulo 3 is not 1: about `rows` of each label, chosen by a hash of doc_id.

    The rows' features are made by Spark, and only they come to the driver. Null ids and labels are passed over, an id
    with several labels or texts counts with each. Without labelled rows the model gives 1's score to all.
    """
    keys = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(crc_mod(F.col("doc_id"), 3) != 1)
    counts = {r["quality"]: r["count"] for r in keys.groupBy("quality").count().collect()}
    if not counts:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    fine = 1 << 40
    u = F.pmod(F.xxhash64(F.lit(13), F.col("doc_id").cast("string")), F.lit(fine))
    most = F.lit(fine)
    for label, count in sorted(counts.items()):
        most = F.when(F.col("quality") == label, min(fine, int(fine * rows / count))).otherwise(most)
    bound = 4 * rows  # of ids for both labels, and of texts
    ids = keys.where(u < most).select("doc_id", "quality", u.alias("_u")).orderBy("_u", "doc_id", "quality").limit(bound)
    found = described(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("_u", "doc_id", "quality", "text")).drop("text")
    got = found.orderBy("_u", "doc_id", "quality", "features").limit(bound).collect()
    x = np.array([r["features"] for r in got], np.float64).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["quality"] for r in got]), counts.get(1, 0) / sum(counts.values()))


def _scored(model: Model):
    def f(col):
        out = [model.scores(features(p)) for p in tc.pieces(col)]
        return [pa.array(np.concatenate(out) if out else [], pa.float64())]

    return f


def score_texts(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with the probability of quality 1, each row by itself: repeated rows and ties get equal scores. A null or empty text has the score of a text without words; a column called `into` is replaced; an empty table gives an empty result."""
    return arrow_map(docs, [T.StructField(into, T.DoubleType())], partial(_scored, model))


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns over the whole table; train's and score_texts' cases hold."""
    d = score_texts(docs.select("doc_id", "text"), train(docs, labels))
    return d.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
