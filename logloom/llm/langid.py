"""Language identification by string kernels.

The kernel is a blended spectrum: for n = 1 to 3, presence of code-point n-grams in the lower-cased text, hashed to
SLOTS slots, normalised for each n and averaged. Nystrom features are kernels with landmark texts times the inverse
root of the landmarks' own kernel matrix; one ridge regressor for each language is fitted on them against +1 and -1.
Scoring is a batched product of presence rows with the landmarks' rows folded into the regressors.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, bounded_sample, crc_mod

TRAIN_ROWS, TRAIN_BYTES = 250, 4 << 20
LANDMARKS, RIDGE, BATCH = 160, 1e-3, 256
SLOTS = 1 << 16
ORDERS = (1, 2, 3)
LETTER = regex.compile(r"\p{L}")


def present(text: str, mask: np.ndarray) -> None:
    """Sets the slots of a text's n-grams in mask, rows by order."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(c), np.uint32)
    for k, n in enumerate(ORDERS):
        if len(c) < n:
            return
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
        mask[k][(h * np.uint32(2654435761)) >> np.uint32(16)] = True


def rows(texts: list[str], slots: list[np.ndarray]) -> list[np.ndarray]:
    """For each order, presence of the given slots, divided by the root of the text's number of slots."""
    out = [np.zeros((len(texts), len(s)), np.float32) for s in slots]
    mask = np.zeros((len(ORDERS), SLOTS), bool)
    for i, t in enumerate(texts):
        mask[:] = False
        present(t, mask)
        for k, s in enumerate(slots):
            size = np.count_nonzero(mask[k])
            if size:
                out[k][i] = mask[k][s]
                out[k][i] /= np.sqrt(size)
    return out


class Model:
    def __init__(self, languages: list[str], slots: list[np.ndarray], weights: list[np.ndarray], bias: np.ndarray) -> None:
        self.languages, self.slots, self.weights, self.bias = languages, slots, weights, bias

    def decide(self, texts: list[str]) -> np.ndarray:
        if not self.languages:
            return np.zeros((len(texts), 0))
        return sum(r @ w for r, w in zip(rows(texts, self.slots), self.weights, strict=True)) + self.bias


def fit(texts: list[str], languages: list[str]) -> Model:
    """Without rows, a model that knows no language and says `und`."""
    names = sorted(set(languages))
    if not names:
        return Model([], [], [], np.zeros(0))
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    by = [[i for i, x in enumerate(languages) if x == n] for n in names]
    marks, k = [], 0
    while len(marks) < min(LANDMARKS, len(texts)):  # in turn from each language
        marks += [b[k] for b in by if k < len(b)]
        k += 1
    marks = marks[:LANDMARKS]
    every = [np.arange(SLOTS)] * len(ORDERS)
    full = [rows([texts[i]], every) for i in marks]
    slots = [np.flatnonzero(np.any([f[k][0] > 0 for f in full], axis=0)) for k in range(len(ORDERS))]
    land = [np.stack([f[k][0][s] for f in full]) for k, s in enumerate(slots)]
    kernel = lambda own: sum(a @ b.T for a, b in zip(own, land, strict=True)) / len(ORDERS)
    value, vector = np.linalg.eigh(kernel(land).astype(np.float64))
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([kernel(rows(texts[i : i + BATCH], slots)) for i in range(0, len(texts), BATCH)]) @ root
    mean = y.mean(0)
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(texts) * np.eye(phi.shape[1]), phi.T @ (y - mean))
    fold = root @ w / len(ORDERS)
    return Model(names, slots, [(x.T @ fold).astype(np.float32) for x in land], mean)


def train(docs: DataFrame, rows_each: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """From documents with a lang whose crc32(doc_id) modulo 3 is not 1: at most rows_each of a language and most_bytes of text."""
    keys = docs.where(F.col("lang").isNotNull()).where(crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", "lang")
    sample = [r for r in bounded_sample(docs, keys, "lang", rows_each, most_bytes) if LETTER.search(r["text"])]
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def _scored(model: Model):
    def f(col):
        said, score = [], []
        for lo in range(0, len(col), BATCH):
            texts = [t or "" for t in col.slice(lo, BATCH).to_pylist()]
            d = model.decide(texts)
            for t, x in zip(texts, d, strict=True):
                if len(x) and LETTER.search(t):
                    e = np.exp(4 * (x - x.max()))
                    said.append(model.languages[int(x.argmax())])
                    score.append(float(e.max() / e.sum()))
                else:
                    said.append("und")
                    score.append(0.0)
        return [pa.array(said, pa.string()), pa.array(score, pa.float64())]

    return f


NEW = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score. A text that is null or has no letter is `und` with score 0; ties go to the first language by code point; rows are judged one by one; columns of these names are replaced; an empty table gives an empty result."""
    return arrow_map(docs, NEW, partial(_scored, model))


def op6(docs: DataFrame) -> DataFrame:
    d = identify(docs.select("doc_id", "text"), train(docs))
    return d.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
