"""Vector code compression: vectors are cut into parts, and each part is named by the nearest entry of its position's codebook.

Codebooks come from rounds of Lloyd's method over all rows. The nearest entry is found without measuring all: an entry's
squared distance is at least, block by block, the width times the squared difference of the block means plus the squared
difference of the residual norms (what is left of a block without its mean). Bounds are taken over one block, then over
two, four and eight; an entry whose bound is above the best distance measured so far is dropped, and what survives is measured in
whole numbers. Bounds are lowered by more than their rounding errors, so no nearest entry and no tie is dropped.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import blocks, kept_vectors, summed

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Blocks of a part, coarse to fine.
LEVELS = (1, 2, 4, 8)
#: What a bound is lowered by: a share of it, and of the squared norms it is made of.
SLACK = 1e-9
#: Labels up to this many have their errors broadcast; more are joined in SALTS salted parts.
MOST_LABELS, SALTS = 1 << 15, 16


class Blocks:
    """The blocks of vectors: means and the norms of what they leave, scaled so that squared differences of rows are the bounds."""

    def __init__(self, v: np.ndarray, level: int) -> None:
        cuts = np.arange(level) * v.shape[1] // level
        size = np.diff(np.append(cuts, v.shape[1])).astype(np.float64)
        mean = np.add.reduceat(v, cuts, 1) / size
        square = np.add.reduceat(v * v, cuts, 1)
        self.rows = np.hstack((mean * np.sqrt(size), np.sqrt(np.maximum(0, square - mean**2 * size))))
        self.norm = (self.rows**2).sum(1)
        self.slack = SLACK * (square.sum(1) + 1)

    def bounds(self, other: Blocks) -> np.ndarray:
        """At most the squared distances of own vectors from the other's."""
        out = self.rows @ other.rows.T
        out *= -2
        out += self.norm[:, None]
        out += other.norm
        out *= 1 - SLACK
        out -= self.slack[:, None]
        out -= other.slack
        return out


class Codebook:
    """The entries of one part position."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        width = entries.shape[1]
        self.levels = [(n, Blocks(entries, n)) for n in LEVELS if n <= width]

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry of each row (the lowest of equally near ones), its squared distance, and how many entries were measured."""
        n = len(v)
        if not self.levels or not n:  # parts without an entry are all equal
            return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        apart = lambda a, b: ((v[a] - self.entries[b]) ** 2).sum(1)
        every, left, best, measured = np.arange(n), None, None, 0
        for level, theirs in self.levels:
            low = Blocks(v, level).bounds(theirs)
            if left is not None:
                low[~left] = np.inf
            least = apart(every, low.argmin(1))  # the entry with the least bound is measured
            best = least if best is None else np.minimum(best, least)
            measured += n
            left = low <= best[:, None]
        row, entry = np.nonzero(left)
        d = apart(row, entry)
        begin = np.searchsorted(row, every)
        best = np.minimum.reduceat(d, begin)
        hit = np.flatnonzero(d == best[row])
        return entry[hit[np.searchsorted(row[hit], every)]], best, measured + len(row)


def widths(dim: int, parts: int) -> tuple[int, int]:
    """Entries of a part, and zeros that fill the last one up."""
    w = -(-dim // parts)
    return w, w * parts - dim


def _parts(block: np.ndarray, parts: int) -> np.ndarray:
    w, pad = widths(block.shape[1], parts)
    if pad:
        block = np.hstack((block, np.zeros((len(block), pad), np.int64)))
    return block.reshape(len(block), parts, w).transpose(1, 0, 2)


def _sums(books: list[np.ndarray], dim: int):
    """Adds the parts of a batch to the sums (and, last, the counts) of their nearest entries."""
    made = [Codebook(b) for b in books]
    k, w = books[0].shape
    total = np.zeros((len(books), k, w + 1), np.int64)

    def add(batch: pa.RecordBatch) -> None:
        for _, block in blocks(batch, dim, 512 * max(1, dim)):
            for p, v in enumerate(_parts(block, len(books))):
                code = made[p].nearest(v)[0]
                order = np.argsort(code, kind="stable")
                own, begin, count = np.unique(code[order], return_index=True, return_counts=True)
                total[p, own, :w] += np.add.reduceat(v[order], begin, 0)
                total[p, own, w] += count

    return add, total


def train(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one for each part position, from all kept rows: the parts of the rows of the smallest keys (null last, ties by the vector), then `rounds` rounds of means, rounded down. Entries that no part is nearest to stay."""
    first = np.array([r["q"] for r in rows.orderBy(F.asc_nulls_last("key"), "q").limit(entries).collect()], np.int64)
    books = list(_parts(first, parts))
    for _ in range(rounds):
        total = summed(rows, partial(_sums, books, dim), "long")
        for b, t in zip(books, total, strict=True):
            used = t[:, -1] > 0
            b[used] = t[used, :-1] // t[used, -1:]
    return books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components as decimal numbers, by part, entry and place, joined by commas."""
    h = hashlib.sha256()
    h.update(",".join(str(x) for b in books for x in b.ravel().tolist()).encode())
    return h.hexdigest()


def encode(rows: DataFrame, dim: int, books: list[np.ndarray]) -> DataFrame:
    """rows with code (the entries' indices as binary, one byte for each part, two if a codebook has over 256) and error (squared distance over all parts), without their vectors."""
    kept = [f for f in rows.schema.fields if f.name != "q"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", code binary, error long"

    def run(batches):
        made, size = [Codebook(b) for b in books], np.uint8 if len(books[0]) <= 256 else np.dtype(">u2")
        for batch in batches:
            codes, errors = [], []
            for _, block in blocks(batch, dim, 512 * max(1, dim)):
                found = [m.nearest(v) for m, v in zip(made, _parts(block, len(made)), strict=True)]
                codes += [r.tobytes() for r in np.stack([f[0] for f in found], 1).astype(size)]
                errors.append(sum(f[1] for f in found))
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(codes, pa.binary()), pa.array(np.concatenate(errors) if errors else [], pa.int64())], names=[*(f.name for f in kept), "code", "error"])

    return rows.mapInArrow(run, schema)


def with_label_sums(rows: DataFrame, label: str, value: str, into: str, most_labels: int = MOST_LABELS) -> DataFrame:
    """rows with the sum of value over all rows of an equal label, nulls together. Few labels' sums are broadcast, at most most_labels; more are joined, each row with one of SALTS copies of its label's sum, so that a label of many rows is several groups."""
    sums = written(rows.groupBy(F.col(label).alias("_label")).agg(F.sum(value).alias(into)))
    if sums.count() <= most_labels:
        return rows.join(F.broadcast(sums), rows[label].eqNullSafe(sums["_label"])).drop("_label")
    salted = sums.select("*", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt"))
    d = rows.withColumn("_own", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return d.join(salted, d[label].eqNullSafe(salted["_label"]) & (d["_own"] == salted["_salt"])).drop("_label", "_own", "_salt")


def compressed(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, label, code, error) of each row with a usable vector (see vectors.kept_vectors for those that go), and the codebooks.

    Fewer rows than `entries`: the codebooks have as many. A length that parts don't divide is filled up with zeros.
    Repeated rows get equal codes. An empty table: no rows and no codebooks.
    """
    rows, dim = kept_vectors(df, key, vector, label)
    if not rows.take(1):
        return rows.drop("q").selectExpr("*", "cast(null as binary) as code", "0L as error"), []
    books = train(rows, dim, parts, entries, rounds)
    return written(encode(rows, dim, books)), books


def op12(embeddings: DataFrame) -> DataFrame:
    """The contract's columns of compressed() over the whole table; the cases of kept_vectors and compressed hold."""
    d, books = compressed(embeddings)
    d = with_label_sums(d, "label", "error", "label_error")
    return d.select(F.col("key").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
