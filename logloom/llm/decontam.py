"""Benchmark decontamination with an FM-index per shard of the training texts.

Each shard (a piece of an Arrow batch) is indexed by words: symbols are the words that any phrase has. A maximal run
of such words that is shorter than the shortest phrase can hold none and is left out of the index; what is left is
closed by separators, suffix-sorted, and kept as a wavelet matrix over the Burrows-Wheeler transform with sampled
suffix positions. All phrases are searched backwards at once; occurrences are located through the samples, and their
spans merged per document. Phrases go out in blocks of a fixed size, so the benchmark may grow; a document
carries the spans of earlier blocks along.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc

WINDOW = 13
SAMPLE_EVERY = 8
BLOCK_BYTES = 16 << 20


class WaveletMatrix:
    """rank(c, i): how often symbol c stands in the first i places. Arrays of queries."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for k, level in enumerate(reversed(range(self.bits))):
            bit = ((c >> level) & 1).astype(bool)
            a, b = self.ones[k][lo], self.ones[k][hi]
            lo, hi = np.where(bit, self.zeros[k] + a, lo - a), np.where(bit, self.zeros[k] + b, hi - b)
        return hi - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be unique and smallest. Only tied suffixes are sorted again."""
    n = len(seq)
    order = np.argsort(seq)
    head = np.concatenate(([True], seq[order][1:] != seq[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    k = 1
    while True:
        sizes_end = np.append(np.flatnonzero(head)[1:], n)
        tied_heads = np.flatnonzero(head)[sizes_end - np.flatnonzero(head) > 1]
        if not len(tied_heads):
            return order
        tied = np.zeros(n, bool)
        tied[tied_heads] = True
        tied = ~head | tied
        at = np.flatnonzero(tied)
        own = order[at]
        key = rank[own] * (n + 1) + rank[np.minimum(own + k, n - 1)]
        own = own[np.argsort(key)]
        order[at] = own
        key = rank[own] * (n + 1) + rank[np.minimum(own + k, n - 1)]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head[at] = new
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        k *= 2


class FMIndex:
    """Of a sequence of symbols from 1; 0 closes it."""

    def __init__(self, seq: np.ndarray, sigma: int, every: int = SAMPLE_EVERY) -> None:
        seq = np.append(seq, 0)
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = seq[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))
        self.wm = WaveletMatrix(self.bwt, sigma)
        marked = sa % every == 0
        self.mark, self.rank_mark, self.sample = marked, np.concatenate(([0], np.cumsum(marked))), sa[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the phrases, rows of symbols padded at their right."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for back in range(phrases.shape[1]):
            live = live[(lengths[live] > back) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - back]
            lo[live] = self.first[c] + self.wm.rank(c, lo[live])
            hi[live] = self.first[c] + self.wm.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, steps, live = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            done = self.mark[rows[live]]
            at = live[done]
            out[at] = self.sample[self.rank_mark[rows[at]]] + steps[at]
            live = live[~done]
            c = self.bwt[rows[live]]
            rows[live] = self.first[c] + self.wm.rank(c, rows[live])
            steps[live] += 1
        return out


class Phrases:
    """The windows of one block of items, each distinct window once."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.ids = sorted({i for i, _ in items})
        self.vocab, self.lengths, self.rows, self.of, self.shortest = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, window), np.int64), [], 0
        if not items:
            return
        piece = next(tc.pieces(pa.array([t for _, t in items], pa.string()), 1 << 62))
        w = tc.Words(piece, tc.ALNUM_WORD, lower=True)
        self.vocab, symbol = np.unique(w.hashes(), return_inverse=True)
        item_no = {x: k for k, x in enumerate(self.ids)}
        found: dict[bytes, set[int]] = {}
        for k, (i, _) in enumerate(items):
            s = symbol[w.off[k] : w.off[k + 1]].astype(np.int64) + 2
            for j in range(max(1, len(s) - window + 1) if len(s) else 0):
                found.setdefault(s[j : j + window].tobytes(), set()).add(item_no[i])
        rows = [np.frombuffer(k, np.int64) for k in found]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int64)
        for k, r in enumerate(rows):
            self.rows[k, : len(r)] = r
        self.of = [np.array(sorted(v), np.int64) for v in found.values()]
        self.shortest = int(self.lengths.min()) if len(rows) else 0

    def hits(self, words: tc.Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a phrase and the word where it stands."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.lengths) or not len(words.start):
            return none
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        known = self.vocab[at] == h
        begins = np.zeros(len(h) + 1, bool)
        begins[words.off[:-1]] = True
        # runs of known words of one text
        piece_no = np.cumsum(begins[:-1])
        edge = np.flatnonzero(np.diff(piece_no, prepend=-1) | np.diff(known.astype(np.int8), prepend=-1))
        ends = np.append(edge[1:], len(h))
        long = known[edge] & (ends - edge >= self.shortest)
        lo, hi = edge[long], ends[long]
        if not len(lo):
            return none
        size = hi - lo + 1  # a separator closes each run
        total = int(size.sum())
        where = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
        seq = np.ones(total, np.int64)  # symbol 1 separates
        inside = np.ones(total, bool)
        inside[np.cumsum(size) - 1] = False
        seq[inside] = at[where[inside]] + 2
        index = FMIndex(seq, len(self.vocab) + 2)
        a, b = index.search(self.rows, self.lengths)
        counts = b - a
        which = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(a - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))
        return which, where[index.locate(rows)]


def _blocks(items: DataFrame, block_bytes: int):
    """(item_id as text, text) in blocks of at most block_bytes, or of one item."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), "text").where("item_id is not null and text is not null").toLocalIterator():
        if block and size + len(r["text"]) * 4 > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], r["text"]))
        size += len(r["text"]) * 4
    if block:
        yield block


def _scan(docs: DataFrame, phrases: Phrases, names: list[str], schema: T.StructType) -> DataFrame:
    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index("text"))
            out = {k: [] for k in ("n", "spans", "items")}
            for piece in tc.pieces(col):
                w = tc.Words(piece, tc.ALNUM_WORD, lower=True)
                which, at = phrases.hits(w)
                spans, items = [[] for _ in range(piece.n)], [[] for _ in range(piece.n)]
                if len(at):
                    diff = np.zeros(len(w.start) + 1, np.int64)
                    np.add.at(diff, at, 1)
                    np.add.at(diff, at + phrases.lengths[which], -1)
                    covered = np.cumsum(diff)[:-1] > 0
                    doc = np.searchsorted(w.off, at, "right") - 1
                    for d in np.unique(doc):
                        lo, hi = tc.runs(covered[w.off[d] : w.off[d + 1]])
                        spans[d] = [{"lo": x, "hi": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                        found = np.unique(np.concatenate([phrases.of[x] for x in np.unique(which[doc == d])]))
                        items[d] = sorted(phrases.ids[x] for x in found)
                out["n"].append(w.count)
                out["spans"] += spans
                out["items"] += items
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            new = [pa.array(np.concatenate(out["n"]) if out["n"] else [], pa.int64()), pa.array(out["spans"], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(out["items"], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols + new, names=[*names, "n_words", "spans", "items"])

    return docs.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (first word lo, past-last word hi) and items (sorted ids) of the benchmark passages found.

    A window is `window` consecutive words of an item, or all of a shorter item that has words. Null texts have no
    words; items without id or text are passed over; repeated items with one id are one item. Each row of docs is
    judged by itself, so repeated rows, null ids and ties don't matter; other columns are kept, and ones named like the
    new ones replaced. Empty tables give empty results.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "spans", "items")]
    new = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))]
    old = [T.StructField(f"{f.name}_so_far", f.dataType) for f in new]
    out = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    blocks = _blocks(items, block_bytes)
    for k, block in enumerate(chain([next(blocks, [])], blocks)):  # one block's texts in the driver at a time
        p = Phrases(block, window)
        if not k:
            out = _scan(out, p, [f.name for f in kept], T.StructType(kept + new))
            continue
        out = out.withColumnsRenamed({f.name: f"{f.name}_so_far" for f in new})
        out = _scan(out, p, [f.name for f in kept + old], T.StructType(kept + old + new))
        out = out.withColumn("spans", _merged("spans_so_far", "spans")).withColumn("items", F.array_sort(F.array_union("items_so_far", "items"))).drop(*[f.name for f in old])
    return out


def _merged(a: str, b: str):
    """The union of two lists of spans."""
    return F.expr(
        f"aggregate(array_sort(concat({a}, {b})), cast(array() as array<struct<lo: bigint, hi: bigint>>), (acc, s) -> "
        "if(size(acc) > 0 and element_at(acc, -1).hi >= s.lo, concat(slice(acc, 1, size(acc) - 1), array(named_struct('lo', element_at(acc, -1).lo, 'hi', greatest(element_at(acc, -1).hi, s.hi)))), concat(acc, array(s))))"
    )


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """find_contamination() with n_hit, n_items and contaminated (hit words, a twentieth of all at least)."""
    d = find_contamination(docs, items).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.hi - s.lo)")).withColumn("n_items", F.size("items").cast("long"))
    return d.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def op9(docs: DataFrame, items: DataFrame) -> DataFrame:
    d = judged(docs.select("doc_id", "text"), items)
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
