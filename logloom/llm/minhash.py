"""Near-duplicate classes by Order MinHash and banded alignment.

A text's sketch has BANDS parts; each is of the DEPTH occurrence-labelled SHINGLE-word k-mers with the least hashes,
kept in the order in which they stand in the text, so that it follows edit similarity. SINGLES more parts are of one
minimum each: edits spread over a text spare so few k-mers that two texts of an edit similarity near SIMILARITY seldom
agree in several minima at once. Texts whose sketches agree in a part share a bucket. A candidate pair is a link if a
banded alignment finds an edit similarity of the words of SIMILARITY at least: a distance of at most 1 - SIMILARITY of
the longer text's words. Classes are connected components.

Exact copies (equal word sequences) are folded first. Candidates are linear in the sketch rows, whatever a bucket's size:
rows are range-partitioned and sorted by bucket, so a hot bucket spreads over tasks. In buckets of up to NEAR + 1 texts
all pairs are candidates. The texts of larger buckets are sorted again in ORDERS orders by other parts of their
sketches, which brings the similar ones together, and each meets the NEXT ones after it. Histograms of words bound the
edit distance from below and drop unlike pairs before any alignment, losslessly. Rounds of alignment begin with the pair
of each text that most buckets propose, and spare pairs whose classes have met already.

The orders only find most links of large buckets early. What is left is exact: of every large bucket whose texts are of
more than one class by then, all pairs of texts of different classes meet that may be links. An edit changes k k-mers at
most, so a link's texts share a part of their k-mers; texts that don't have so many k-mers in common with texts of other
classes at all are in no link. They are told by one sort of k-mers, in proportion to the texts, and go: most texts of a
large bucket share a line or a passage only. The others meet in pairs of blocks of BLOCK texts, one task's work each;
those pairs that the histograms and the k-mers allow are aligned there, and only links leave the task. So all links of
texts that share a bucket count, whatever its size. Where a large bucket has many texts of different classes that share
much, the blocks' work grows with the square of their number; the rows that are written and joined don't, but for one
copy of a text for each block of its bucket.
"""

from __future__ import annotations

from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import textcore as tc
from .common import arrow_map, written

SHINGLE, SIMILARITY, BANDS, DEPTH, SINGLES = 5, 0.8, 20, 2, 24
#: Buckets of up to NEAR + 1 texts give all pairs; in larger ones a text meets the NEXT ones in each of ORDERS orders.
NEAR, NEXT, ORDERS = 8, 1, 4
#: Pairs of a text that the first rounds align; a last round aligns all that are left.
TURNS = (1, 2)
#: Texts of a large bucket in a block, words of them, and pairs of them measured at once.
BLOCK, BLOCK_WORDS, AT_ONCE = 2048, 1 << 21, 1 << 16
#: Edges that a task joins up before they meet others.
EDGES = 1 << 18
#: Counters of a text's histogram of words.
CELLS = 128
#: Words of the k-mers that tell which texts may be in a link, for texts of FEW words or more and for others: first of all texts, then of those that are left.
PASSES, FEW = ((4, 2), (3, 3)), 40
#: k-mers of a bucket, words of texts whose k-mers are dealt out to buckets at once, and words of texts whose counts are summed up in a task.
BUCKET, DEALT, SUMMED = 1 << 20, 1 << 20, 1 << 22
_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)
_SEEDS = np.random.default_rng(77).integers(1, 1 << 62, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def shingles(w: tc.Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of all texts, and the text of each."""
    fits = w.fits(k)
    return w.windows(h, k)[fits], w.doc()[: len(fits)][fits]


def labelled(grams: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of k-mers together with how many equal ones stand before them in their text."""
    order = np.argsort(tc.mix(grams ^ tc.mix(doc.astype(_U) + _U(1))), kind="stable")
    g, d = grams[order], doc[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    nth = np.zeros(len(g), _U)
    nth[order] = (np.arange(len(g)) - first).astype(_U)
    return tc.mix(grams + nth * _U(0x9E3779B97F4A7C15))


def sketch(grams: np.ndarray, doc: np.ndarray, n: int, bands: int, depth: int, singles: int = 0) -> np.ndarray:
    """Values of the parts (n x (bands + singles)); 0 for texts without k-mers."""
    out = np.zeros((n, bands + singles), np.int64)
    if not out.size or not len(grams):
        return out
    label = labelled(grams, doc)
    begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    has = doc[begin]
    place = np.arange(len(doc)).astype(_U)
    bits = _U(max(1, int(len(doc) - 1).bit_length()))
    low = (_U(1) << bits) - _U(1)
    base = label ^ (label >> _U(29))
    for b in range(bands + singles):
        x = base * _SEEDS[b]
        x = ((x ^ (x >> _U(32))) & ~low) | place
        at, minima = [], depth if b < bands else 1
        for _ in range(minima):
            m = np.minimum.reduceat(x, begin)
            p = (m & low).astype(np.int64)
            p = np.where(m == _MAX, -1, p)
            at.append(p)
            if minima > 1:
                x[p[p >= 0]] = _MAX
        at = np.sort(np.stack(at, 1), 1)
        v = np.full(len(begin), b + 1, _U)
        for k in range(minima):
            v = tc.mix(v * _U(31) + np.where(at[:, k] >= 0, label[at[:, k]], _U(0)))
        out[has, b] = v.view(np.int64)
    return out


def histograms(h: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """Counts of the words of each text in CELLS cells, 255 at most, as bytes. An edit changes two cells by one each."""
    counts = np.bincount(doc * CELLS + (h % _U(CELLS)).astype(np.int64), minlength=n * CELLS)
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(CELLS), n, [None, pa.py_buffer(raw)]).cast(pa.binary())


def may_be_near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Whether histograms (rows of cells) and lengths allow an edit similarity; lossless."""
    most = (1 - similarity) * np.maximum(na, nb) + 1e-9
    d = a.astype(np.int16) - b
    more = np.maximum(d, 0).sum(1)
    return (np.abs(na - nb) <= most) & (np.maximum(more, more - d.sum(1)) <= most)


def _sketched(k: int, bands: int, depth: int, singles: int):
    def f(col):
        cols = [[] for _ in range(5)]
        for p in tc.pieces(col):
            w = tc.Words(p, tc.SPACE_WORD)
            h = w.hashes()
            grams, doc = shingles(w, h, k)
            pre = tc.prefix_sum(h, tc.WORD_POWERS)
            whole = tc.mix(tc.range_hash(pre, w.off[:-1], w.off[1:], tc.WORD_POWERS) ^ w.count.astype(_U))
            other = tc.per_text(tc.mix(h ^ (np.arange(len(h)) - np.repeat(w.off[:-1], w.count)).astype(_U) * _U(0xD6E8FEB86659FD93)).view(np.int64), w.off[:-1], w.off[1:])
            for c, x in zip(cols, (whole.view(np.int64), other, w.count, sketch(grams, doc, p.n, bands, depth, singles), histograms(h, w.doc(), p.n)), strict=True):
                c.append(x)
        numbers = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols[:3]]
        values = np.concatenate(cols[3]) if cols[3] else np.zeros((0, bands + singles), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * (bands + singles), pa.int32()), pa.array(values.ravel(), pa.int64()))
        return [pa.array(x, pa.int64()) for x in numbers] + [lists, pa.concat_arrays(cols[4]) if cols[4] else pa.array([], pa.binary())]

    return f


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _numbers(batches, names: list[str], ahead: int):
    """Sorted batches as arrays, each with up to 2 x ahead rows of the one before: (arrays, first own row, past-last own row, whether it is the last).

    Own rows have all rows within `ahead` places beside them, but for the partition's ends.
    """
    held, own = None, 0
    for b in batches:
        new = [_column(b, n) for n in names]
        held = new if held is None else [np.concatenate((x, y)) for x, y in zip(held, new, strict=True)]
        upto = len(held[0]) - ahead
        if upto > own:
            yield held, own, upto, False
            drop = max(0, upto - ahead)
            held, own = [x[drop:] for x in held], upto - drop
    if held is not None and own < len(held[0]):
        yield held, own, len(held[0]), True


SMALL = "a long, b long, key long"


def _small_buckets(batches, similarity: float, near: int):
    """Rows (a, b, null): pairs of texts that a bucket of up to near + 1 texts holds; (a, null, key): texts of larger ones.

    Of buckets at the ends of a partition, where others may hold more of them, all texts are given both ways.
    """
    edge = None
    for (key, text, n), lo, hi, last in _numbers(batches, ["key", "text", "n"], near + 1):
        edge = key[0] if edge is None else edge
        i = np.arange(lo, hi)
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        of = np.searchsorted(begin, i, "right") - 1
        first, last_one = begin[of], np.append(begin[1:], len(key))[of] - 1
        large = np.minimum(last_one, i + near + 1) - np.maximum(first, i - near - 1) > near  # more than near + 1 texts, any of the bucket's
        again = large | (key[lo:hi] == edge) | (last & (key[lo:hi] == key[-1]))
        a, b = [], []
        for w in range(1, near + 1):
            j = i - w
            ok = (j >= 0) & (key[np.maximum(j, 0)] == key[i]) & ~large
            x, y = i[ok], j[ok]
            ok = np.abs(n[x] - n[y]) <= (1 - similarity) * np.maximum(n[x], n[y]) + 1e-9
            a.append(np.minimum(text[x[ok]], text[y[ok]]))
            b.append(np.maximum(text[x[ok]], text[y[ok]]))
        a, b = np.concatenate(a), np.concatenate(b)
        more = text[lo:hi][again]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((a, more))), pa.concat_arrays([pa.array(b), pa.nulls(len(more), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(key[lo:hi][again])])], names=["a", "b", "key"])


def _cells(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, CELLS)


def _large_buckets(batches, similarity: float, ahead: int):
    """(a, b) of texts up to `ahead` places apart in an order of their bucket that may be near."""
    for (key, turn, text, n, hist), lo, hi, _ in _numbers(batches, ["key", "turn", "text", "n", "hist"], ahead):
        cells, i = _cells(hist), np.arange(lo, hi)
        for w in range(1, ahead + 1):
            x = i[i >= w]
            x = x[(key[x] == key[x - w]) & (turn[x] == turn[x - w])]
            y = x - w
            ok = may_be_near(cells[x], cells[y], n[x], n[y], similarity)
            a, b = text[x[ok]], text[y[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _pairs(key: tuple, t: pa.Table, similarity: float):
    """Rows (x, y) of texts of different classes in two blocks of a bucket (or one and the same) that may be near.

    Pairs that share a bucket below this one are left to that. t is sorted by n.
    """
    n, comp, block = (t[c].to_numpy() for c in ("n", "comp", "block"))
    cells, below, same = _cells(t["hist"].to_numpy()), [frozenset(x) for x in t["below"].to_pylist()], key[1] == key[2]
    first = np.searchsorted(n, n - ((1 - similarity) * n + 1e-9))  # shorter ones differ by too many words
    step = max(1, AT_ONCE // len(n))
    for lo in range(0, len(n), step):
        i, begin = np.arange(lo, min(len(n), lo + step)), first[lo]
        j = np.arange(begin, i[-1] + 1)
        ok = (j < i[:, None]) & (j >= first[i][:, None]) & (comp[j] != comp[i][:, None])
        if not same:
            ok &= block[j] != block[i][:, None]
        x, y = np.nonzero(ok)
        x, y = i[x], j[y]
        ok = np.flatnonzero(may_be_near(cells[x], cells[y], n[x], n[y], similarity))
        ok = [k for k, a, b in zip(ok.tolist(), x[ok].tolist(), y[ok].tolist(), strict=True) if below[a].isdisjoint(below[b])]
        yield x[ok], y[ok]


def _meeting(key: tuple, t: pa.Table, similarity: float) -> pa.Table:
    """The rows of texts that have a pair."""
    t = t.sort_by("n")
    has = np.zeros(len(t), bool)
    for x, y in _pairs(key, t, similarity):
        has[x] = has[y] = True
    return t.filter(pa.array(has))


def packed_grams(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled hashes of the k-mers of texts of packed words (off: where each begins, then the total), and the text of each."""
    n, count = max(0, len(words) - k + 1), np.diff(off)
    fits = np.arange(n) + k <= np.repeat(off[1:], count)[:n]
    doc = np.repeat(np.arange(len(count)), count)[:n][fits]
    w, v = words.astype(_U), np.full(n, k, _U)
    for i in range(k):
        v = tc.mix(v * _U(31) + w[i : i + n])
    return (labelled(v[fits], doc) if len(doc) else v[fits]), doc


def least_shared(n, k: int, similarity: float):
    """k-mers that a text of n words shares with any it is linked to, at least: of the longer one's N - k + 1, each of its (1 - similarity) N edits changes k at most."""
    return (1 - k * (1 - similarity)) * n - k + 1 - 1e-6


OWNER = np.dtype([("text", "<i8"), ("comp", "<i8")])
DEALT_ROWS = "bucket int, grams binary, owners binary, texts binary"


def _dealt(batches, long: int, short: int, similarity: float, buckets: int):
    """The k-mers of texts (text, comp, words), dealt out to buckets: 32 bits of each, the place of its owner among the row's texts and whether it is for his test (the lowest bit), and the texts."""
    def rows(held: list):
        owner = np.array([x[:2] for x in held], OWNER)
        off = np.cumsum([0, *(len(x[2]) for x in held)])
        words, n = np.concatenate([x[2] for x in held]), np.diff(off)
        grams, of = [], []
        for k, tested, needed in ((long, n >= FEW, n >= similarity * FEW - 1), (short, n < FEW, n * similarity < FEW + 1)):
            g, d = packed_grams(words, off, k)
            g, d = g[needed[d]], d[needed[d]]
            grams.append(g)
            of.append(2 * d + tested[d])
        grams, of = np.concatenate(grams), np.concatenate(of)
        to = ((grams >> _U(32)) % _U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        grams, of = (grams[order] & _U(0xFFFFFFFF)).astype("<u4"), of[order]
        out = []
        for b, (lo, hi) in enumerate(pairwise(np.searchsorted(to[order], np.arange(buckets + 1)))):
            if lo < hi:
                own, place = np.unique(of[lo:hi] >> 1, return_inverse=True)
                out.append((b, grams[lo:hi].tobytes(), (2 * place + (of[lo:hi] & 1)).astype("<u4").tobytes(), owner[own].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "grams", "owners", "texts"])

    held, size = [], 0
    for t in batches:
        for text, comp, words in zip(_column(t, "text").tolist(), _column(t, "comp").tolist(), t.column(t.schema.get_field_index("words")), strict=True):
            held.append((text, comp, np.frombuffer(words.as_buffer(), "<u4")))
            size += len(held[-1][2])
            if size >= DEALT:
                yield rows(held)
                held, size = [], 0
    if held:
        yield rows(held)


COUNT = np.dtype([("text", "<i8"), ("shared", "<u4")])


def _in_common(t: pa.Table, parts: int) -> pa.Table:
    """Packed counts (text, shared) of a bucket's k-mers that texts have in common with texts of other classes, a row for each part of the texts. Equal 32 bits of different k-mers count, too: they keep a text."""
    gram, of, owner, before = [], [], [], 0
    for g, o, x in zip(t["grams"], t["owners"], t["texts"], strict=True):
        gram.append(np.frombuffer(g.as_buffer(), "<u4"))
        owner.append(np.frombuffer(x.as_buffer(), OWNER))
        of.append(np.frombuffer(o.as_buffer(), "<u4").astype(np.int64) + 2 * before)
        before += len(owner[-1])
    gram, of, owner = np.concatenate(gram), np.concatenate(of), np.concatenate(owner)
    order = np.argsort(gram)
    gram, of = gram[order], of[order]
    comp, begin = owner["comp"][of >> 1], np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    several = np.repeat(np.minimum.reduceat(comp, begin) < np.maximum.reduceat(comp, begin), np.diff(np.append(begin, len(gram))))
    shared = np.bincount(of[several & (of & 1 == 1)] >> 1, minlength=len(owner))
    found = np.zeros(np.count_nonzero(shared), COUNT)
    found["text"], found["shared"] = owner["text"][shared > 0], shared[shared > 0]
    part = (tc.mix(found["text"].view(_U)) % _U(parts)).astype(np.int64)
    some = np.unique(part)
    return pa.table({"part": pa.array(some, pa.int32()), "counts": pa.array([found[part == x].tobytes() for x in some], pa.binary())})


def _summed(t: pa.Table) -> pa.Table:
    """(text, shared) of a part of the texts."""
    counts = np.concatenate([np.frombuffer(x.as_buffer(), COUNT) for x in t["counts"]])
    text, at = np.unique(counts["text"], return_inverse=True)
    return pa.table({"text": text, "shared": np.bincount(at, counts["shared"]).astype(np.int64)})


def sharing(texts: DataFrame, long: int, short: int, similarity: float) -> DataFrame:
    """Those of texts (text, n, comp, words) that may be in a link with a text of another class, by k-mers; lossless."""
    total = texts.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    dealt = texts.select("text", "comp", "words").mapInArrow(partial(_dealt, long=long, short=short, similarity=similarity, buckets=buckets), DEALT_ROWS)
    parts = max(1, -(-total // SUMMED))
    found = dealt.groupBy("bucket").applyInArrow(lambda t: _in_common(t, parts), "part int, counts binary")
    found = found.groupBy("part").applyInArrow(_summed, "text long, shared long")
    n = F.col("n")
    least = F.when(n >= FEW, least_shared(n, long, similarity)).otherwise(least_shared(n, short, similarity))
    return texts.join(found, "text", "left").where(F.coalesce("shared", F.lit(0)) >= least).select(*texts.columns)


class _Grams:
    """Whether pairs of packed texts share as many k-mers as a link needs; lossless. Each text's are made once."""

    def __init__(self, words: list[np.ndarray], similarity: float) -> None:
        self.words, self.similarity, self.made = words, similarity, {}

    def of(self, i: int, k: int) -> np.ndarray:
        if (i, k) not in self.made:
            self.made[i, k] = np.sort(packed_grams(self.words[i], np.array([0, len(self.words[i])]), k)[0])
        return self.made[i, k]

    def allow(self, i: int, j: int) -> bool:
        n = max(len(self.words[i]), len(self.words[j]))
        k = PASSES[0][n < FEW]
        least = least_shared(n, k, self.similarity)
        if least <= 0:
            return True
        a, b = self.of(i, k), self.of(j, k)
        at = np.searchsorted(a, b)
        return len(a) and np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b) >= least


def _links(key: tuple, t: pa.Table, similarity: float) -> pa.Table:
    """(a, b) of classes that a link joins, no more of them than join up what belongs together: pairs of classes that have met by then are spared."""
    t = t.sort_by("n")
    words = [np.frombuffer(x.as_buffer(), "<u4") for c in t["words"].chunks for x in c]
    comp, out, grams = t["comp"].to_pylist(), [], _Grams(words, similarity)
    root = {c: c for c in comp}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for x, y in _pairs(key, t, similarity):
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            one, two = top(comp[i]), top(comp[j])
            if one != two and grams.allow(i, j) and within(words[i], words[j], int((1 - similarity) * max(len(words[i]), len(words[j])) + 1e-9)):
                root[max(one, two)] = min(one, two)
                out.append((comp[i], comp[j]))
    return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate("ab")})


def _filtered(batches, similarity: float):
    for t in batches:
        ok = may_be_near(_cells(_column(t, "ha")), _cells(_column(t, "hb")), _column(t, "na"), _column(t, "nb"), similarity)
        yield pa.RecordBatch.from_arrays([t.column(t.schema.get_field_index(c)).filter(pa.array(ok)) for c in ("a", "b", "times")], names=["a", "b", "times"])


def _band(a: list, b: list, most: int) -> bool:
    """Whether the edit distance is at most `most`; a is not the shorter one, nor longer by more than `most`.

    The band of 2 x most + 1 diagonals is a number's bits, aligned column by column: the bit-parallel recurrence of
    vertical and horizontal differences, followed along the diagonal on which the last cell lies.
    """
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    width = 2 * most + 1
    mask = (1 << width) - 1
    up, down = (mask >> most) << most, 0
    distance, shift = len(a) - len(b), most + len(a) - len(b)
    for j, x in enumerate(b):
        lo, match = j - most, 0
        for p in places.get(x, ()):
            if p >= lo:
                if p >= lo + width:
                    break
                match |= 1 << (p - lo)
        d = (((match & up) + up) ^ up) | match | down
        right = (down | ~(d | up)) & mask
        left = d & up
        distance += not (d >> shift) & 1
        if distance > most:
            return False
        d = (d & mask) >> 1
        up = (left | ~(d | right)) & mask
        down = d & right
    return True


def within(a, b, most: int) -> bool:
    """Whether the edit distance of two sequences is at most `most`: banded alignment, in a narrow band first."""
    a, b = np.asarray(a), np.asarray(b)
    if abs(len(a) - len(b)) > most:
        return False
    for _ in range(2):  # what both begin with, then what both end with
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        n = int(differ[0]) if len(differ) else n
        a, b = a[n:][::-1], b[n:][::-1]
    if len(a) < len(b):
        a, b = b, a
    a, b = a.tolist(), b.tolist()
    band = min(most, max(16, 2 * (len(a) - len(b))))
    while not _band(a, b, band):
        if band >= most:
            return False
        band = min(most, 4 * band)
    return True


def _packed(col):
    """32-bit hashes of the words of each text, as bytes."""
    out = []
    for p in tc.pieces(col):
        w = tc.Words(p, tc.SPACE_WORD)
        h = (w.hashes() >> _U(32)).astype("<u4")
        out += [h[w.off[i] : w.off[i + 1]].tobytes() for i in range(p.n)]
    return [pa.array(out, pa.binary())]


def _similar(batches, similarity: float):
    for t in batches:
        keep = []
        for x, y in zip(t.column(t.schema.get_field_index("wa")), t.column(t.schema.get_field_index("wb")), strict=True):
            a, b = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
            keep.append(within(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9)))
        yield pa.RecordBatch.from_arrays([t.column(t.schema.get_field_index(c)).filter(pa.array(keep, pa.bool_())) for c in ("ra", "rb")], names=["a", "b"])


def _stars(batches):
    """Each EDGES edges (u, v) as stars: their nodes but the least of each component, and that."""
    held, n = [], 0

    def stars():
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        ends, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        u, v = at[: len(u)], at[len(u) :]
        root = np.arange(len(ends))
        while (root[u] != root[v]).any():
            np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
            while (root[root] != root).any():
                root = root[root]
        other = np.flatnonzero(root != np.arange(len(ends)))
        return pa.RecordBatch.from_arrays([pa.array(ends[other]), pa.array(ends[root[other]])], names=["u", "v"])

    for t in batches:
        held.append((_column(t, "u"), _column(t, "v")))
        n += len(t)
        if n >= EDGES:
            yield stars()
            held, n = [], 0
    if n:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of edges (a, b), comp the least node of each component.

    Each task turns its EDGES edges into stars; where tasks' stars share nodes, rounds of large-star and small-star follow
    until only stars are left. There are as many tasks as edges ask for: few edges need no round.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        e = written(e.coalesce(max(1, -(-e.count() // EDGES))).mapInArrow(_stars, "u long, v long"))
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct().where("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        e = written(small)


NEW = [T.StructField(n, T.LongType()) for n in ("_h1", "_h2", "_n")] + [T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_hist", T.BinaryType())]


def candidates(texts: DataFrame, similarity: float, near: int = NEAR, ahead: int = NEXT, orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """(a, b, times): pairs of texts that may be near, and how many buckets propose each; (text, key): the large buckets, for rest().

    texts: (text, n, bands, hist).
    """
    rows = texts.select("text", "n", F.explode("bands").alias("key"))
    found = rows.repartitionByRange("key", "n", "text").sortWithinPartitions("key", "n", "text").select("key", "text", "n").mapInArrow(partial(_small_buckets, similarity=similarity, near=near), SMALL)
    found = written(found)
    few = found.where("key is null").groupBy("a", "b").agg(F.count("*").alias("times"))
    for side in "ab":
        few = few.join(texts.select(F.col("text").alias(side), F.col("n").alias(f"n{side}"), F.col("hist").alias(f"h{side}")), side)
    few = few.mapInArrow(partial(_filtered, similarity=similarity), "a long, b long, times long")
    large = found.where("key is not null").select(F.col("a").alias("text"), "key")
    hot = large.join(texts, "text").select("text", "key", "n", "hist", "bands", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("turn"))
    by = [F.expr(f"element_at(bands, cast(pmod(xxhash64(key, turn, {i}), size(bands)) as int) + 1)").alias(f"by{i}") for i in range(2)]
    hot = written(hot.select("key", "turn", *by, "n", "text", "hist"))
    order = ["key", "turn", "by0", "by1", "n", "text"]
    many = hot.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "turn", "text", "n", "hist")
    many = many.mapInArrow(partial(_large_buckets, similarity=similarity, ahead=ahead), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("times"))
    return few.unionByName(many).groupBy("a", "b").agg(F.sum("times").alias("times")), large


def rest(docs: DataFrame, large: DataFrame, texts: DataFrame, comps: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): classes that links between texts of a large bucket join, of all its pairs of texts of different classes.

    large: (text, key); texts: (text, rep, n, hist); comps: (node, comp) of reps. Buckets of one class take no part, nor do
    texts that sharing() rules out. The others are dealt out to blocks by a hash, and a task holds two blocks. A pair that
    shares several buckets is tried in the first of them. Pairs stay in the task: one pass finds the texts that have any
    by the histograms, and another, with the words of these only, aligns them. So the rows are as many as texts in
    buckets (and blocks), however many pairs there are.
    """
    of = texts.select("text", "rep", "n", "hist").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    of = written(of.join(large.select("text").distinct(), "text", "left_semi"))
    met = _mixed(large, of, block).select("text", "key")
    own = of.join(met.select("text").distinct(), "text", "left_semi")
    words = _words(docs, own.select("text", "rep"))
    near = written(own.select("text", "n", "comp").join(words, "text"))
    for long, short in PASSES:
        near = written(sharing(near, long, short, similarity))
    met = _mixed(met.join(near.select("text"), "text", "left_semi"), of, block)
    d = met.join(of.join(met.groupBy("text").agg(F.collect_list("key").alias("_keys")), "text"), "text")
    d = d.withColumn("below", F.expr("filter(_keys, k -> k < key)")).withColumn("block", F.pmod(F.xxhash64("text"), F.col("_n")))
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    d = d.select("key", F.least("block", "_j").alias("_one"), F.greatest("block", "_j").alias("_two"), "block", "text", "comp", "n", "hist", "below")
    by = ["key", "_one", "_two"]
    some = written(d.groupBy(*by).applyInArrow(lambda k, t: _meeting([x.as_py() for x in k], t, similarity), d.schema))
    return some.join(near.select("text", "words"), "text").groupBy(*by).applyInArrow(lambda k, t: _links([x.as_py() for x in k], t, similarity), "a long, b long")


def _mixed(large: DataFrame, of: DataFrame, block: int) -> DataFrame:
    """Rows (text, key) of large whose bucket has texts of more than one class, with its number of blocks _n."""
    sizes = large.join(of.select("text", "comp", "n"), "text").groupBy("key").agg(F.count("*").alias("_m"), F.sum("n").alias("_w"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi")
    return written(large.join(sizes.select("key", F.ceil(F.greatest(F.col("_m") / block, F.col("_w") / BLOCK_WORDS)).alias("_n")), "key"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, depth: int = DEPTH,
                    singles: int = SINGLES, **search: int) -> DataFrame:
    """(doc_id, text_class, class_id) for each row of docs with a doc_id: the least doc_id of the rows with the same words, and of the near-duplicate class.

    doc_id names a document: rows that share it share its class. Rows without doc_id get null classes. Null, empty and blank texts have no words; they are copies of one another.
    Texts of fewer than `shingle` words are near only to exact copies. Texts of any length are sketched and aligned whole.
    Ties (equal hashes, pairs at exactly the similarity) and repeated rows don't matter, other columns are ignored, an
    empty table gives an empty result. search: near, ahead and orders of candidates().
    """
    made = written(arrow_map(docs.select("doc_id", "text"), NEW, partial(_sketched, shingle, bands, depth, singles)).drop("text"))
    texts = written(made.where("doc_id is not null").groupBy("_h1", "_h2").agg(
        F.min("doc_id").alias("rep"), F.any_value("_n").alias("n"), F.any_value("_bands").alias("bands"), F.any_value("_hist").alias("hist")))
    comps = _linked(docs, texts.where(F.col("n") >= shingle).withColumn("text", F.col("_h1").bitwiseXOR(F.col("_h2"))), similarity, **search)
    classes = texts.select("_h1", "_h2", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("_h1", "_h2", F.col("rep").alias("text_class"), F.coalesce("comp", "rep").alias("class_id"))
    known = made.select("doc_id", "_h1", "_h2")
    hit = known.where("doc_id is not null").join(classes, ["_h1", "_h2"]).select("doc_id", "text_class", "class_id")
    return hit.unionByName(known.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("text_class"), F.lit(None).cast("long").alias("class_id")))


def _linked(docs: DataFrame, texts: DataFrame, similarity: float, **search: int) -> DataFrame:
    """(node, comp): components of the reps of linked texts."""
    pairs, large = candidates(texts.select("text", "n", "bands", "hist"), similarity, **search)
    comps = _aligned(docs, texts, written(pairs), similarity)
    links = written(rest(docs, large, texts, comps, similarity))
    return components(links.unionByName(comps.select(F.col("comp").alias("a"), F.col("node").alias("b")))) if links.limit(1).count() else comps


def _words(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(text, words): packed words of the texts of reps (text, rep)."""
    reps = written(reps)
    own = docs.select(F.col("doc_id").alias("rep"), F.col("text").alias("_text")).join(reps.select("rep").distinct().hint("merge"), "rep")  # the same plan at every size
    own = arrow_map(own, NEW[:2] + [T.StructField("words", T.BinaryType())], lambda: _identified, "_text").drop("_text")
    return written(own.select(F.col("_h1").bitwiseXOR(F.col("_h2")).alias("text"), "words").join(reps.select("text"), "text", "left_semi").dropDuplicates(["text"]))


def _aligned(docs: DataFrame, texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(node, comp): components of the reps of those pairs (a, b, times) of texts that are links."""
    reps = written(pairs.select(F.explode(F.array("a", "b")).alias("text")).distinct().join(texts.select("text", "rep"), "text"))
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("text").alias(side), F.col("rep").alias(f"r{side}")), side)
    pairs = pairs.where("ra <> rb")
    own, comps = _words(docs, reps), None
    for turn in [*TURNS, 0]:
        if comps is not None:
            now = pairs
            for side in "ab":
                now = now.join(comps.select(F.col("node").alias(f"r{side}"), F.col("comp").alias(f"c{side}")), f"r{side}", "left")
            pairs = now.where(F.coalesce("ca", "ra") != F.coalesce("cb", "rb")).select("a", "b", "ra", "rb", "times")
        pairs = written(pairs)
        best = Window.partitionBy("b").orderBy(F.desc("times"), "a")
        ranked = pairs.withColumn("_r", F.row_number().over(best)) if turn else pairs.withColumn("_r", F.lit(0))
        ranked = written(ranked) if turn else ranked
        now = ranked.where(F.col("_r") <= turn).drop("_r")
        for side in "ab":
            now = now.join(own.select(F.col("text").alias(side), F.col("words").alias(f"w{side}")), side)
        links = now.select("ra", "rb", "wa", "wb").mapInArrow(partial(_similar, similarity=similarity), "a long, b long")
        if comps is not None:
            links = links.unionByName(comps.select(F.col("comp").alias("a"), F.col("node").alias("b")))
        comps = components(links)
        pairs = ranked.where(F.col("_r") > turn).drop("_r")
    return comps


def _identified(col) -> list[pa.Array]:
    """What identifies each text's words, and their packed hashes."""
    whole, other, *_ = _sketched(SHINGLE, 0, 0, 0)(col)
    return [whole, other, *_packed(col)]


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the least doc_id of their class, one for each; rows without doc_id stay.

    Null, empty and blank texts are copies of one another. Of rows that share a doc_id the one with the least text stays
    (null first; rows of equal texts are equal to this operator). An empty table stays empty.
    """
    classes = near_duplicates(docs, **options)
    keep = classes.where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        first = Window.partitionBy("doc_id").orderBy("text")
        kept = kept.withColumn("_first", F.row_number().over(first)).where("_first = 1").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def op4(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
