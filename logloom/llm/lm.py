"""Language-model scores: a class-factored log-bilinear model of all words, and exact token counts over the whole corpus.

Words are counted over all training rows first. Symbols are the text's end, the OWN most frequent words (as many as were
seen LEAST times, SHORTLIST at least), and hashed symbols that share out all other words; both kinds grow with the corpus up
to their bounds. A word of a hashed symbol has in it the share that its count has. The end and the shortlist are a class
each, other symbols are classes by frequency; the probability of a class, and of a symbol in its class, given the two
symbols before, is log-bilinear (context matrices times vectors, dotted with the class's or symbol's vector, plus a
bias), normalised exactly by batched matrix products. Training is noise-contrastive, with exact shares as noise, over all
training rows in ROUNDS parts: trainers begin each round with the averages of the round before, and a symbol's vector is
averaged by how often each trainer has seen it. Averages of trainers that each see little would stay near the start, so
a trainer is given TRAINED tokens a round at least: how many there are follows from the tokens, not from the table's
partitions, and rows go to them by a hash.

Counts: those of the HEAD most frequent words go to all tasks. Occurrences of all other words meet in buckets of their
hash, where they are counted and turned at once into sums for each document, which go back to it in packed rows. No
table of all words is ever gathered.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import crc_mod, n_parts, written
from .substring_dedup import _batch, _delta, compressed, expanded

FOLDS, HELD = 7, 2
HEAD, SHORTLIST, DIM = 32_768, 254, 24
#: Words with a symbol of their own: seen LEAST times, OWN of them at most; and hashed symbols, a REST-th as many.
OWN, LEAST, REST = 12_288, 100, 4
#: The end of a text (also what stands before it); then words by frequency, then hashed symbols.
END = 0
ROUNDS, BATCH, NOISE, INNER, RATE, SEED = 3, 2048, 48, 8, 0.05, 5
#: Tokens of a class that are multiplied at a time; bits of a hash that its search among the head words begins with;
#: symbols whose pairs have their sums over classes in a table.
GROUP, FIRST_BITS, PAIRS = 16, 17, 1024
#: Tokens a trainer sees in a round, and trainers at most (then each sees more).
TRAINED, TRAINERS = 1 << 20, 1024
#: Rows of parameters a record, tokens scored at once, words counted before a task hands them on.
BLOCK, SCORED_AT_ONCE, COUNTED = 256, 512, 1 << 21
_U = np.uint64
END_HASH = _U(0x51AB1E0FD0C5E5D1)
SCHEMA = "bucket int, part int, data binary"


def tokens(piece: tc.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lowered words and one end of each text, and first token of each text (with the total last)."""
    w = tc.Words(piece, tc.SPACE_WORD, lower=True)
    off = w.off + np.arange(piece.n + 1)
    out = np.full(off[-1], END_HASH, _U)
    words = np.ones(len(out), bool)
    words[off[1:] - 1] = False
    out[words] = w.hashes()
    return out, off


def hashed(h: np.ndarray, rest: int) -> np.ndarray:
    return ((h >> _U(32)) % _U(rest)).astype(np.int64)


class Head:
    """Places of the head words' hashes; the end comes first. The first `own` places are symbols, `rest` hashed ones follow."""

    def __init__(self, by_frequency: np.ndarray, own: int, rest: int) -> None:
        self.words = np.concatenate(([END_HASH], by_frequency[by_frequency != END_HASH])).astype(_U)[: HEAD + 1]
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]
        self.own, self.rest = own, rest
        self.first = None  # made in the task: where the hashes of each value of the FIRST_BITS highest bits begin

    def places(self, h: np.ndarray) -> np.ndarray:
        """-1 for words outside."""
        shift = _U(64 - FIRST_BITS)
        if self.first is None:
            first = np.append(np.searchsorted(self.sorted, np.arange(1 << FIRST_BITS, dtype=_U) << shift), len(self.sorted)).astype(np.int32)
            self.first, self.most = first, int(np.diff(first).max())
            self.bounded, self.place = np.append(self.sorted, ~_U(0)), np.append(self.order, -1)
        at = self.first.take((h >> shift).astype(np.int64))
        for _ in range(self.most):
            at += self.bounded.take(at) < h
        return np.where(self.bounded.take(at) == h, self.place.take(at), -1)

    def symbols(self, places: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.where((places >= 0) & (places < self.own), places, self.own + hashed(h, self.rest))


def contexts(symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each token; END before a text's beginning."""
    one, two = np.full(len(symbols), END), np.full(len(symbols), END)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    begin = off[:-1]
    one[begin] = END
    two[begin] = END
    two[np.minimum(begin + 1, len(symbols) - 1)] = END
    return one, two


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    edge = np.flatnonzero(x[1:] != x[:-1]) + 1
    cut = np.zeros(len(edge) + 1, np.int64)
    cut[1:] = edge
    sizes = np.empty_like(cut)
    sizes[:-1] = edge - cut[:-1]
    sizes[-1] = len(x) - cut[-1]
    return cut, sizes


def _sums(g: np.ndarray, cut: np.ndarray, sizes: np.ndarray, order: np.ndarray | None = None, layers: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Sums of g's rows (of g[order]'s) over runs, longest runs first, and which run each is of.

    Most runs are short: the first rows of all runs are added, then the second ones, and so on for `layers` rows. Only
    what longer runs have beyond is reduced run by run.
    """
    which = np.argsort(-sizes, kind="stable")
    cut, sizes = cut.take(which), sizes.take(which)
    longer = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, layers + 1), "right")

    def rows(i: np.ndarray) -> np.ndarray:
        return g.take(i if order is None else order.take(i), axis=0)

    out = rows(cut)
    for k, m in enumerate(longer[:-1].tolist(), 1):
        out[:m] += rows(cut[:m] + k)
    m = longer[-1]
    if m:
        n = sizes[:m] - layers
        end = np.cumsum(n)
        out[:m] += np.add.reduceat(rows(np.repeat(cut[:m] + layers - (end - n), n) + np.arange(end[-1])), end - n, axis=0)
    return which, out


class LogBilinear:
    """Symbols in order of frequency; the first `singles` are a class each, the others classes of about the root of their number.

    Rows of parameters are those of symbols, of classes, and of the two context matrices: DIM values, a bias, and the
    means of Adagrad's sums for both.
    """

    def __init__(self, unigram: np.ndarray, singles: int = SHORTLIST + 1) -> None:
        rng = np.random.default_rng(SEED)
        n = len(unigram)
        self.singles = min(n, singles)
        size = max(1, math.isqrt(max(0, n - self.singles)))
        self.begin = np.concatenate((np.arange(self.singles), np.arange(self.singles, n, size), [n]))
        self.k = len(self.begin) - 1
        self.of = np.repeat(np.arange(self.k), np.diff(self.begin))
        self.share = (unigram + 1) / (unigram + 1).sum()
        self.classes = np.add.reduceat(self.share, self.begin[:-1])
        self.inner = (self.share / self.classes[self.of]).astype(np.float32)
        self.rows = np.zeros((n + self.k + 2 * DIM, DIM + 3), np.float32)
        self.rows[: n + self.k, :DIM] = rng.normal(size=(n + self.k, DIM)) * 0.1
        self.rows[n + self.k :, :DIM] = np.concatenate((np.eye(DIM), 0.5 * np.eye(DIM)))
        self.rows[: n + self.k, DIM] = np.log(np.concatenate((self.inner, self.classes)))
        self.rows[:, DIM + 1 :] = 1e-6

    def parts(self) -> tuple[np.ndarray, ...]:
        """Vectors and biases of symbols, then of classes, and the context matrices."""
        n, k, x = len(self.of), self.k, self.rows
        return x[:n, :DIM], x[:n, DIM], x[n : n + k, :DIM], x[n : n + k, DIM], x[n + k : n + k + DIM, :DIM], x[n + k + DIM :, :DIM]

    def trainer(self):
        """A function that makes one pass of NCE with Adagrad over given tokens.

        Noise is shared: NOISE classes by all tokens of a batch, INNER symbols of a class by the batch's tokens of it.
        """
        rng = np.random.default_rng(SEED)
        n = len(self.of)
        p = np.ascontiguousarray(self.rows[:, : DIM + 1])  # vectors with their biases, which stand for a last 1 of the context
        sums = np.concatenate((np.repeat(self.rows[:, DIM + 1 : DIM + 2], DIM, 1), self.rows[:, DIM + 2 :]), 1)
        within, between = np.concatenate(([0], np.cumsum(self.share))), np.cumsum(self.classes)
        log_class, log_inner = np.log(NOISE * self.classes).astype(np.float32), np.log(INNER * self.inner)
        of, begin = self.of.astype(np.int32), self.begin
        c_rows = np.arange(n + self.k, len(p))
        small = np.uint16 if len(p) < 1 << 16 else np.int32  # sorts faster
        c = p[n + self.k :].reshape(2, DIM, DIM + 1)

        def noisy(z: np.ndarray) -> np.ndarray:
            """The logistic function of -z, in place."""
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1
            return np.reciprocal(z, out=z)

        def step(stream: np.ndarray, at: np.ndarray) -> None:
            first = at[0] - 2
            near = stream[first : at[-1] + 1]  # the batch's symbols with those before them
            place, v = at - first, p.take(near, axis=0)
            m = np.zeros((2, DIM + 1, DIM + 1), np.float32)
            m[:, :DIM, :DIM] = c[:, :, :DIM]
            context = v[1:-1] @ m[0]
            context += v[:-2] @ m[1]
            context[:, DIM] = 1
            cls = of.take(near.take(place))
            order = np.argsort(cls.astype(small), kind="stable")
            place, cls = place.take(order), cls.take(order)
            q = context.take(place - 2, axis=0)
            noise = np.minimum(np.searchsorted(between, rng.random(NOISE) * between[-1], "right"), self.k - 1)
            cut, sizes = _runs(cls)
            other = p.take(n + noise, axis=0)
            shifted = -other
            shifted[:, DIM] += log_class[noise]
            gn = noisy(q @ shifted.T)
            dq = gn @ other
            keys, grads = [near, n + noise], [gn.T @ q]
            g = np.zeros((len(near), DIM + 1), np.float32)
            i = int(np.searchsorted(cls, self.singles))
            k = int(np.searchsorted(cut, i))  # the first class with symbols of its own
            if i:
                target = p.take(n + cls[:i], axis=0)
                gt = noisy(log_class.take(cls[:i]) - np.einsum("bd,bd->b", q[:i], target)) - 1
                target *= gt[:, None]
                dq[:i] += target
                keys.append(n + cls[cut[:k]])
                grads.append(np.add.reduceat(gt[:, None] * q[:i], cut[:k], axis=0))
            if i < len(cls):
                pi, qi = place[i:], q[i:]
                wi = near.take(pi)
                own = cls[cut[k:]]
                lo, hi = begin[own], begin[own + 1]
                z = within[lo][:, None] + (within[hi] - within[lo])[:, None] * rng.random((len(own), INNER))
                z = np.clip(np.searchsorted(within, z, "right") - 1, lo[:, None], hi[:, None] - 1)
                expected = np.concatenate((log_inner.take(z), log_class.take(own)[:, None]), 1)
                z = np.concatenate((z, n + own[:, None]), 1)  # the class stands behind its noise
                ri, rz = v.take(pi, axis=0), p.take(z, axis=0)
                ht = noisy(log_inner.take(wi) - np.einsum("bd,bd->b", qi, ri)) - 1
                # the tokens of a class in groups of GROUP places, the last one filled up with zeros
                groups = -(-sizes[k:] // GROUP)
                begins = np.cumsum(groups) - groups
                spot = np.repeat(begins * GROUP - (cut[k:] - i), sizes[k:]) + np.arange(len(wi))
                qs = np.zeros((groups.sum(), GROUP, DIM + 1), np.float32)
                qs.reshape(-1, DIM + 1)[spot] = qi
                group = np.repeat(np.arange(len(own)), groups)
                rs = -rz
                rs[:, :, DIM] += expected
                hn = noisy(np.matmul(qs, rs.take(group, axis=0).transpose(0, 2, 1)))
                hn[:, :, INNER] -= 1
                g[pi] = ht[:, None] * qi
                ri *= ht[:, None]
                ri += np.matmul(hn, rz.take(group, axis=0)).reshape(-1, DIM + 1).take(spot, axis=0)
                dq[i:] += ri
                which, inner = _sums(np.matmul(hn.transpose(0, 2, 1), qs).reshape(len(qs), -1), begins, groups)
                keys.append(z[which].ravel())
                grads.append(inner.reshape(-1, DIM + 1))
            d = np.zeros_like(context)  # in the stream's order again
            d[place - 2] = dq
            g[1:-1] += d @ m[0].T
            g[:-2] += d @ m[1].T
            of_c = np.stack((v[1:-1].T @ d, v[:-2].T @ d))[:, :DIM]
            of_c[:, :, DIM] = 0
            keys, g = np.concatenate([*keys, c_rows]), np.concatenate([g, *grads, of_c.reshape(2 * DIM, DIM + 1)])
            order = np.argsort(keys.astype(small), kind="stable")
            keys = keys.take(order)
            cut, sizes = _runs(keys)
            which, g = _sums(g, cut, sizes, order)
            keys = keys.take(cut.take(which))
            g *= np.float32(1 / len(place))
            new = sums.take(keys, axis=0)
            new += g * g
            sums[keys] = new
            g *= np.float32(RATE)
            g /= np.sqrt(new, out=new)
            p[keys] = np.subtract(p.take(keys, axis=0), g, out=g)

        def run(symbols: np.ndarray, off: np.ndarray) -> None:
            # two ENDs stand before each text
            at = np.arange(len(symbols)) + 2 * np.repeat(np.arange(1, len(off)), np.diff(off))
            stream = np.full(len(symbols) + 2 * (len(off) - 1), END)
            stream[at] = symbols
            for lo in range(0, len(symbols), BATCH):
                step(stream, at[lo : lo + BATCH])
            self.rows[:, : DIM + 1] = p
            self.rows[:, DIM + 1], self.rows[:, DIM + 2] = sums[:, :DIM].mean(1), sums[:, DIM]

        return run

    def scorer(self):
        """A function of symbols and the ones before them: log10 P(symbol | two before, one before)."""
        r, _, _, _, c0, c1 = self.parts()
        n = len(r)
        r1, r2 = np.zeros((n, DIM + 1), np.float32), np.zeros((n, DIM + 1), np.float32)
        r1[:, :DIM], r2[:, :DIM], r1[:, DIM] = r @ c0, r @ c1, 1
        r, s = np.ascontiguousarray(self.rows[:n, : DIM + 1]), np.ascontiguousarray(self.rows[n : n + self.k, : DIM + 1])

        def total(q: np.ndarray, v: np.ndarray) -> np.ndarray:
            """Logs of sums of exponentials; q ends in a 1, v in the biases."""
            z = q @ v.T
            with np.errstate(over="ignore"):
                sums = np.exp(z, out=z) @ np.ones(z.shape[1], np.float32)
            out = np.log(np.maximum(sums, 1e-37))
            odd = np.flatnonzero(~((sums > 1e-30) & (sums < 1e30)))
            if len(odd):  # beyond single precision's range
                z = q[odd] @ v.T
                top = z.max(1)
                out[odd] = np.log(np.exp(z - top[:, None]).sum(1)) + top
            return out

        def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Exponentials of the rows of v without their largest, and that."""
            most = v.max(1)
            v -= most[:, None]
            return np.exp(v, out=v), most

        # exp(q s) of the sum q = r1 + r2 is a product, so that a sum over classes is one of two tables' rows
        e1, most1 = scaled(r1 @ s.T)
        e2, most2 = scaled(r2 @ s.T)

        # these sums for all pairs of the first PAIRS symbols, but those that single precision does not hold
        pairs = e1[:PAIRS] @ e2[:PAIRS].T
        pairs[pairs < 1e-6] = np.nan
        pairs = np.log(pairs, out=pairs) + most1[:PAIRS, None] + most2[:PAIRS]
        small = np.uint16 if n < 1 << 16 else np.int32  # sorts faster

        def between(q: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
            """Logs of the sums over classes."""
            out = np.full(len(q), np.nan, np.float32)
            often = np.flatnonzero((one < len(pairs)) & (two < len(pairs)))
            out[often] = pairs[one.take(often), two.take(often)]
            order = np.flatnonzero(np.isnan(out))
            order = order.take(np.argsort(two.take(order).astype(small), kind="stable"))  # equal rows of the second table follow each other
            for lo in range(0, len(order), SCORED_AT_ONCE):
                at = order[lo : lo + SCORED_AT_ONCE]
                i, j = one.take(at), two.take(at)
                sums = np.einsum("ij,ij->i", e1.take(i, axis=0), e2.take(j, axis=0))
                logs = np.log(np.maximum(sums, 1e-37)) + most1.take(i) + most2.take(j)
                odd = np.flatnonzero(sums < 1e-6)  # both have their largest in other classes: little is left of single precision
                if len(odd):
                    logs[odd] = total(q[at[odd]], s)
                out[at] = logs
            return out

        def score(w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
            q = r1.take(one, axis=0)
            q += r2.take(two, axis=0)
            cls = self.of[w]
            out = np.einsum("ij,ij->i", q, s.take(cls, axis=0)) - between(q, one, two)
            inner = np.flatnonzero(cls >= self.singles)
            order = inner[np.argsort(cls[inner].astype(small), kind="stable")]
            edge = np.searchsorted(cls[order], np.arange(self.singles, self.k + 1))
            x = q.take(order, axis=0)
            logs = np.einsum("ij,ij->i", x, r.take(w[order], axis=0))
            for c, lo, hi in zip(range(self.singles, self.k), edge[:-1], edge[1:], strict=True):
                v = r[self.begin[c] : self.begin[c + 1]]
                for at in range(lo, hi, SCORED_AT_ONCE):
                    end = min(hi, at + SCORED_AT_ONCE)
                    logs[at:end] -= total(x[at:end], v)
            out[order] += logs
            return out / np.float32(np.log(10))

        return score

    def log10(self) -> np.ndarray:
        """log10 P(symbol | two before, one before), for all contexts."""
        n = len(self.of)
        two, one, w = (x.ravel() for x in np.indices((n, n, n)))
        return self.scorer()(w, one, two).reshape(n, n, n)


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _counted(batches):
    """(word, count), each word once for each COUNTED distinct words at least."""
    held = [(np.zeros(0, _U), np.zeros(0, np.int64))]

    def merged():
        u, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return u, np.bincount(at, np.concatenate([n for _, n in held]), len(u)).astype(np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1], pa.int64())], names=["h", "n"])

    for b in batches:
        for p in tc.pieces(_column(b, "text")):
            held.append(np.unique(tokens(p)[0], return_counts=True))
            if sum(len(x) for x, _ in held[1:]) > COUNTED // 4:
                held = [merged()]
                if len(held[0][0]) > COUNTED:
                    yield rows()
                    held = [(np.zeros(0, _U), np.zeros(0, np.int64))]
    held = [merged()]
    if len(held[0][0]):
        yield rows()


def _trained(batches, head: Head, model: LogBilinear):
    """Blocks of the parameters' rows, with how often the task has seen what each stands for."""
    seen, train, start = np.zeros(len(model.of), np.int64), model.trainer(), model.rows.copy()
    for b in batches:
        for p in tc.pieces(_column(b, "text")):
            h, off = tokens(p)
            symbols = head.symbols(head.places(h), h)
            seen += np.bincount(symbols, minlength=len(seen))
            train(symbols, off)
    rows = model.rows.copy()
    model.rows[:] = start
    if seen.any():
        weight = np.concatenate((seen, np.add.reduceat(seen, model.begin[:-1]), np.full(2 * DIM, seen.sum())))
        yield _batch([(lo, None, compressed(rows[lo : lo + BLOCK], weight[lo : lo + BLOCK])) for lo in range(0, len(rows), BLOCK)])


def _averaged(table: pa.Table) -> pa.Table:
    """The mean of a block over tasks, by what they have seen; plain for rows that none has seen."""
    total, weights = 0.0, 0.0
    for d in table.column("data"):
        rows, seen = expanded(d.as_py())
        weight = np.frombuffer(seen, "<i8") + 1e-3
        total = total + np.frombuffer(rows, "<f4").reshape(len(weight), DIM + 3) * weight[:, None]
        weights = weights + weight
    return pa.Table.from_batches([_batch([(table.column("bucket")[0].as_py(), None, (total / weights[:, None]).astype("<f4").tobytes())])])


class Tails:
    """Packed (word, document, training) records of the words outside the head, by bucket, handed on every `flush` words."""

    def __init__(self, buckets: int, flush: int) -> None:
        self.buckets, self.flush, self.cols, self.size = buckets, flush, [[] for _ in range(4)], 0

    def add(self, h: np.ndarray, ids: np.ndarray, tag: np.ndarray, learn: np.ndarray) -> None:
        for c, x in zip(self.cols, (h, ids.astype("<i8"), tag.astype("<u2"), learn), strict=True):
            c.append(x)
        self.size += len(h)

    def rows(self, end: bool = False) -> list[tuple[int, bytes]]:
        if not self.size or not (end or self.size >= self.flush):
            return []
        h, ids, tag, learn = (np.concatenate(c) for c in self.cols)
        self.cols, self.size = [[] for _ in range(4)], 0
        to = (h % _U(self.buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.diff(to[order], prepend=-1))
        out = []
        for lo, hi in zip(cut, np.append(cut[1:], len(to)), strict=True):
            k = order[lo:hi]
            out.append((int(to[k[0]]), compressed(h[k], _delta(ids[k]), tag[k] | learn[k].astype("<u2") << np.uint16(15))))
        return out


def _summed(table: pa.Table, parts: int) -> pa.Table:
    """Counts of a bucket's words, as sums for each document."""
    h, ids, tag = ([] for _ in range(3))
    for d in table.column("data"):
        a, b, c = expanded(d.as_py())
        h.append(np.frombuffer(a, "<u8"))
        ids.append(np.cumsum(np.frombuffer(b, "<i8"), dtype="<i8"))
        tag.append(np.frombuffer(c, "<u2"))
    h, ids, tag = np.concatenate(h), np.concatenate(ids), np.concatenate(tag)
    learn, tag = tag >> 15, tag & np.uint16(0x7FFF)
    order = np.argsort(h)
    s = h[order]
    cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    n = np.add.reduceat(learn[order].astype(np.int64), cut)
    c = np.empty(len(h), np.int64)
    c[order] = np.repeat(n, np.diff(np.append(cut, len(s))))
    order = np.lexsort((tag, ids))
    i, t, c = ids[order], tag[order], c[order]
    cut = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]))))
    logs, known = np.add.reduceat(np.log10(c + 1.0), cut), np.add.reduceat((c > 0).astype(np.int64), cut).astype("<u4")
    i, t = i[cut], t[cut]
    to = i % parts
    order = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.diff(to[order], prepend=-1))
    bucket = table.column("bucket")[0].as_py()
    out = []
    for lo, hi in zip(edge, np.append(edge[1:], len(to)), strict=True):
        k = order[lo:hi]
        out.append((bucket, int(to[k[0]]), compressed(_delta(i[k]), t[k], logs[k], known[k])))
    return pa.Table.from_batches([_batch(out)])


SCORED = "doc_id long, held_out boolean, _id long, _tag int, n_tokens long, head_known long, head_logs double, model_logs double"
PASSED = SCORED + ", bucket int, data binary"


def _scored(batches, head: Head, counts: np.ndarray, model: LogBilinear, sizes: np.ndarray, buckets: int, flush: int):
    """Scores of each text, and (with a bucket) records of its words outside the head; sizes: log10 of what counts in each hashed symbol are divided by."""
    score, logs, tails = model.scorer(), np.log10(counts + 1.0), Tails(buckets, flush)
    names = [x.split()[0] for x in PASSED.split(", ")]
    own = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def records(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in own), pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=names)

    for b in batches:
        out = [[] for _ in range(4)]
        ids, tags = (_column(b, n).to_numpy(zero_copy_only=False) for n in ("_id", "_tag"))
        learn = ~_column(b, "held_out").to_numpy(zero_copy_only=False)
        for p in tc.pieces(_column(b, "text")):
            h, off = tokens(p)
            at = head.places(h)
            sym = head.symbols(at, h)
            one, two = contexts(sym, off)
            inside = at >= 0
            log = np.where(inside, logs[at], 0.0)
            lo, hi = off[:-1], off[1:]
            other = sym >= head.own
            # what a hashed symbol's words outside the head have of it comes with the tails
            model_log = score(sym, one, two) + np.where(other, log - sizes[np.maximum(sym - head.own, 0)], 0.0)
            for c, x in zip(out, (np.diff(off), tc.per_text(inside & (counts[at] > 0), lo, hi), tc.per_text(log, lo, hi), tc.per_text(model_log, lo, hi)), strict=True):
                c.append(x)
            beyond = np.flatnonzero(~inside)
            doc = np.searchsorted(off, beyond, "right") - 1 + p.lo
            tails.add(h[beyond], ids[doc], tags[doc], learn[doc])
            if rows := tails.rows():
                yield records(rows)
        new = [pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, own[4:], strict=True)]
        yield pa.RecordBatch.from_arrays([_column(b, n) for n in names[:4]] + new + [pa.nulls(len(b), pa.int32()), pa.nulls(len(b), pa.binary())], names=names)
    if rows := tails.rows(end=True):
        yield records(rows)


def _joined(left: pa.Table, right: pa.Table) -> pa.Table:
    i, t, s, k = [np.zeros(0, "<i8")], [np.zeros(0, "<u2")], [np.zeros(0)], [np.zeros(0, "<u4")]
    for d in right.column("data"):
        a, b, c, e = expanded(d.as_py())
        i.append(np.cumsum(np.frombuffer(a, "<i8"), dtype="<i8"))
        t.append(np.frombuffer(b, "<u2"))
        s.append(np.frombuffer(c, "<f8"))
        k.append(np.frombuffer(e, "<u4"))
    i, t, s, k = (np.concatenate(x) for x in (i, t, s, k))
    order = np.lexsort((t, i))
    i, t, s, k = i[order], t[order], np.concatenate(([0], np.cumsum(s[order]))), np.concatenate(([0], np.cumsum(k[order], dtype=np.int64)))
    cut = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])))) if len(i) else np.zeros(0, np.int64)
    sums = {(x, y): (s[hi] - s[lo], k[hi] - k[lo]) for x, y, lo, hi in zip(i[cut].tolist(), t[cut].tolist(), cut, np.append(cut[1:], len(i)), strict=True)} if len(i) else {}
    keys = list(zip(left.column("_id").to_pylist(), left.column("_tag").to_pylist(), strict=True))
    copies = Counter(keys)  # equal rows share a key, and the sums are those of all of them
    own = [(*sums.get(key, (0.0, 0)), copies[key]) for key in keys]
    return left.append_column("tail_logs", pa.array([float(x) / n for x, _, n in own], pa.float64())).append_column("tail_known", pa.array([int(x) // n for _, x, n in own], pa.int64()))


def score_texts(docs: DataFrame, folds: int = FOLDS, held: int = HELD, flush: int = 1 << 19) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Learns from rows whose crc32(doc_id) modulo `folds` is not `held`. A null text is empty: its only token is the end.
    A null doc_id counts as an empty one for the fold. Repeated rows are scored alike, and counted each. With no
    training row all counts are 0. Other columns are ignored; an empty table gives an empty result.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"))
    learn = d.where(~F.col("held_out"))
    counted = written(learn.select("text").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    end = int(END_HASH.astype(np.int64))
    top = counted.where(F.col("h") != end).orderBy(F.desc("n"), "h").limit(HEAD).collect()
    rows = sum(r["n"] for r in counted.where(F.col("h") == end).collect())  # each row has one end
    seen = {r["h"]: r["n"] for r in top} | {end: rows}
    own = min(OWN, max(SHORTLIST, sum(r["n"] >= LEAST for r in top)), len(top)) + 1
    head = Head(np.array([r["h"] for r in top], np.int64).view(_U), own, 1 + own // REST)
    own = head.own = min(own, len(head.words))
    counts = np.array([seen[int(x)] for x in head.words.view(np.int64)], np.int64)
    # hashed symbols: counts and kinds of all words, without those that have symbols of their own
    to = hashed(head.words[:own], head.rest)
    other_n, other_kinds = -np.bincount(to, counts[:own], head.rest), -np.bincount(to, counts[:own] > 0, head.rest)
    n = kinds = 0
    for r in counted.groupBy(F.pmod(F.shiftrightunsigned("h", 32), F.lit(head.rest)).cast("int").alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        other_n[r["s"]] += r["n"]
        other_kinds[r["s"]] += r["k"]
        n, kinds = n + r["n"], kinds + r["k"]
    model = LogBilinear(np.concatenate((counts[:own], other_n)))
    trainers = max(1, min(TRAINERS, round(n / (ROUNDS * TRAINED))))
    for turn in range(ROUNDS):
        some = learn.select("text", F.xxhash64(F.lit(3), "doc_id", "text").alias("_k")).where(F.pmod("_k", F.lit(ROUNDS)) == turn)
        some = some.repartition(trainers, "_k").sortWithinPartitions("_k").select("text")  # in an order that a rerun has, too
        for r in some.mapInArrow(partial(_trained, head=head, model=model), SCHEMA).groupBy("bucket").applyInArrow(_averaged, SCHEMA).collect():
            x = np.frombuffer(r["data"], "<f4").reshape(-1, DIM + 3)
            model.rows[r["bucket"] : r["bucket"] + len(x)] = x
    parts = n_parts(docs)
    keyed = d.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))).withColumn("_tag", F.xxhash64("text").bitwiseAND(0x7FFF).cast("int"))
    make = partial(_scored, head=head, counts=counts, model=model, sizes=np.log10(other_n + other_kinds + 1), buckets=2 * parts, flush=flush)
    passed = written(keyed.select("doc_id", "held_out", "_id", "_tag", "text").mapInArrow(make, PASSED))
    tails = passed.where("bucket is not null").select("bucket", F.lit(None).cast("int").alias("part"), "data")
    tails = written(tails.groupBy("bucket").applyInArrow(lambda t: _summed(t, parts), SCHEMA))
    scored = passed.where("bucket is null").drop("bucket", "data")
    back = tails.select("part", "data")
    out = scored.groupBy(F.pmod("_id", F.lit(parts)).cast("int").alias("_part")).cogroup(back.groupBy("part")).applyInArrow(lambda a, b: _joined(a, b), SCORED + ", tail_logs double, tail_known long")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.col("tail_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.col("tail_logs") - F.col("n_tokens") * float(np.log10(n + kinds + 1))).alias("base_score"),
        (F.col("model_logs") + F.col("tail_logs")).alias("score"),
    )


def op8(docs: DataFrame) -> DataFrame:
    return score_texts(docs)
