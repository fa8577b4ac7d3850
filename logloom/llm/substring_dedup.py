"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the K-word sequences inside a WINDOW-word window, the one with the least hash (the last
of equals). Equal windows choose the same anchor at the same place, so two texts that share a window meet at it. Texts
are joined on their anchors; at anchors of more than one document, matches are extended both ways, as far as the
windows that chose the anchor reach, and a window repeats where a smaller doc_id has the same one. Runs of such windows
are the maximal repeats of at least WINDOW words.

Records travel packed: one binary row for each chunk of texts and bucket of anchors, so an anchor that many texts hold
takes one record for each chunk, not for each text. Rows that equal an earlier record of their chunk are settled there.
Buckets, and later groups of documents, get the spans in binary rows too. Both are hashed, and their number follows the
input's size.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import n_parts, new_columns

WINDOW, ANCHOR = 13, 5
_U = np.uint64
#: A record: anchor, document, its key, first window, number of windows; the windows' hashes follow in an array of their own.
HEAD = np.dtype([("anchor", "<u4"), ("doc", "<i8"), ("key", "<u8"), ("at", "<u4"), ("n", "u1")])
SPAN = np.dtype([("key", "<u8"), ("at", "<u4"), ("n", "u1")])
HASH_BYTES = 5
SCHEMA = "bucket int, part int, data binary"


def winnow(w: tc.Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window and number of windows of each anchor's run, the anchor's hash, and the hashes of all windows."""
    h = w.hashes()
    wins, fits = w.windows(h, window), w.fits(window)
    grams = w.windows(h, k)
    if not fits.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), wins
    reach = window - k + 1
    low = _U(0xFFFFFFFF)
    key = (grams & ~low) | (low - np.arange(len(grams)).astype(_U))
    size = 1
    m = key
    while 2 * size <= reach:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    if size < reach:
        m = np.minimum(m[: len(m) - (reach - size)], m[reach - size :])
    chosen = (low - (m[: len(wins)] & low)).astype(np.int64)
    at = np.flatnonzero(fits)
    new = np.ones(len(at), bool)
    new[1:] = (chosen[at[1:]] != chosen[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), grams[chosen[at[first]]], wins


def compressed(*arrays: np.ndarray) -> bytes:
    """Arrays as lengths and bytes, in columns that compress well."""
    raw = b"".join(len(b).to_bytes(8, "little") + b for b in (a.tobytes() for a in arrays))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="lz4", asbytes=True)


def expanded(data: bytes) -> list[bytes]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="lz4", asbytes=True)
    out, lo = [], 0
    while lo < len(raw):
        n = int.from_bytes(raw[lo : lo + 8], "little")
        out.append(raw[lo + 8 : lo + 8 + n])
        lo += 8 + n
    return out


def _delta(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def pack(head: np.ndarray, windows: np.ndarray) -> bytes:
    return compressed(head["anchor"], _delta(head["doc"]), _delta(head["key"]), _delta(head["at"]), head["n"], windows)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    p = expanded(data)
    head = np.zeros(len(p[4]), HEAD)
    head["anchor"], head["n"] = np.frombuffer(p[0], "<u4"), np.frombuffer(p[4], "u1")
    for name, raw in (("doc", p[1]), ("key", p[2]), ("at", p[3])):
        head[name] = np.cumsum(np.frombuffer(raw, HEAD[name]), dtype=HEAD[name])
    return head, np.frombuffer(p[5], np.uint8).reshape(-1, HASH_BYTES)


def pack_spans(spans: np.ndarray) -> bytes:
    return compressed(_delta(spans["key"]), _delta(spans["at"]), spans["n"])


def unpack_spans(data: bytes) -> np.ndarray:
    p = expanded(data)
    out = np.zeros(len(p[2]), SPAN)
    out["key"], out["at"], out["n"] = np.cumsum(np.frombuffer(p[0], "<u8"), dtype="<u8"), np.cumsum(np.frombuffer(p[1], "<u4"), dtype="<u4"), np.frombuffer(p[2], "u1")
    return out


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = n.astype(np.int64)
    return np.repeat(at - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def _split(spans: np.ndarray, parts: int):
    """(part, packed spans) rows."""
    to = np.ascontiguousarray(spans["key"]).view("<i8") % parts
    order = np.lexsort((spans["at"], spans["key"], to))
    spans, to = spans[order], to[order]
    cut = np.flatnonzero(np.diff(to, prepend=-1))
    for lo, hi in zip(cut, np.append(cut[1:], len(to)), strict=True):
        yield int(to[lo]), pack_spans(spans[lo:hi])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    b, p, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.int32()), pa.array(d, pa.binary())], names=["bucket", "part", "data"])


def _records(batches, window: int, k: int, buckets: int, parts: int, flush: int):
    """Rows of a bucket's records, or (with a part) of spans already settled."""
    heads, hashes, size, turn = [], [], 0, 0

    def rows():
        head, win = np.concatenate(heads), np.concatenate(hashes)
        begin = np.concatenate(([0], np.cumsum(head["n"], dtype=np.int64)))[:-1]
        # equal records of the chunk: only the smallest doc_id's goes on
        whole = np.add.reduceat(tc.mix(win + (np.arange(len(win)) - np.repeat(begin, head["n"])).astype(_U)), begin) ^ head["n"].astype(_U)
        order = np.lexsort((head["doc"], whole))
        s, d = whole[order], head["doc"][order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        least = d[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        later = np.zeros(len(s), bool)
        later[order[d > least]] = True
        settled = np.zeros(int(later.sum()), SPAN)
        for name in SPAN.names:
            settled[name] = head[name][later]
        nonlocal turn
        out = [((turn := (turn * 48271 + part + 1) % 2147483647) % buckets, part, data) for part, data in _split(settled, parts)] if len(settled) else []
        stay = np.flatnonzero(~later)
        to = head["bucket"][stay].astype(np.int64)
        order = np.argsort(to, kind="stable")
        stay, to = stay[order], to[order]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        body = win[:, None].view(np.uint8)[:, :HASH_BYTES]
        for lo, hi in zip(cut, np.append(cut[1:], len(to)), strict=True):
            own = head[stay[lo:hi]]
            out.append((int(to[lo]), None, pack(own, body[_ranges(begin[stay[lo:hi]], own["n"])])))
        return _batch(out)

    wide = np.dtype([*HEAD.descr, ("bucket", "<u4")])
    for b in batches:
        ids, keys, col = (b.column(b.schema.get_field_index(n)) for n in ("doc_id", "_key", "text"))
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        ids, keys = ids.fill_null(0).to_numpy().astype(np.int64), keys.to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
        for p in tc.pieces(col):
            w = tc.Words(p, tc.SPACE_WORD)
            at, n, anchor, wins = winnow(w, window, k)
            doc = np.searchsorted(w.off, at, "right") - 1
            use = valid[p.lo + doc]
            at, n, anchor, doc = at[use], n[use], anchor[use], doc[use]
            h = np.zeros(len(at), wide)
            h["anchor"], h["bucket"] = anchor & _U(0xFFFFFFFF), (anchor >> _U(32)) % _U(buckets)
            h["doc"], h["key"], h["at"], h["n"] = ids[p.lo + doc], keys[p.lo + doc], at - w.off[doc], n
            heads.append(h)
            hashes.append(wins[_ranges(at, n)])
            size += len(p.buf)
            if size >= flush:
                if sum(map(len, heads)):
                    yield rows()
                heads, hashes, size = [], [], 0
    if sum(map(len, heads)):
        yield rows()


def repeats(head: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Spans of a bucket's windows that a smaller document has."""
    order = np.argsort(head["anchor"], kind="stable")
    a, d = head["anchor"][order], head["doc"][order]
    cut = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    several = np.repeat(np.minimum.reduceat(d, cut) < np.maximum.reduceat(d, cut), np.diff(np.append(cut, len(a))))
    seeds = np.sort(order[several])
    if not len(seeds):
        return np.zeros(0, SPAN)
    begin = np.concatenate(([0], np.cumsum(head["n"], dtype=np.int64)))[:-1]
    own = head[seeds]
    # extension: each window that chose the anchor, compared with those of other documents at it
    wide = np.zeros((int(own["n"].sum()), 8), np.uint8)
    wide[:, :HASH_BYTES] = windows[_ranges(begin[seeds], own["n"])]
    which = np.repeat(np.arange(len(own)), own["n"])
    key = tc.mix(wide.view("<u8")[:, 0] ^ own["anchor"][which].astype(_U) << _U(32))
    doc = own["doc"][which]
    order = np.argsort(key)
    s, d = key[order], doc[order]
    cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    least = np.repeat(np.minimum.reduceat(d, cut), np.diff(np.append(cut, len(s))))
    again = np.zeros(len(s), bool)
    again[order[d > least]] = True
    lo, hi = tc.runs(again)
    inner = np.flatnonzero(np.diff(which, prepend=-1))  # runs end where records do
    pieces = np.unique(np.concatenate((lo, inner[again[inner]]))) if len(lo) else lo
    ends = np.minimum(hi[np.searchsorted(lo, pieces, "right") - 1], np.append(inner, len(s))[np.searchsorted(inner, pieces, "right")]) if len(lo) else lo
    out = np.zeros(len(pieces), SPAN)
    first = np.concatenate(([0], np.cumsum(own["n"], dtype=np.int64)))[:-1]
    r = which[pieces]
    out["key"], out["at"], out["n"] = own["key"][r], own["at"][r] + (pieces - first[r]), ends - pieces
    return out


def _group(table: pa.Table, parts: int) -> pa.Table:
    data, part, bucket = table.column("data"), table.column("part").to_pylist(), table.column("bucket").to_pylist()
    out, heads, wins = [], [], []
    for b, p, d in zip(bucket, part, data, strict=True):
        if p is None:
            h, w = unpack(d.as_py())
            heads.append(h)
            wins.append(w)
        else:
            out.append((b, p, d.as_py()))
    if heads:
        spans = repeats(np.concatenate(heads), np.concatenate(wins))
        if len(spans):
            out += [(bucket[0], p, d) for p, d in _split(spans, parts)]
    return pa.Table.from_batches([_batch(out)])


def _cut(left: pa.Table, right: pa.Table, names: list[str], window: int) -> pa.Table:
    spans = np.concatenate([np.zeros(0, SPAN), *(unpack_spans(d.as_py()) for d in right.column("data"))])
    spans = spans[np.argsort(spans["key"], kind="stable")]
    left = left.combine_chunks()
    keys = left.column("_key").to_numpy().astype(np.int64).view(_U)
    lo, hi = np.searchsorted(spans["key"], keys), np.searchsorted(spans["key"], keys, "right")
    col = left.column("text")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n_words, n_removed, sha, kept, whole = [], [], [], [], col.is_valid().to_pylist()
    for p in tc.pieces(col):
        w = tc.Words(p, tc.SPACE_WORD)
        for i in range(p.n):
            k = p.lo + i
            n = int(w.off[i + 1] - w.off[i])
            text = p.text(i)
            removed = 0
            if hi[k] > lo[k] and n:
                diff = np.zeros(n + 1, np.int64)
                own = spans[lo[k] : hi[k]]
                np.add.at(diff, own["at"].astype(np.int64), 1)
                np.add.at(diff, np.minimum(n, own["at"].astype(np.int64) + own["n"] + window - 1), -1)
                stay = np.cumsum(diff)[:-1] == 0
                removed = n - int(stay.sum())
                if removed:
                    a, b = tc.runs(stay)
                    start, end = w.start[w.off[i] : w.off[i + 1]], w.end[w.off[i] : w.off[i + 1]]
                    runs = [w.buf[start[x] : end[y - 1]].tobytes() for x, y in zip(a, b, strict=True)]
                    text = b"\n".join(runs)
            n_words.append(n)
            n_removed.append(removed)
            sha.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
            kept.append(text.decode("utf-8", "replace") if whole[k] else None)
    new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
    return pa.Table.from_arrays([left.column(n) for n in names] + new, names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"])


NEW = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chunk_bytes: int = 12 << 20) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 (of the kept words, joined by one blank) and kept_text (kept stretches as they stood, joined by newlines).

    A word goes where a window of `window` words that covers it also starts in a document of smaller doc_id; windows
    are judged on the input. A document without a doc_id takes no part and keeps all; rows that share a doc_id don't
    count against one another; repeated rows get equal results. Null texts have no words and stay null; empty and short
    ones stay as they are. Other columns stay, save those of the new names and _key and _part, which the operator uses. An empty table gives an empty result.
    """
    kept, schema = new_columns(docs.drop("_key", "_part"), NEW)
    names = [f.name for f in kept]
    parts = n_parts(docs)
    keyed = docs.select(*[F.col(f"`{n}`") for n in names]).withColumn("_key", F.xxhash64("doc_id", "text"))
    records = keyed.select("doc_id", "_key", "text").mapInArrow(partial(_records, window=window, k=anchor, buckets=2 * parts, parts=parts, flush=chunk_bytes), SCHEMA)
    spans = records.groupBy("bucket").applyInArrow(lambda t: _group(t, parts), SCHEMA).select("part", "data")
    left = keyed.withColumn("_part", F.pmod("_key", F.lit(parts)).cast("int"))
    return left.groupBy("_part").cogroup(spans.groupBy("part")).applyInArrow(lambda a, b: _cut(a, b, names, window), schema)


def op1(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
