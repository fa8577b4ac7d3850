"""Token counts by a public BPE vocabulary, without token ids.

Texts are cut into blank-led stretches, which no pre-token crosses. In each step of some MB the distinct stretches are
found, and cut into pre-tokens; pieces are counted once for each distinct pre-token (bounded memos carry counts over to
later steps of the task). A document's frequencies of stretches are joined to these counts and summed up. All but the
distinct stretches stay in Arrow and numpy. No shuffle: a count depends on nothing but the vocabulary file.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pre-token pattern of byte-level BPE vocabularies; its white space is Unicode's. Fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: White space before a blank, where a pre-token may cross the blank (RE2).
CROSSING = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
#: Entries, and longest key, of the memos that a task keeps from batch to batch.
MEMO, MEMO_CHARS = 400_000, 64


class Memo(dict):
    """A dict that fills itself for many keys at once and stays bounded."""

    def __init__(self, make: Callable[[list[str]], list[int]]) -> None:
        super().__init__()
        self.make, self.long = make, []

    def fill(self, keys: set[str]) -> None:
        for k in self.long:
            self.pop(k, None)
        if len(self) > MEMO:
            self.clear()
        new = list(keys.difference(self))
        self.update(zip(new, self.make(new), strict=True))
        self.long = [k for k in new if len(k) > MEMO_CHARS]


def pieces_of(vocabulary: str) -> Callable[[list[str]], list[int]]:
    """From pre-tokens of a byte-level BPE .json file to their numbers of pieces."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(as_byte[c] for c in t): i for t, i in vocab.items() if all(c in as_byte for c in t)}
    singles = [ranks[bytes([b])] for b in range(256) if bytes([b]) in ranks]
    order = [vocab.get("".join(m), -1) for m in merges]
    if model["type"] == "BPE" and len(singles) == 256 and order == sorted(set(order)) and max(singles) < order[0] and order[0] >= 0:  # a merge's rank is its id
        encode = tiktoken.Encoding("given", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        return lambda new: [1 if (k := p.encode()) in ranks else len(encode(k)) for p in new]
    tok = Tokenizer.from_file(vocabulary)
    return lambda new: [len(e) for e in tok.encode_batch(new, add_special_tokens=False)]


def counter(vocabulary: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for a byte-level BPE .json file, equal to the library's encode without added special tokens."""
    import regex
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    pre, added = spec.get("pre_tokenizer") or {}, spec["added_tokens"]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        tok = Tokenizer.from_file(vocabulary)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(e) for e in tok.encode_batch(texts.to_pylist() if isinstance(texts, pa.Array) else texts, add_special_tokens=False)]
    find = regex.compile(PRE_TOKEN).findall
    names = [a["content"] for a in added]
    cut = regex.compile("|".join(regex.escape(a) for a in sorted(names, key=len, reverse=True))) if added else None
    pieces = Memo(pieces_of(vocabulary))

    def of_stretches(new: list[str]) -> list[int]:
        parts = [[x] if x[1:].isalpha() and x[0] == " " else [x[:-1], x[-1]] if x[1:-1].isalpha() and x[0] == " " and x[-1] in ".," else find(x) for x in new]
        pieces.fill(set().union(*parts))
        return [sum(map(pieces.__getitem__, p)) for p in parts]

    stretches = Memo(of_stretches)

    def whole(text: str) -> int:
        """A text whose pre-tokens may cross blanks, or that holds special strings: its own frequencies of pre-tokens."""
        special = len(cut.findall(text)) if cut else 0
        own = Counter(x for s in (cut.split(text) if cut else [text]) for x in find(s))
        pieces.fill(set(own))
        return special + sum(n * pieces[x] for x, n in own.items())

    def plain(col: pa.Array) -> np.ndarray:
        lists = pc.split_pattern(col, " ")
        first = lists.offsets.to_numpy()
        first = first - first[0]
        parts = lists.flatten().dictionary_encode()
        at, distinct = parts.indices.to_numpy(), parts.dictionary.to_pylist()
        leads = np.zeros(len(at), bool)  # what begins a text has no blank before it
        leads[first[:-1]] = True
        out = np.zeros(len(col), np.int64)
        for side, blank in ((leads, ""), (~leads, " ")):
            where = np.flatnonzero(side)
            doc = np.searchsorted(first, where, "right") - 1
            key, freq = np.unique(doc * len(distinct) + at[where], return_counts=True)
            doc, i = np.divmod(key, max(1, len(distinct)))
            used, i = np.unique(i, return_inverse=True)
            names = [blank + distinct[k] for k in used]
            stretches.fill({x for x in names if x})
            pieces_each = np.array([stretches[x] if x else 0 for x in names], np.int64)
            np.add.at(out, doc, freq * pieces_each[i])
        return out

    def count(texts: list[str] | pa.Array) -> list[int]:
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = pc.match_substring_regex(col, CROSSING)
        for a in names:
            odd = pc.or_(odd, pc.match_substring(col, a))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        out = np.zeros(len(col), np.int64)
        if not odd.all():
            out[~odd] = plain(col.filter(pa.array(~odd)))
        for i in np.flatnonzero(odd):
            out[i] = whole(col[int(i)].as_py())
        return out.tolist()

    return count


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", into: str = "n_tokens", step_bytes: int = 4 << 20) -> DataFrame:
    """docs with a long column `into`: tokens of the whole text.

    Null and empty texts have 0 tokens. All columns of docs are kept; one called `into` is replaced. Repeated rows
    and ties don't matter: each row is counted by itself. An empty table gives an empty result. vocabulary is a path
    that every executor can open.
    """
    kept = [f for f in docs.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.LongType())])
    names = [f.name for f in kept]

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(vocabulary)
        for b in batches:
            col = pc.fill_null(b.column(b.schema.get_field_index(text)), "")
            sizes, out, lo = pc.binary_length(col).to_pylist(), [], 0
            while lo < len(col):
                hi, size = lo, 0
                while hi < len(col) and (hi == lo or size + sizes[hi] <= step_bytes):
                    size += sizes[hi]
                    hi += 1
                out += count(col.slice(lo, hi - lo))
                lo = hi
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(out, pa.int64())], names=[*names, into])

    return docs.mapInArrow(run, schema)


def op10(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document; a null text is an empty one."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return count_tokens(d, vocabulary).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
