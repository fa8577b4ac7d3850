"""Columns and table functions over jsonx and spans: Arrow batches, for what expressions can't say."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import jsonview, jsonx, rx
from .spans import spans

_S, _B, _I = T.StringType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


@F.pandas_udf(_S)
def json_label(text: pd.Series, path: pd.Series) -> pd.Series:
    """Label at a path of object keys of a JSON text, or null where text or path leads nowhere."""
    def one(t, p):
        v = jsonx.parse(t) if t is not None else jsonx.MISSING
        v = v if v is jsonx.MISSING else jsonx.lookup(v, list(p))
        return None if v is jsonx.MISSING else jsonx.label(v)

    return pd.Series([one(t, p) for t, p in zip(text, path, strict=True)], dtype=object)


@F.pandas_udf(_struct(raw=_S, summary=_S, keys=T.ArrayType(_S), level=_S, inline=_B))
def detect_json(raw: pd.Series) -> pd.DataFrame:
    """The inline or first embedded JSON of each line; raw is null where there is none."""
    rows = []
    for r in raw:
        hit, whole = (jsonx.inline(r), True) if r is not None else (None, False)
        if hit is None and r is not None:
            parts = jsonx.embedded(r)
            hit, whole = ((parts[0][2], parts[0][3]), False) if parts else (None, False)
        rows.append((hit[0], jsonx.summary(hit[0]), jsonx.keys(hit[1]), jsonx.level(hit[1]), whole) if hit else (None, None, None, None, None))
    return pd.DataFrame(rows, columns=["raw", "summary", "keys", "level", "inline"])


def _each(f):
    """A pandas series of f of the values, null for null."""
    return lambda *cols: pd.Series([None if any(x is None for x in v) else f(*v) for v in zip(*cols, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(_struct(start=_I, end=_I, text=_S, style=_S)))
def json_segments(raw: pd.Series) -> pd.Series:
    """Segments of lines with embedded JSON, empty for others."""
    return _each(lambda r: [{"start": a, "end": b, "text": t, "style": y} for a, b, t, y in jsonview.segments(r)])(raw)


@F.pandas_udf(_S)
def json_compact(text: pd.Series, width: pd.Series) -> pd.Series:
    """JSON on one line of at most `width` cells, in its own key order; null for what is no JSON."""
    return _each(lambda t, w: jsonview.compact(t, int(w)))(text, width)


@F.pandas_udf(T.ArrayType(_struct(key=_S, start=_I, end=_I, text=_S)))
def json_slices(text: pd.Series) -> pd.Series:
    """The values one level down as they stand in the text."""
    return _each(lambda t: [{"key": str(k), "start": a, "end": b, "text": t[a:b]} for k, a, b in jsonview.slices(t)])(text)


@F.pandas_udf(_struct(start=_I, end=_I))
def json_level_range(text: pd.Series) -> pd.DataFrame:
    """Where the level's value stands; nulls where there is none."""
    return pd.DataFrame([(jsonview.level_range(t) if t is not None else None) or (None, None) for t in text], columns=["start", "end"])


@F.pandas_udf(T.ArrayType(_S))
def json_field_path(text: pd.Series, cursor: pd.Series) -> pd.Series:
    """Keys on the way to a cursor of child numbers, or null."""
    def one(t, c):
        v = jsonx.parse(t)
        return None if v is jsonx.MISSING else jsonview.field_path(v, [int(i) for i in c])

    return _each(one)(text, cursor)


CHILD = _struct(key=_S, shown=_S, kind=_S, expandable=_B, value=_S)
NODE = _struct(ord=_I, path=T.ArrayType(_S), depth=_I, shown=_S, kind=_S, value=_S)


def _of_texts(rows, fields: T.StructType, text: pa.Array) -> pa.Array:
    """Lists of structs, null for null; texts that are no JSON give none. Columns are filled flat, without an object for each struct."""
    flat, ends = [[] for _ in fields.names], [0]
    for t in text.to_pylist():
        v = jsonx.parse(t) if t is not None else jsonx.MISSING
        for r in rows(v) if v is not jsonx.MISSING else ():
            for column, x in zip(flat, r, strict=True):
                column.append(x)
        ends.append(len(flat[0]))
    made = pa.StructArray.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(flat, fields.fields, strict=True)], names=fields.names)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made, mask=text.is_null() if text.null_count else None)


def _children(v):
    for k, shown, x in jsonx.children(v):
        yield k, shown, jsonx.kind(x), jsonx.expandable(x), jsonx.label(x)


def _nodes(v):
    for i, (path, depth, shown, k, x) in enumerate(jsonx.tree(v)):
        yield i, path, depth, shown, k, jsonx.label(x)


@F.arrow_udf(T.ArrayType(CHILD))
def json_child_rows(text: pa.Array) -> pa.Array:
    """What json_children gives, as an array to be exploded: Arrow batches, no call for each row."""
    return _of_texts(_children, CHILD, text)


@F.arrow_udf(T.ArrayType(NODE))
def json_node_rows(text: pa.Array) -> pa.Array:
    """What json_tree gives, as an array to be exploded."""
    return _of_texts(_nodes, NODE, text)


@F.udtf(returnType=CHILD, useArrow=True)
class JsonChildren:
    def eval(self, text: str):
        v = jsonx.parse(text) if text is not None else jsonx.MISSING
        yield from _children(v) if v is not jsonx.MISSING else ()


@F.udtf(returnType=NODE, useArrow=True)
class JsonTree:
    def eval(self, text: str):
        v = jsonx.parse(text) if text is not None else jsonx.MISSING
        yield from _nodes(v) if v is not jsonx.MISSING else ()


@F.pandas_udf(T.ArrayType(_struct(start=_I, end=_I, text=_S, style=_S)))
def find_spans(raw: pd.Series) -> pd.Series:
    def one(r):
        s = spans(r) if r is not None else None
        return None if s is None else [{"start": a, "end": b, "text": t, "style": y} for a, b, t, y in s]

    return pd.Series([one(r) for r in raw], dtype=object)


def extract(raw, style: str):
    """All texts of one style that needs no look at others (ip, datetime, sourceref, timestamp), as an expression."""
    pattern, group = {"ip": (rx.IPV4, 0), "datetime": (rx.DATETIME, 0), "nginx-datetime": (rx.NGINX_DATETIME, 0), "sourceref": (r"(?<!/)" + rx.SOURCE_REF, 0), "timestamp": (rx.CLOCK, 1), "k8s": (rx.K8S_GROUPED, 0)}[style]
    return F.regexp_extract_all(raw, F.lit(rx.java(pattern)), F.lit(group))
