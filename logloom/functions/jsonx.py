"""JSON in lines: detection, labels, levels, summaries, ordered keys and trees. Plain Python; columns.py has the columns.

Values keep source order; of equal keys the last value counts; all numbers are doubles.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from . import rx

MISSING = "\0missing"


def _no_constant(name: str):
    raise ValueError(name)


def parse(text: str):
    """The value of a whole JSON text, or MISSING."""
    try:
        return json.loads(text, parse_int=float, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return MISSING


def number(x: float, structural: bool = False) -> str:
    """Text of a double: shortest digits, with an exponent outside 1e-4..1e6 (in structures: 1e-6..1e21)."""
    if x == math.floor(x) and abs(x) < (1e21 if structural else 2**63):
        return str(int(x))
    digits, exp = repr(float(x)).lower(), 0
    sign = "-" if digits[0] == "-" else ""
    digits = digits.lstrip("-")
    if "e" in digits:
        digits, e = digits.split("e")
        exp = int(e)
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + exp
    d = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    d = d.rstrip("0") or "0"
    e10 = point - 1
    if e10 < (-6 if structural else -4) or e10 >= (21 if structural else 6):
        mant = d[0] + ("." + d[1:] if len(d) > 1 else "")
        power = str(abs(e10)) if structural and e10 < 0 and abs(e10) < 10 else f"{abs(e10):02d}"
        return f"{sign}{mant}e{'-' if e10 < 0 else '+'}{power}"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{d}"
    return f"{sign}{d[:point].ljust(point, '0')}" + (f".{d[point:]}" if len(d) > point else "")


_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}


def quoted(s: str, html: bool = True) -> str:
    out = json.dumps(s, ensure_ascii=False)
    if html:
        for c, e in _ESCAPES.items():
            out = out.replace(c, e)
    return out


def dumped(v) -> str:
    """Compact text with sorted keys and HTML characters escaped."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return number(v, True)
    if isinstance(v, str):
        return quoted(v)
    if isinstance(v, list):
        return "[" + ",".join(map(dumped, v)) + "]"
    return "{" + ",".join(f"{quoted(k)}:{dumped(v[k])}" for k in sorted(v)) + "}"


def lookup(v, path: list[str]):
    for key in path:
        if not isinstance(v, dict) or key not in v:
            return MISSING
        v = v[key]
    return v


def label(v) -> str:
    """A leaf's or structure's text as statistics group by it."""
    return v if isinstance(v, str) else number(v) if isinstance(v, float) else dumped(v)


_LEVELS = {w: level for level, words in rx.LEVELS.items() for w in words}


def level(v) -> str:
    """Normalised top-level `level`, if it is a string."""
    s = v.get("level") if isinstance(v, dict) else None
    return _LEVELS.get(s.strip().lower(), "") if isinstance(s, str) else ""


def cut(text: str, most: int) -> str:
    b = text.encode()
    return text if len(b) <= most else b[: most - 3].decode("utf-8", "ignore") + "..."


def summary(text: str) -> str:
    """At most 60 bytes: a long text as it stands, a short one without blanks between tokens."""
    t = text.strip()
    if len(t.encode()) > 60:
        return cut(t, 60)
    out, in_string, escaped = [], False, False
    for c in t:
        if in_string:
            out.append(c)
            escaped, in_string = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c not in " \t\r\n":
            out.append(c)
            in_string = c == '"'
    return cut("".join(out), 60)


def keys(v) -> list[str] | None:
    return list(v) if isinstance(v, dict) else None


def expandable(v) -> bool:
    return isinstance(v, dict | list) and bool(v)


def children(v) -> list[tuple[str, str, object]]:
    """(key or index, shown text, value) one level down; nothing for leaves."""
    if isinstance(v, dict):
        return [(k, f"{quoted(k, False)}: {cut(dumped(x), 50)}", x) for k, x in v.items()]
    if isinstance(v, list):
        return [(str(i), f"[{i}]: {cut(dumped(x), 50)}", x) for i, x in enumerate(v)]
    return []


def kind(v) -> str:
    return {dict: "object", list: "array", str: "string", float: "number", bool: "bool", type(None): "null"}[type(v)]


def tree(v) -> Iterator[tuple[list[str], int, str, str, object]]:
    """(path, depth, shown text, kind, value) of all descendants, parents first."""
    stack = [([], 0, v)]
    while stack:
        path, depth, node = stack.pop()
        below = [([*path, k], depth + 1, shown, x) for k, shown, x in children(node)]
        if path:
            yield path, depth, shown_of[tuple(path)], kind(node), node
        else:
            shown_of: dict[tuple, str] = {}
        for p, _, shown, _ in below:
            shown_of[tuple(p)] = shown
        stack += [(p, d, x) for p, d, _, x in reversed(below)]


_KEY, _UNWRAPPED = (rx.python(p) for p in (rx.JSON_KEY, rx.UNWRAPPED_JSON))


def inline(raw: str) -> tuple[str, object] | None:
    """(JSON text, value) of a line that is JSON as a whole, perhaps in one pair of quotes, or a bare member."""
    t = raw.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "'\"":
        t = t[1:-1]
    if len(t.encode()) >= 3 and t[0] in "{[":
        v = parse(t)
        return None if v is MISSING else (t, v)
    if t in ("{}", "[]") or not _UNWRAPPED.search(t):
        return None
    t = "{" + t + "}"
    v = parse(t)
    return None if v is MISSING else (t, v)


def _closing(raw: str, at: int, opening: str, closing: str, seen: set[int], inside: bool = False) -> Iterator[tuple[int, int]]:
    """Spans of the brackets outside of strings from a place on, in one pass with a stack; seen: takes their openings."""
    stack, skip = [], False
    for j in range(at, len(raw)):
        c = raw[j]
        if skip:
            skip = False
        elif c == '"':
            inside = not inside
        elif inside:
            skip = c == "\\"
        elif c == opening:
            stack.append(j)
            seen.add(j)
        elif c == closing and stack:
            yield stack.pop(), j + 1


def _balanced(raw: str, opening: str, closing: str) -> Iterator[tuple[int, int]]:
    """Spans from each opening bracket to the one that closes it, brackets in strings apart.

    An opening bracket is outside of strings to its own reader. Two readings of the line, which begin outside and inside
    of a string, have nearly all of them so; those that follow a backslash in both are read one by one.
    """
    seen: set[int] = set()
    yield from _closing(raw, 0, opening, closing, seen)
    if '"' in raw:
        yield from _closing(raw, 0, opening, closing, seen, True)
        for i in (k for k, c in enumerate(raw) if c == opening and k not in seen):
            yield from (span for span in _closing(raw, i, opening, closing, set()) if span[0] == i)


def embedded(raw: str) -> list[tuple[int, int, str, object]]:
    """(start, end, text, value) of the largest JSON parts of a line, from left to right, in characters."""
    if not ("{" in raw or "[" in raw):
        return []
    has_key = bool(_KEY.search(raw))
    if not has_key:
        return []  # every part needs a key of its own
    spans = {*_balanced(raw, "{", "}"), *_balanced(raw, "[", "]")}
    for q in "'\"":
        at = raw.find(q + "{")
        while at >= 0:
            end = raw.find(q, at + 1)
            if end > at + 3 and raw[end - 1] == "}":
                spans.add((at + 1, end))
                at = raw.find(q + "{", end + 1)
            else:
                at = raw.find(q + "{", at + 1)
    out, last = [], -1
    for lo, hi in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        part = raw[lo:hi]
        if lo >= last and len(part.encode()) >= 4 and _KEY.search(part) and (v := parse(part)) is not MISSING:
            out.append((lo, hi, part, v))
            last = hi
    return out
