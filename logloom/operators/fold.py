"""The ordered fold of a stream's lines: types, diffs, tables, multi-line JSON and progress sessions. No Spark here.

Structure is one left-to-right pass with bounded look-back; rows of earlier lines may be revised (a table's header, the
lines of a JSON group, the live progress row). A Machine can begin anywhere in a stream: what it must know of the rows before
is the diff's state, and LOOK_BACK rows of context tell the rest, but for the header of a table that is longer than that.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..functions import jsonx, rx
from ..functions.spans import spans

LOOK_BACK = 200
_RX = {n: rx.python(getattr(rx, n)) for n in ("GOTEST_MARKER", "GOTEST_RESULT", "GOTEST_PACKAGE_OK", "GOTEST_PACKAGE_FAIL", "DIFF_OLD", "DIFF_NEW", "DIFF_HUNK", "GOTEST_DASH", "ERROR_PREFIX", "WARN_PREFIX")}


@dataclass
class Row:
    line_no: int
    raw: str
    line_type: str = "plain"
    depth: int = 0
    group_id: int = 0
    group_head: bool = False
    expandable: bool = False
    json: str | None = None
    json_prefix: str | None = None
    level: str = ""
    action: str | None = None
    test_name: str | None = None
    duration: str | None = None
    diff_kind: str | None = None
    columns: list[int] | None = None
    is_header: bool = False
    tab_gaps: list[tuple[int, int]] = field(default_factory=list)
    progress: dict | None = None
    styles: list[str] = field(default_factory=list)
    status: int = 0
    lines: int = 1
    table_of: int = 0  # the table's group, which a JSON group may hide later
    source: str | None = None

    @property
    def from_stderr(self) -> bool:
        return self.source == "stderr"

    @property
    def hidden(self) -> bool:
        return self.line_type == "json" and self.group_id != 0 and not self.group_head


class Ids:
    """Group ids from 1 on, shared by diffs, tables and JSON."""

    def __init__(self, start: int = 0) -> None:
        self.last = start

    def next(self) -> int:
        self.last += 1
        return self.last


def gotest(raw: str) -> dict | None:
    if m := _RX["GOTEST_MARKER"].search(raw):
        return {"line_type": "gotest_marker", "action": m[2], "test_name": m[3], "depth": len(m[1].encode()) // 4}
    if m := _RX["GOTEST_RESULT"].search(raw):
        return {"line_type": "gotest_result", "action": m[2], "test_name": m[3], "duration": m[4], "depth": len(m[1].encode()) // 4}
    bare = raw.strip()
    if bare not in ("PASS", "FAIL"):
        bare = "PASS" if _RX["GOTEST_PACKAGE_OK"].search(raw) else "FAIL" if _RX["GOTEST_PACKAGE_FAIL"].search(raw) else ""
    return {"line_type": "gotest_result", "action": bare} if bare else None


def warning(raw: str) -> str | None:
    m = _RX["ERROR_PREFIX"].search(raw) or _RX["WARN_PREFIX"].search(raw)
    return m[2].upper() if m else None


def indent(raw: str) -> str:
    return raw[: len(raw) - len(raw.lstrip(" \t"))]


#: The group of what began before a machine's first row; its id isn't known there.
EARLIER = -1


class Diff:
    """idle -> old -> new -> body; a line that fits no state ends the block and is not tried as a new header."""

    def __init__(self, ids: Ids, state: str = "idle") -> None:
        self.ids, self.group = ids, EARLIER
        self.state, _, self.lead = state.partition(":")

    def snapshot(self) -> str:
        """The state as text: a name, for a body with the indentation that its lines share."""
        return f"body:{self.lead}" if self.state == "body" else self.state

    def _opens(self, raw: str) -> str | None:
        if not _RX["DIFF_OLD"].search(raw) or _RX["GOTEST_DASH"].search(raw):
            return None
        self.state, self.group, self.lead = "old", self.ids.next(), indent(raw)
        return "header-old"

    def feed(self, raw: str) -> str | None:
        if self.state == "idle":
            return self._opens(raw)
        if self.state == "old":
            self.state = "new" if _RX["DIFF_NEW"].search(raw) else "idle"
            return "header-new" if self.state == "new" else None
        if _RX["DIFF_HUNK"].search(raw):
            self.state, self.lead = "body", indent(raw)
            return "hunk"
        if self.state == "new" or not raw.startswith(self.lead):
            self.state = "idle"
            return None
        by_sign = {"+": "add", "-": "remove", " ": "context"}.get(raw[len(self.lead) : len(self.lead) + 1])
        if by_sign or not raw.strip():
            return by_sign or "context"
        self.state = "idle"
        return self._opens(raw)

    def gotest_seen(self) -> None:
        if self.state in ("old", "new"):
            self.state = "idle"


def space_columns(raw: str) -> list[int]:
    """Byte offsets of columns: the line's begin, and what follows two or more bytes of white space."""
    out, at, gap = [], 0, None
    for c in raw:
        if c.isspace():
            gap = at if gap is None else gap
        else:
            if at == 0 or (gap is not None and at - gap >= 2):
                out.append(at)
            gap = None
        at += len(c.encode())
    return out


def tab_columns(raw: str, gaps: list[tuple[int, int]]) -> list[int]:
    return ([0] if raw and raw[0] not in " \t" else []) + [g[1] for g in gaps]


def cells(raw: str, gaps: list[tuple[int, int]]) -> list[str]:
    edges = [0, *(x for g in gaps for x in g), len(raw)]
    return [raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def aligned(a: list[int], b: list[int]) -> int:
    return sum(any(abs(x - y) <= 1 for y in b) for x in a)


class Table:
    """Adjacent lines whose columns agree; from the second agreement on they are a group, with the line before as header."""

    LEAST = 3

    def __init__(self, ids: Ids, first: int | None = None) -> None:
        """first: number of the first row of a machine that begins amid a stream. A run of agreeing rows from there on may be an earlier table's."""
        self.ids, self.first, self.known = ids, first, first is None
        self.reset()

    def reset(self) -> None:
        self.before: tuple[int, list[int], Row] | None = None
        self.count, self.group, self.header = 0, 0, None

    def clear(self) -> None:
        self.known = True
        self.reset()

    def feed(self, at: int, row: Row, gaps: list[tuple[int, int]]) -> None:
        inner = [c for c in cells(row.raw, gaps)[1:-1]] if len(gaps) >= 2 else ["x"]
        columns = tab_columns(row.raw, gaps) if gaps else space_columns(row.raw)
        if all(not c.strip() for c in inner) or len(columns) < self.LEAST:
            self.clear()
            return
        if self.before and self.before[0] == at - 1:
            if aligned(self.before[1], columns) >= (2 if gaps else self.LEAST):
                self.count += 1
                if self.count == 2:
                    self._begin()
                if self.count >= 2:
                    row.line_type, row.group_id, row.table_of, row.columns, row.tab_gaps = "table", self.group, self.group, self.header, gaps
            else:
                self.clear()
        else:
            self.count, self.known = 1, self.known or at != self.first
        self.before = (at, columns, row)
        row.tab_gaps = gaps

    def _begin(self) -> None:
        if not self.known:
            self.group = EARLIER
            return
        self.group = self.ids.next()
        _, self.header, head = self.before
        if head.line_type == "plain":
            head.line_type, head.group_id, head.group_head, head.is_header, head.columns = "table", self.group, True, True, self.header


def close_json(rows: list[Row], ids: Ids) -> bool:
    """Makes the last rows one JSON group if the last of them closes it."""
    closing = rows[-1].raw.strip()
    if closing not in ("}", "]"):
        return False
    opening = {"}": "{", "]": "["}[closing]
    depth, start = 0, None
    for i in range(len(rows) - 1, max(0, len(rows) - LOOK_BACK) - 1, -1):
        for c in reversed(rows[i].raw.strip()):
            depth += (c == closing) - (c == opening)
            if c == opening and not depth:
                start = i
                break
        if start is not None:
            break
    if start is None or start == len(rows) - 1 or rows[start].line_type == "json":
        return False
    brace = rows[start].raw.rfind(opening)
    prefix = rows[start].raw[:brace] if rows[start].raw[:brace].strip() else ""
    text = "".join(r + "\n" for r in [rows[start].raw[len(prefix) :], *(r.raw for r in rows[start + 1 :])])
    v = jsonx.parse(text)
    if v is jsonx.MISSING:
        return False
    group = ids.next()
    for i, r in enumerate(rows[start:]):
        r.line_type, r.group_id, r.group_head, r.expandable = "json", group, not i, not i
        r.json, r.json_prefix, r.level = (text, prefix, jsonx.level(v)) if not i else (None, None, "")
    return True


class Machine:
    """The pass over rows in order. rows: those it still holds; before: how many it has let go."""

    def __init__(self, ids: Ids | None = None, diff: str = "idle", first: int | None = None) -> None:
        """diff: state that the rows before the first one leave; first: its number, where rows stand before it."""
        self.ids = ids or Ids()
        self.diff, self.table, self.rows, self.before = Diff(self.ids, diff), Table(self.ids, first), [], first or 0

    def pass_by(self, row: Row) -> None:
        """A row that no machine reads: a progress session's."""
        self.rows.append(row)

    def feed(self, row: Row, gaps: list[tuple[int, int]], styled: bool = True) -> None:
        """styled: whether the row's styles and status are wanted."""
        raw, read = row.raw, []
        self.rows.append(row)
        if found := gotest(raw):
            row.__dict__.update(found)
            self.diff.gotest_seen()
            read = [raw]
        elif kind := self.diff.feed(raw):
            row.line_type, row.diff_kind, row.group_id, row.group_head = "diff", kind, self.diff.group, kind == "header-old"
            row.expandable = row.group_head
        elif level := warning(raw):
            row.line_type, row.level, read = "warning", level, [raw]
        elif hit := jsonx.inline(raw):
            row.line_type, row.json, row.level, row.expandable = "json", hit[0], jsonx.level(hit[1]), True
        elif parts := jsonx.embedded(raw):
            row.line_type, row.json, row.level, row.expandable = "json", parts[0][2], jsonx.level(parts[0][3]), True
            ends = [0, *(x for p in parts for x in p[:2]), len(raw)]
            read = [raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]
        else:
            read = [raw]
            self.table.feed(self.before + len(self.rows) - 1, row, gaps)
        if styled:
            row.styles = [s[3] for text in read for s in spans(text) or ()]
            row.status = status(row)
        if row.line_type in ("plain", "table"):
            close_json(self.rows, self.ids)


def diff_map(raws: list[str]) -> dict[str, str]:
    """What state each state before the rows leads to.

    The leads of a body before are told apart as far as the first row that the diff reads can: by the beginnings of its
    indentation. `body:` and a null byte stands for any other lead; where no row is read it means that bodies stay.
    """
    read = next((r for r in raws if not gotest(r)), "")
    now = {s: s for s in ["idle", "old", "new", "body:\0", *(f"body:{indent(read)[:n]}" for n in range(len(indent(read)) + 1))]}
    for raw in raws:
        seen = gotest(raw)
        after = {}
        for s in set(now.values()):
            d = Diff(Ids(), s)
            d.gotest_seen() if seen else d.feed(raw)
            after[s] = d.snapshot()
        now = {k: after[s] for k, s in now.items()}
    return now


def diff_after(state: str, found: dict[str, str]) -> str:
    """The state after rows with this map."""
    if state in found:
        return found[state]
    out = found["body:\0"]
    return state if out == "body:\0" else out


def key_value(raw: str) -> tuple[str, str] | None:
    """A progress pair: a known key right before the line's first `=`, and what follows."""
    left, eq, value = raw.strip().partition("=")
    key = left[len(left.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")) :]
    if not eq or not value or not (key in rx.PROGRESS_KEYS or (key.startswith("stream_") and key.endswith("_q"))):
        return None
    return key, value.strip()


class Progress:
    """One session of progress pairs; later values win, numbers that don't parse are passed over."""

    NUMBERS = {"frame": "frame", "total_size": "total_size", "out_time_us": "out_time_us", "dup_frames": "dup_frames", "drop_frames": "drop_frames"}

    def __init__(self) -> None:
        self.meta = {"frame": 0, "fps": "", "bitrate": "", "speed": "", "out_time": "", "out_time_us": 0, "total_size": 0, "dup_frames": 0, "drop_frames": 0, "block_count": 0, "percent": 0.0, "ended": False, "frozen": False}

    @staticmethod
    def _int(value: str) -> int | None:
        return int(value) if value.lstrip("+-").isascii() and value.lstrip("+-").isdigit() and len(value) - len(value.lstrip("+-")) <= 1 else None

    def add(self, key: str, value: str) -> bool:
        """Whether the pair ended a block."""
        m, n = self.meta, self._int(value)
        if key in self.NUMBERS:
            m[self.NUMBERS[key]] = m[self.NUMBERS[key]] if n is None else n
        elif key == "out_time_ms":
            m["out_time_us"] = n * 1000 if n is not None and not m["out_time_us"] else m["out_time_us"]
        elif key == "progress":
            m["block_count"] += 1
            m["ended"] = value == "end"
            m["percent"] = 1.0 if m["ended"] else max(m["percent"], min(0.99, 0.02 + 0.02 * m["block_count"]))
            return True
        elif key in m:
            m[key] = value
        return False

    def text(self, meta: dict | None = None) -> str:
        m = meta or self.meta
        parts = ["[ffmpeg]"]
        if m["out_time"] or m["out_time_us"] > 0:
            parts.append("time=" + (m["out_time"] or duration(m["out_time_us"])))
        parts += [f"frame={m['frame']}"] * (m["frame"] > 0) + [f"{k}={m[k].strip()}" for k in ("speed", "bitrate") if m[k]]
        parts += [f"size={size(m['total_size'])}"] * (m["total_size"] > 0) + [f"{m['percent'] * 100:.1f}%"]
        return " ".join(parts + (["done"] if m["ended"] else ["aborted"] if m["frozen"] else []))


def duration(us: int) -> str:
    s = (us + 500_000) // 1_000_000
    h, m = s // 3600, s // 60 % 60
    return (f"{h}h" if h else "") + (f"{m}m" if h or m else "") + f"{s % 60}s"


def size(n: int) -> str:
    unit, k = float(n), -1
    while unit >= 1024 and k < 5:
        unit, k = unit / 1024, k + 1
    return f"{n}B" if k < 0 else f"{unit:.1f}{'KMGTPE'[k]}iB"


def status(row: Row) -> int:
    if row.line_type == "warning":
        return 2
    if row.line_type == "gotest_result":
        return {"FAIL": 2, "PASS": 1}.get(row.action, 0)
    if row.line_type == "json" and row.level:
        return 2 if row.level in ("error", "fatal") else 0
    return 2 if {"level-error", "level-warn", "failed-step", "k8s-event-warning"} & set(row.styles) else 0


class Session:
    """An open progress session and its row. shown: the session as of its last block, or its first pair."""

    def __init__(self, row: Row, pair: tuple[str, str]) -> None:
        self.row, self.progress, self.lines = row, Progress(), 0
        row.line_type = "progress"
        self.add(pair)

    def add(self, pair: tuple[str, str]) -> bool:
        """Whether the pair ended the session."""
        self.lines += 1
        if self.progress.add(*pair) or self.lines == 1:
            self.shown = dict(self.progress.meta)
        if self.progress.meta["ended"]:
            self.show()
        return self.progress.meta["ended"]

    def show(self, frozen: bool = False) -> Row:
        """The row with what is known so far; frozen: another line has ended the session."""
        meta = self.progress.meta
        meta["frozen"] = frozen
        self.row.raw, self.row.progress, self.row.lines = self.progress.text(meta if frozen else self.shown), meta, self.lines
        return self.row


def reduced(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """As few pairs that have the same effect, blocks apart: the last of each key that counts; milliseconds count until there is a time."""
    last, ms = {}, None
    for key, value in pairs:
        if key == "out_time_ms":
            if ms is None and Progress._int(value):
                ms = value
        elif key != "progress" and (key not in Progress.NUMBERS or Progress._int(value) is not None):
            last[key] = value
            if key == "out_time_us":
                ms = None
    return [*last.items()] + ([("out_time_ms", ms)] if ms else [])


def segment(pairs: list[tuple[str, str]]) -> str:
    """A part of a session in short, as JSON."""
    first, rest = pairs[0], pairs[1:]
    blocks = [i for i, p in enumerate(rest) if p[0] == "progress"]
    cut = blocks[-1] + 1 if blocks else 0
    return json.dumps({"first": first, "blocks": len(blocks), "ended": bool(blocks) and rest[blocks[-1]][1] == "end", "before": reduced(rest[:cut]), "after": reduced(rest[cut:]), "lines": len(pairs)})


def joined(row: Row, segments: list[str]) -> Session:
    """The session of parts in order."""
    out = None
    for s in map(json.loads, segments):
        if out is None:
            out = Session(row, tuple(s["first"]))
        else:
            out.add(tuple(s["first"]))
        for p in s["before"]:
            out.progress.add(*p)
        if s["blocks"]:
            out.progress.meta["block_count"] += s["blocks"] - 1
            out.progress.add("progress", "end" if s["ended"] else "continue")
            out.shown = dict(out.progress.meta)
        for p in s["after"]:
            out.progress.add(*p)
        out.lines += s["lines"] - 1
    return out


class Live:
    """The pass over a stream that goes on: each line is read once, and rows are let go as soon as nothing can change them.

    What may change is a row that a bracket still open in the last LOOK_BACK rows stands in or before, a row that may turn
    out to be a table's header, and an open session's. state() and Live(state) carry all of it, as JSON.
    """

    def __init__(self, state: str | None = None, held: list[str] | None = None, progress: bool = True) -> None:
        self.machine, self.session, self.next, self.detect = Machine(), None, 0, progress
        self.open: dict[str, list[int]] = {"{": [], "[": []}  # rows of the brackets that are open, by number
        if state:
            v, m = json.loads(state), self.machine
            self.next, self.open, m.before, m.ids.last = v["next"], v["open"], v["before"], v["ids"]
            m.rows = [Row(**json.loads(r)) for r in held or []]
            m.diff.state, m.diff.lead, m.diff.group = v["diff"]
            m.table.count, m.table.group, m.table.header = v["table"]
            if v["last"]:
                at, columns = v["last"]
                m.table.before = (at, columns, m.rows[at - m.before] if at >= m.before else None)
            if v["session"]:
                meta, shown, lines = v["session"]
                self.session = Session.__new__(Session)
                self.session.row, self.session.progress, self.session.shown, self.session.lines = m.rows[-1], Progress(), shown, lines
                self.session.progress.meta = meta

    def state(self) -> tuple[str, list[str]]:
        """The state, and the rows held, each as JSON."""
        m, s = self.machine, self.session
        last = m.table.before and [m.table.before[0], m.table.before[1]]
        v = {
            "next": self.next, "open": self.open, "before": m.before, "ids": m.ids.last, "diff": [m.diff.state, m.diff.lead, m.diff.group], "table": [m.table.count, m.table.group, m.table.header], "last": last,
            "session": s and [s.progress.meta, s.shown, s.lines]}
        return json.dumps(v), [json.dumps(r.__dict__) for r in m.rows]

    def _brackets(self, row: Row) -> None:
        """Counts the brackets of the last row."""
        at = self.machine.before + len(self.machine.rows) - 1
        for opening, closing in ("{}", "[]"):
            if opening in row.raw or closing in row.raw:
                stack = self.open[opening]
                for c in row.raw:
                    if c == opening:
                        stack.append(at)
                    elif c == closing and stack:
                        stack.pop()

    def _close(self, frozen: bool) -> None:
        self._brackets(self.session.show(frozen))
        self.session = None

    def feed(self, no: int, raw: str, gaps: list[tuple[int, int]], source: str | None = None) -> None:
        pair = key_value(raw) if self.detect else None
        if pair and self.session:
            if self.session.add(pair):
                self._close(False)
        elif pair:
            self.session = Session(Row(no, "", source=source), pair)
            self.machine.pass_by(self.session.row)
            if self.session.progress.meta["ended"]:
                self._close(False)
        else:
            if self.session:
                self._close(True)
            row = Row(no, raw, source=source)
            self.machine.feed(row, gaps)
            self._brackets(row)

    def settled(self) -> list[Row]:
        """The rows that nothing can change any more; they are let go."""
        m = self.machine
        end = m.before + len(m.rows)
        for stack in self.open.values():
            while stack and stack[0] <= end - LOOK_BACK:  # a next row sees LOOK_BACK - 1 rows before it
                stack.pop(0)
        # the last row may become a header as long as fewer than two rows have agreed
        header = end - 1 if m.table.before and m.table.before[0] == end - 1 and m.table.count < 2 else end
        upto = min([end - 1 if self.session else end, header, *(s[0] for s in self.open.values() if s)]) - m.before
        out, m.rows = m.rows[:upto], m.rows[upto:]
        m.before += upto
        return out

    def finish(self) -> list[Row]:
        """All rows held: no more lines come, for now. Line numbers and ids go on."""
        if self.session:
            self.session.show()
        m, self.session, self.open = self.machine, None, {"{": [], "[": []}
        out, m.rows = m.rows, []
        m.before += len(out)
        m.diff.state = "idle"
        m.table.reset()
        return out


def fold(lines: list[tuple[int, str, list[tuple[int, int]]]], ids: Ids | None = None, progress: bool = True) -> list[Row]:
    """Rows of (line_no, raw, tab gaps) in order; progress pairs of a session share its first line's row.

    A session still open at the end stays live (not frozen), with its text as of its last block.
    """
    machine, session = Machine(ids), None
    for no, raw, gaps in lines:
        pair = key_value(raw) if progress else None
        if pair and session:
            session = None if session.add(pair) else session
        elif pair:
            session = Session(Row(no, ""), pair)
            machine.pass_by(session.row)
            session = None if session.progress.meta["ended"] else session
        else:
            if session:
                session.show(frozen=True)
                session = None
            machine.feed(Row(no, raw), gaps)
    if session:
        session.show()
    return machine.rows
