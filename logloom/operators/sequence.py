"""The fold over DataFrames: a stream is many tasks, whatever its lines are, and the result is that of one pass over it.

Three things reach from a chunk of lines into the next, and each is settled by itself:

- Progress sessions. Which lines are pairs is known from the line alone, so sessions are numbered by counts in two levels;
  a session that crosses chunks is put together from short summaries of its parts. Rows are numbered with sessions as one.
- The state of a diff. In most chunks some line ends any diff; what stands behind the last such line tells the state at
  the chunk's end. A chunk without such a line gives a map from each state before it to the one after, and the maps
  of neighbouring chunks are composed.
- Tables and multi-line JSON. Each chunk is folded with LOOK_BACK rows before and after it. JSON groups reach no further; of
  a table that does only the columns of its header are not known, and they come from the chunk in which it began.

Group ids count from 1 in each stream: the groups that begin in a chunk are numbered there, and chunks add up.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import rx
from ..functions.clean import clean_lines
from ..sources.shared import written
from .fold import EARLIER, LOOK_BACK, Ids, Machine, Row, Session, diff_after, diff_map, joined, key_value, segment

CHUNK = 8192
#: A progress pair (a known key right before the line's first `=`), and one that ends its session.
_KEYS = "|".join([*rx.PROGRESS_KEYS, "stream_q", "stream_[A-Za-z0-9_]*_q"])
PAIR = rf"(?U)^[^=]*(?<![A-Za-z0-9_])(?:{_KEYS})=\s*\S"
SESSION_END = r"(?U)^[^=]*(?<![A-Za-z0-9_])progress=\s*end\s*$"
_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_GAPS = T.ArrayType(T.StructType([T.StructField("start", _I), T.StructField("end", _I)]))
_PROGRESS = T.StructType([T.StructField(n, t) for n, t in (
    ("frame", _L), ("fps", _S), ("bitrate", _S), ("speed", _S), ("out_time", _S), ("out_time_us", _L), ("total_size", _L), ("dup_frames", _L),
    ("drop_frames", _L), ("block_count", _I), ("percent", T.DoubleType()), ("ended", _B), ("frozen", _B))])
LINES = T.StructType([T.StructField(n, t) for n, t in (
    ("stream_id", _S), ("line_no", _L), ("raw", _S), ("line_type", _S), ("depth", _I), ("group_id", _L), ("group_head", _B), ("hidden", _B), ("expandable", _B),
    ("json", _S), ("json_prefix", _S), ("level", _S), ("action", _S), ("test_name", _S), ("duration", _S), ("diff_kind", _S), ("columns", T.ArrayType(_I)),
    ("is_header", _B), ("tab_gaps", _GAPS), ("progress", _PROGRESS), ("styles", T.ArrayType(_S)), ("status", _I), ("lines", _I),
    ("source", _S), ("from_stderr", _B))])


#: Rows before they are typed. gaps: "start:end,..." or null; meta: a session's progress, as JSON; _calm: no diff is open after it; _rows: of the stream.
ROWS = T.StructType([T.StructField(n, t) for n, t in (("stream_id", _S), ("row_no", _L), ("line_no", _L), ("raw", _S), ("gaps", _S), ("lines", _I), ("source", _S), ("meta", _S), ("_calm", _B), ("_rows", _L))])
#: The same by chunk, with sessions in parts.
_PARTS = T.StructType([T.StructField(n, t) for n, t in (
    ("stream_id", _S), ("_home", _L), ("_pos", _L), ("line_no", _L), ("raw", _S), ("gaps", _S), ("lines", _I), ("source", _S), ("meta", _S), ("_calm", _B), ("_part", _S), ("_lead", _B), ("_open", _B), ("_last", _L))])


def arrow(values: list, kind: T.DataType) -> pa.Array:
    return pa.array(values, to_arrow_type(kind))


def _table(columns: dict[str, list], schema: T.StructType) -> pa.Table:
    return pa.table({f.name: arrow(columns[f.name], f.dataType) for f in schema.fields})


def _rows_of_chunk(key: tuple, t: pa.Table) -> pa.Table:
    """The rows of a chunk of lines: lines that are no pair, sessions that begin and end within, and parts of the others.

    A session that begins with the chunk's first line may go on from the chunk before (_lead); one that isn't over with
    its last line may go on in the next (_open).
    """
    t = t.sort_by("line_no")
    pair, n = np.asarray(t["_pair"]), t.num_rows
    if not pair.any():
        none = pa.nulls(n, pa.string())
        no = pa.array(np.zeros(n, bool))
        return pa.table({"stream_id": t["stream_id"], "_home": t["_home"], "_pos": pa.array(np.arange(n)), "line_no": t["line_no"], "raw": t["raw"], "gaps": t["gaps"], "lines": pa.array(np.ones(n, np.int32)), "source": t["source"], "meta": none, "_calm": t["_calm"], "_part": none, "_lead": no, "_open": no, "_last": t["line_no"]})
    out, home = [], key[1].as_py()
    number, raw, gaps, calm, pair, source = (t[c].to_pylist() for c in ("line_no", "raw", "gaps", "_calm", "_pair", "source"))
    a, stream = 0, key[0].as_py()
    while a < n:
        if not pair[a]:
            made = (number[a], raw[a], gaps[a], 1, source[a], None, calm[a], None, False, False, number[a])
            b = a + 1
        else:
            pairs, b = [], a
            while b < n and pair[b]:
                pairs.append(key_value(raw[b]))
                b += 1
                if pairs[-1] == ("progress", "end"):
                    break
            ended = pairs[-1] == ("progress", "end")
            lead, is_open = a == 0, b == n and not ended
            if lead or is_open:
                made = (number[a], None, None, b - a, source[a], None, False, segment(pairs), lead, is_open, number[b - 1])
            else:
                session = Session(Row(number[a], ""), pairs[0])
                for p in pairs[1:]:
                    session.add(p)
                row = session.show(frozen=not ended)
                made = (number[a], row.raw, None, b - a, source[a], json.dumps(row.progress), False, None, False, False, number[b - 1])
        out.append((stream, home, len(out), *made))
        a = b
    return _table(dict(zip(_PARTS.names, map(list, zip(*out, strict=True)), strict=True)), _PARTS)


def _joined_parts(key: tuple, t: pa.Table) -> pa.Table:
    t = t.sort_by("_last")
    s = joined(Row(key[1].as_py(), ""), t["_part"].to_pylist())
    row = s.show(frozen=not s.progress.meta["ended"] and t["_last"][-1].as_py() < t["_stream_last"][0].as_py())
    return _table({"stream_id": [key[0].as_py()], "row_no": [t["row_no"][0].as_py()], "line_no": [row.line_no], "raw": [row.raw], "gaps": [None], "lines": [row.lines], "source": [t["source"][0].as_py()], "meta": [json.dumps(row.progress)], "_calm": [False], "_rows": [t["_rows"][0].as_py()]}, ROWS)


def stream_rows(lines: DataFrame, detect_progress: bool = True, chunk: int = CHUNK) -> DataFrame:
    """ROWS of cleaned (stream_id, line_no, raw, gaps, source): one for each line that is no progress pair and one for each session, numbered without gaps. They are written once."""
    raw = F.col("raw")
    d = lines.withColumn("_calm", _ends_diffs(raw))
    if not detect_progress:
        d = written(d)
        ends = d.groupBy("stream_id").agg((F.max("line_no") + 1).alias("_rows"))
        return d.join(ends, "stream_id").select("stream_id", F.col("line_no").alias("row_no"), "line_no", "raw", "gaps", F.lit(1).alias("lines"), "source", F.lit(None).cast("string").alias("meta"), "_calm", "_rows")
    d = d.withColumn("_home", F.expr(f"line_no div {chunk}")).withColumn("_pair", F.contains(raw, F.lit("=")) & F.regexp_like(raw, F.lit(PAIR)))
    d = written(d.groupBy("stream_id", "_home").applyInArrow(_rows_of_chunk, _PARTS))
    line, lead, is_open = F.col("line_no"), F.col("_lead"), F.col("_open")
    chunks = d.groupBy("stream_id", "_home").agg(
        F.count("*").alias("_n"), F.max(lead).alias("_lead"), F.max(is_open).alias("_open"), F.max(lead & is_open).alias("_through"), F.max(F.when(is_open & ~lead, line)).alias("_tail"), F.min("line_no").alias("_first"), F.max("_last").alias("_last"))
    over = Window.partitionBy("stream_id").orderBy("_home")
    earlier, all_of = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("stream_id")
    chunks = chunks.withColumn("_goes_on", F.col("_lead") & F.coalesce(F.lag("_open").over(over), F.lit(False)))
    chunks = chunks.withColumn("_n", F.col("_n") - F.col("_goes_on").cast("long")).withColumn("_begin", F.coalesce("_tail", F.when(F.col("_through") & ~F.col("_goes_on"), F.col("_first"))))
    chunks = chunks.select(
        "stream_id", "_home", "_goes_on", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_goes_on").cast("long")).alias("_before"), F.last("_begin", True).over(earlier).alias("_carried"),
        F.sum("_n").over(all_of).alias("_rows"), F.max("_last").over(all_of).alias("_stream_last"))
    d = d.join(chunks, ["stream_id", "_home"]).withColumn("row_no", F.col("_before") + F.col("_pos"))
    whole = d.where("_part is null").select(*ROWS.names)
    if not d.where("_part is not null").take(1):
        return whole
    parts = d.where("_part is not null").withColumn("_session", F.when(F.col("_lead") & F.col("_goes_on"), F.col("_carried")).otherwise(line))
    return whole.unionByName(parts.select("stream_id", "_session", "row_no", "source", "_part", "_last", "_stream_last", "_rows").groupBy("stream_id", "_session").applyInArrow(_joined_parts, ROWS))


def _ends_diffs(raw: Column) -> Column:
    """Whether no diff is open after a line, whatever came before it."""
    has = lambda p: F.regexp_like(raw, F.lit(rx.java(p)))
    seen = F.regexp_like(raw, F.lit(r"(?U)^[^\s\p{Z}\p{C}+\-@]"))
    test = has(rx.GOTEST_MARKER) | F.regexp_like(raw, F.lit(r"(?U)^(?:PASS|FAIL)\s*\z")) | has(rx.GOTEST_PACKAGE_OK) | has(rx.GOTEST_PACKAGE_FAIL)
    return seen & ~has(rx.DIFF_OLD) & ~test


def _map_of_chunk(key: tuple, t: pa.Table) -> pa.Table:
    raws = t.sort_by("row_no")["raw"].to_pylist()
    found = {"idle": diff_after("idle", diff_map(raws))} if t["_known"][0].as_py() else diff_map(raws)
    return pa.table({"stream_id": [key[0].as_py()], "_chunk": [key[1].as_py()], "_map": [json.dumps(found)]})


def _states(key: tuple, t: pa.Table) -> pa.Table:
    """The state that each chunk of a run leaves to the next: the first one's is known, the others follow by their maps."""
    t, state, out = t.sort_by("_chunk"), "idle", []
    for known, found in zip(t["_known"].to_pylist(), t["_map"].to_pylist(), strict=True):
        state = "idle" if known else state
        state = diff_after(state, json.loads(found)) if found else state
        out.append(state)
    return pa.table({"stream_id": t["stream_id"], "_chunk": pa.array([c + 1 for c in t["_chunk"].to_pylist()], pa.int64()), "_state": pa.array(out, pa.string())})


def diff_states(rows: DataFrame, chunk: int) -> DataFrame:
    """(stream_id, _chunk, _state): the diff's state LOOK_BACK rows before a chunk's first row."""
    d = rows.withColumn("_chunk", F.expr(f"(row_no + {LOOK_BACK}) div {chunk}"))
    calm = d.groupBy("stream_id", "_chunk").agg(F.max(F.when(F.col("_calm"), F.col("row_no"))).alias("_upto"))
    calm = calm.select("stream_id", "_chunk", F.col("_upto").isNotNull().alias("_known"), F.coalesce("_upto", F.lit(-1)).alias("_upto"))
    rest = d.where("meta is null").select("stream_id", "_chunk", "row_no", "raw").join(calm, ["stream_id", "_chunk"]).where("row_no > _upto")
    maps = rest.groupBy("stream_id", "_chunk").applyInArrow(_map_of_chunk, "stream_id string, _chunk long, _map string")
    run = F.sum(F.col("_known").cast("long")).over(Window.partitionBy("stream_id").orderBy("_chunk"))
    chunks = calm.join(maps, ["stream_id", "_chunk"], "left").withColumn("_run", run)
    return chunks.select("stream_id", "_chunk", "_known", "_map", "_run").groupBy("stream_id", "_run").applyInArrow(_states, "stream_id string, _chunk long, _state string")


#: Beside the wanted columns of LINES: what the ids and columns of groups that began elsewhere need.
_EXTRA = T.StructType([T.StructField(n, t) for n, t in (("_chunk", _L), ("_kind", _S), ("_events", _L), ("_last_diff", _L), ("_last_table", _L), ("_header", T.ArrayType(_I)), ("_no_columns", _B))])


def _gaps(text: str | None) -> list[tuple[int, int]]:
    return [tuple(map(int, g.split(":"))) for g in text.split(",")] if text else []


def row_columns(stream_id: str, rows: list[Row], names: list[str]) -> dict[str, list]:
    """The named columns of LINES."""
    made = {}
    for n in names:
        if n == "stream_id":
            made[n] = [stream_id] * len(rows)
        elif n == "tab_gaps":
            made[n] = [[{"start": a, "end": b} for a, b in r.tab_gaps] for r in rows]
        else:
            made[n] = [getattr(r, n) for r in rows]
    return made


def _fold_chunk(chunk: int, names: list[str]):
    schema = T.StructType([*(LINES[n] for n in names), *_EXTRA.fields])
    styled = bool({"styles", "status"} & set(names))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t, k = t.sort_by("row_no"), key[1].as_py()
        numbers, lo, hi = t["row_no"].to_pylist(), k * chunk, (k + 1) * chunk
        machine = Machine(Ids(), t["_state"][0].as_py() or "idle", numbers[0] or None)
        base = own = None
        last_diff = last_table = header = None
        for at, no, raw, gaps, lines, source, meta in zip(numbers, *(t[c].to_pylist() for c in ("line_no", "raw", "gaps", "lines", "source", "meta")), strict=True):
            base = machine.ids.last if at == lo else base
            own = machine.ids.last - base if at == hi else own
            row = Row(no, raw, lines=lines, source=source)
            if meta:
                row.line_type, row.progress = "progress", json.loads(meta)
                machine.pass_by(row)
                continue
            began = machine.ids.last
            machine.feed(row, _gaps(gaps), styled and lo <= at < hi)
            if lo <= at < hi and machine.ids.last > began:
                if machine.diff.group == machine.ids.last:
                    last_diff = machine.ids.last
                elif machine.table.group == machine.ids.last:
                    last_table, header = machine.ids.last, machine.table.header
        own = machine.ids.last - base if own is None else own
        rows = machine.rows[lo - numbers[0] : hi - numbers[0]]
        kinds, no_columns = [], []
        for r in rows:
            kind = None if not r.group_id else "own" if r.group_id > base else r.line_type
            # a table that began earlier, also where its rows have become part of a JSON group
            no_columns.append(r.columns is None and r.table_of == EARLIER)
            r.group_id = max(0, r.group_id - base)
            kinds.append(kind)
        first = [None] * (len(rows) - 1)
        out = row_columns(key[0].as_py(), rows, names) | {
            "_chunk": [k] * len(rows), "_kind": kinds, "_events": [own, *first], "_last_diff": [last_diff and last_diff - base, *first], "_last_table": [last_table and last_table - base, *first], "_header": [header, *first], "_no_columns": no_columns}
        return _table(out, schema)

    return run, schema


def structure(lines: DataFrame, text: str = "text", detect_progress: bool = True, chunk: int = CHUNK, columns: list[str] | None = None) -> DataFrame:
    """Typed lines of raw ones (stream_id, line_no, text[, source]): one row per line, one per progress session.

    Lines are numbered from 0 without gaps in each stream. chunk: rows that a task folds at once, 2 * LOOK_BACK at least.
    columns: those of LINES to be made, all unless given; ids and columns of groups cost one more exchange.
    """
    names, chunk = list(columns or LINES.names), max(chunk, 2 * LOOK_BACK)
    source = (F.col("source") if "source" in lines.columns else F.lit(None)).cast("string").alias("source")
    d = clean_lines(lines.select("stream_id", "line_no", text, source), text)
    # text, and null for most lines: lists of structs are slow to hand over
    gaps = F.when(F.size("tab_gaps") > 0, F.array_join(F.transform("tab_gaps", lambda g: F.concat(g["start"], F.lit(":"), g["end"])), ","))
    d = d.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("line_no").cast("long").alias("line_no"), "raw", gaps.alias("gaps"), "source")
    rows = stream_rows(d, detect_progress, chunk)
    home, place = F.expr(f"row_no div {chunk}"), F.expr(f"row_no % {chunk}")
    homes = F.when((place < LOOK_BACK) & (home > 0), F.array(home, home - 1)).when((place >= chunk - LOOK_BACK) & ((home + 1) * chunk < F.col("_rows")), F.array(home, home + 1)).otherwise(F.array(home))
    d = rows.select("stream_id", "row_no", "line_no", "raw", "gaps", "lines", "source", "meta", F.explode(homes).alias("_chunk"))
    run, schema = _fold_chunk(chunk, ["stream_id", *(n for n in names if n != "stream_id")])
    done = d.join(diff_states(rows, chunk), ["stream_id", "_chunk"], "left").groupBy("stream_id", "_chunk").applyInArrow(run, schema)
    if not {"group_id", "columns"} & set(names):
        return done.select(*names)
    done = written(done)
    over = Window.partitionBy("stream_id").orderBy("_chunk")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    chunks = done.where("_events is not null").select("stream_id", "_chunk", F.coalesce(F.sum("_events").over(earlier), F.lit(0)).alias("_before"), "_last_diff", "_last_table", "_header")
    for n in ("_last_diff", "_last_table"):
        chunks = chunks.withColumn(n, F.last(F.col("_before") + F.col(n), True).over(earlier))
    chunks = chunks.select("stream_id", "_chunk", "_before", F.col("_last_diff").alias("_of_diff"), F.col("_last_table").alias("_of_table"), F.last("_header", True).over(earlier).alias("_of_header"))
    d = done.join(chunks, ["stream_id", "_chunk"])
    made = {
        "group_id": F.when(F.col("_kind") == "own", F.col("_before") + F.col("group_id")).when(F.col("_kind") == "diff", F.col("_of_diff")).when(F.col("_kind") == "table", F.col("_of_table")).otherwise(0),
        "columns": F.when(F.col("_no_columns"), F.col("_of_header")).otherwise(F.col("columns")) if "columns" in names else None}
    return d.select(*[made[n].alias(n) if n in made else F.col(n) for n in names])


def group_widths(lines: DataFrame) -> DataFrame:
    """Greatest width of each column of each tab-separated table group: (stream_id, group_id, pos, width)."""
    gaps = F.col("tab_gaps")
    begins = F.concat(F.array(F.lit(0)), F.transform(gaps, lambda g: g["end"]))
    ends = F.concat(F.transform(gaps, lambda g: g["start"]), F.array(F.octet_length("raw")))
    cells = lines.where((F.col("line_type") == "table") & (F.size("tab_gaps") > 0)).select("stream_id", "group_id", F.posexplode(F.zip_with(begins, ends, lambda a, b: b - a)).alias("pos", "w"))
    return cells.groupBy("stream_id", "group_id", "pos").agg(F.greatest(F.lit(0), F.max("w")).alias("width"))


def aligned_text(lines: DataFrame) -> DataFrame:
    """Table lines with text: cells padded to their group's widths, joined by a bar; columns that are always empty go."""
    widths = group_widths(lines).groupBy("stream_id", "group_id").agg(F.array_sort(F.collect_list(F.struct("pos", "width"))).alias("_w"))
    gaps = F.col("tab_gaps")
    begins = F.concat(F.array(F.lit(0)), F.transform(gaps, lambda g: g["end"]))
    ends = F.concat(F.transform(gaps, lambda g: g["start"]), F.array(F.length("raw")))
    d = lines.where((F.col("line_type") == "table") & (F.size("tab_gaps") > 0)).join(widths, ["stream_id", "group_id"])
    d = d.withColumn("_cells", F.zip_with(begins, ends, lambda a, b: F.substring(F.col("raw"), a + 1, F.greatest(F.lit(0), b - a))))
    shown = F.filter(F.arrays_zip("_cells", "_w"), lambda x: x["_w"]["width"] > 0)
    return d.withColumn("text", F.array_join(F.transform(shown, lambda x: F.rpad(F.coalesce(x["_cells"], F.lit("")), x["_w"]["width"].cast("int"), F.lit(" "))), " │ ")).drop("_cells", "_w")


def separated_text(lines: DataFrame) -> DataFrame:
    """Lines of space-aligned tables with text: the gaps of two or more blanks that hold one of the header's columns end in a bar, right before the next column."""
    d = lines.where((F.col("line_type") == "table") & (F.size("tab_gaps") == 0))
    runs = F.regexp_extract_all("raw", F.lit("( {2,}|[^ ]+(?: [^ ]+)*| )"), F.lit(1))
    # pieces of the line with the byte at which each begins
    ends = F.aggregate(runs, F.expr("array(0)"), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.octet_length(p))))
    d = d.withColumn("_runs", runs).withColumn("_ends", ends)
    columns = F.slice("columns", 2, F.greatest(F.lit(0), F.size("columns") - 1))

    def shown(p: Column, i: Column) -> Column:
        lo, hi = F.get("_ends", i), F.get("_ends", i + 1)
        gap = F.regexp_like(p, F.lit("^ {2,}$")) & (lo > 0) & F.exists(columns, lambda c: (c >= lo) & (c <= hi))
        bar = F.concat(F.repeat(F.lit(" "), F.length(p) - 1), F.lit("│"))
        return F.when(gap, bar).otherwise(p)

    return d.withColumn("text", F.array_join(F.transform("_runs", shown), "")).drop("_runs", "_ends")
