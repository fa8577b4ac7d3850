"""The fold and the statistics over unbounded input, with the batch operators' results.

The fold reads each line once. Its state, in the state store, is what the machines remember and the rows that may still change:
LOOK_BACK of them at most, and as a rule none or one (see operators.fold.Live). Rows are handed out when they are
final; with provisional set, those that may still change are handed out as they stand, too, and come again with a higher version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.clean import clean_lines
from ..operators.fold import Live, Row
from ..operators.rates import lag_sketch
from ..operators.sequence import LINES, row_columns

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Typed lines of a stream. version: grows with each batch of lines of the stream; final: the row won't change.
LIVE_LINES = T.StructType([*LINES.fields, T.StructField("version", T.LongType()), T.StructField("final", T.BooleanType())])
#: Settled rows of a stream that are handed on at once.
HANDED_ON = 4096
#: Columns of LINES without nulls, which pandas may hold as numbers.
_NUMBERS = {"line_no", "depth", "group_id", "status", "lines"}


class Fold(StatefulProcessor):
    """One stream's fold. Value state: the machines and counters; list state: the rows held."""

    def __init__(self, detect_progress: bool, idle_timeout_ms: int, ordered: bool, provisional: bool) -> None:
        self.detect, self.timeout, self.ordered, self.provisional = detect_progress, idle_timeout_ms, ordered, provisional

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machines = handle.getValueState("machines", "state string, version long")
        self.held = handle.getListState("held", "row string")

    def _load(self) -> tuple[Live, int]:
        if not self.machines.exists():
            return Live(progress=self.detect), 0
        state, version = self.machines.get()
        return Live(state, [r[0] for r in self.held.get()], self.detect), version

    def _save(self, live: Live, version: int) -> None:
        state, rows = live.state()
        self.machines.update((state, version))
        self.held.clear()
        if rows:
            self.held.put([(r,) for r in rows])

    def _frame(self, stream_id: str, rows: list[Row], version: int, final: bool) -> pd.DataFrame:
        made = row_columns(stream_id, rows, LINES.names) | {"version": [version] * len(rows), "final": [final] * len(rows)}
        return pd.DataFrame({n: pd.Series(v, dtype=None if n in _NUMBERS or n in ("version", "final") else object) for n, v in made.items()})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.ordered:
            rows = [pd.concat(list(rows)).sort_values("line_no", kind="stable")]
        live, version = self._load()
        version, settled = version + 1, []
        for new in rows:
            for raw, gaps, source in zip(new["raw"], new["gaps"], new["source"], strict=True):
                live.feed(live.next, raw, [tuple(map(int, g.split(":"))) for g in gaps.split(",")] if gaps else [], source)
                live.next += 1
                settled += live.settled()
                if len(settled) >= HANDED_ON:
                    yield self._frame(key[0], settled, version, True)
                    settled = []
        self._save(live, version)
        if self.timeout:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)
        if settled:
            yield self._frame(key[0], settled, version, True)
        if self.provisional and live.machine.rows:
            if live.session:
                live.session.show()
            yield self._frame(key[0], live.machine.rows, version, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        live, version = self._load()
        rows = live.finish()
        self._save(live, version + 1)
        if rows:
            yield self._frame(key[0], rows, version + 1, True)

    def close(self) -> None:
        pass


def structure_stream(lines: DataFrame, text: str = "text", detect_progress: bool = True, idle_timeout_ms: int = 0, provisional: bool = False) -> DataFrame:
    """Typed lines (LIVE_LINES) of a streaming (stream_id, text[, line_no][, source]); lines are numbered in order of line_no in each batch, else of arrival.

    idle_timeout_ms: a stream without new lines for so long is closed: rows held become final, and numbers go on if lines
    come later. provisional: rows held are handed out, too, after each batch of their stream. A task holds a stream's raw
    lines of one batch, to order them, so the source must bound its batches; typed rows go on as they settle. The query
    needs the RocksDB state store, which this sets for the session.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    order = ["line_no"] if "line_no" in lines.columns else []
    gaps = F.when(F.size("tab_gaps") > 0, F.array_join(F.transform("tab_gaps", lambda g: F.concat(g["start"], F.lit(":"), g["end"])), ","))
    source = (F.col("source") if "source" in lines.columns else F.lit(None)).cast("string").alias("source")
    d = clean_lines(lines, text).select(F.col("stream_id").cast("string").alias("stream_id"), "raw", gaps.alias("gaps"), source, *order)
    fold = Fold(detect_progress, idle_timeout_ms, bool(order), provisional)
    return d.groupBy("stream_id").transformWithStateInPandas(fold, LIVE_LINES, "Update" if provisional else "Append", "ProcessingTime" if idle_timeout_ms else "None")


def write_revisions(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Writes each batch of rows to a folder of its own, by batch id: a batch that runs again replaces what it wrote, so nothing counts twice."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w).start()


def current_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_revisions has written, as it stands: for each line its row of the highest version."""
    d = spark.read.schema(LIVE_LINES).parquet(path)
    rest = [c for c in LIVE_LINES.names if c not in ("stream_id", "line_no")]
    latest = d.groupBy("stream_id", "line_no").agg(F.max_by(F.struct(*rest), "version").alias("r"))
    return latest.select("stream_id", "line_no", *[F.col(f"r.{c}").alias(c) for c in rest])


def live_freq(labelled: DataFrame, rule_idx, label: str = "label") -> DataFrame:
    """Counts by rule or label, for update or complete output; rules without a hit are for the reader to add."""
    return labelled.where(F.col(label).isNotNull()).select(rule_idx.alias("rule_idx"), F.when(rule_idx < 0, F.col(label)).alias("label")).groupBy("rule_idx", "label").agg(F.count("*").alias("cnt"))


def live_rates(arrivals: DataFrame, seconds: int = 1, late: str = "10 seconds", ts: str = "arrival_ts") -> DataFrame:
    """Lines, greatest lag and a sketch of the lags of each second, with windows from the epoch (a batch run's are from its first arrival).

    For append output: a window comes once, when the watermark has passed it, and its state is freed; lines that are later
    than `late` are dropped, and late_rows() tells how many. rates.sketch_percentiles() reads the sketches.
    """
    d = arrivals.withWatermark(ts, late).groupBy("stream_id", F.window(ts, f"{seconds} seconds"))
    return d.agg(F.count("*").alias("lines"), F.max("lag_ns").alias("lag_max_ns"), lag_sketch(F.col("lag_ns")).alias("lags"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's watermark has dropped, by its progress so far."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops; append goes to Parquet, other modes replace the table batch by batch."""
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", path).start()
    else:
        q = w.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return q
