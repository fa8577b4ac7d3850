"""A streaming source of growing text files, such as logs that are being written.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").option("glob", "/shared/logs/*.log").load()

Rows are (stream_id: the file, offset: the byte at which the line begins, text). Offsets are bytes read of each file, so a
restarted query goes on where it was and an appended line comes once. A last line without its newline waits for it. Files
are read by executors, in ranges of RANGE bytes; all machines must see them under the same path. A file that has become
shorter is read from its beginning again, as one that was cut off and written anew.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

RANGE = 64 << 20
#: Bytes looked at in one step for the last newline.
STEP = 1 << 16


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: int) -> None:
        """Lines that begin in [begin, end) of a file; first: where a line is known to begin."""
        self.path, self.begin, self.end, self.first = path, begin, end, first


def whole_lines(path: str, seen: int) -> int:
    """The byte after the last newline, or `seen` if none stands behind it; 0 onwards for a file that is shorter than that."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        low = seen if end >= seen else 0
        while end > low:
            begin = max(low, end - STEP)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return low


def lines_of(part: Range) -> Iterator[tuple[str, int, str]]:
    with open(part.path, "rb") as f:
        at = part.begin
        if at > part.first:  # the line that reaches into the range is the range's before
            f.seek(at - 1)
            at += len(f.readline()) - 1
        else:
            f.seek(at)
        while at < part.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield part.path, at, line[:-1].removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line)


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, step: int) -> None:
        self.pattern, self.step, self.last = pattern, step, None

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """The whole lines that each file has by now."""
        seen, out = self.last or {}, {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                upto = whole_lines(path, seen.get(path, 0))
            except FileNotFoundError:  # it has gone meanwhile
                continue
            out[path] = upto
        self.last = out
        return {"files": json.dumps(out)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        begin, upto = json.loads(start["files"]), json.loads(end["files"])
        self.last = upto
        out = []
        for path, to in upto.items():
            first = begin.get(path, 0)
            first = first if first <= to else 0
            out += [Range(path, lo, min(lo + self.step, to), first) for lo in range(first, to, self.step)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_of(partition)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> StructType:
        return StructType([StructField("stream_id", StringType()), StructField("offset", LongType()), StructField("text", StringType())])

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["glob"], int(self.options.get("range", RANGE)))
