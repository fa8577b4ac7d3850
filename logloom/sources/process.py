"""Lines of pipes and of commands, written to a folder in chunks as they come, so that batch and streaming readers can take them.

The folder must be one that all executors see: the caller names it.
"""

from __future__ import annotations

import queue
import signal
import subprocess
import threading
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "stream_id string, line_no long, text string, source string"
#: Lines of a chunk, longest line in bytes, lines that wait for the writer, seconds from the polite signal to the last one.
CHUNK, LONGEST, WAITING, GRACE = 8192, 1 << 20, 100_000, 2.0


def split_lines(chunks: Iterable[bytes], longest: int = LONGEST) -> Iterator[str]:
    """Lines at newlines, one CR before them dropped; ends before a line that is longer than `longest`, as the text after it has no safe beginning."""
    rest = b""
    for c in chunks:
        *whole, rest = (rest + c).split(b"\n")
        for line in whole:
            if len(line) >= longest:
                return
            yield line.removesuffix(b"\r").decode("utf-8", "replace")
        if len(rest) >= longest:
            return
    if rest:
        yield rest.removesuffix(b"\r").decode("utf-8", "replace")


class Lines:
    """Numbers tagged lines and writes them, CHUNK at a time, as Parquet below a folder."""

    def __init__(self, spark: SparkSession, folder: str, stream_id: str, chunk: int = CHUNK) -> None:
        self.spark, self.folder, self.stream_id, self.chunk, self.rows, self.next = spark, folder, stream_id, chunk, [], 0

    def add(self, text: str, source: str) -> None:
        self.rows.append((self.stream_id, self.next, text, source))
        self.next += 1
        if len(self.rows) >= self.chunk:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
            self.rows = []

    def frame(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(SCHEMA).parquet(self.folder) if self.next else self.spark.createDataFrame([], SCHEMA)


def read_pipe(spark: SparkSession, pipe, folder: str, stream_id: str = "stdin") -> DataFrame:
    """Lines of a binary file object, such as sys.stdin.buffer, until it ends."""
    out = Lines(spark, f"{folder}/{uuid.uuid4().hex}", stream_id)
    for line in split_lines(iter(lambda: pipe.read(1 << 16), b"")):
        out.add(line, "stdin")
    return out.frame()


class Command:
    """A command whose output is read from two channels; lines come in the order in which they arrive."""

    def __init__(self, args: list[str]) -> None:
        self.process = subprocess.Popen(args, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, bufsize=0)
        self.waiting: queue.Queue = queue.Queue(WAITING)
        pipes = [(self.process.stdout, "stdout"), (self.process.stderr, "stderr")]
        self.readers = [threading.Thread(target=self._read, args=p, daemon=True) for p in pipes]
        for t in self.readers:
            t.start()

    def _read(self, pipe, source: str) -> None:
        for line in split_lines(iter(lambda: pipe.read(1 << 16), b"")):
            self.waiting.put((line, source))
        while pipe.read(1 << 16):  # after a line that is too long: the command may not block on its pipe
            pass
        self.waiting.put(None)

    def lines(self) -> Iterator[tuple[str, str]]:
        """(text, source) until both channels end."""
        for _ in self.readers:
            yield from iter(self.waiting.get, None)

    def stop(self, grace: float = GRACE) -> None:
        """Asks the command to end, and ends it after `grace` seconds."""
        if self.process.poll() is None:
            self.process.send_signal(signal.SIGTERM)
            try:
                self.process.wait(grace)
            except subprocess.TimeoutExpired:
                self.process.kill()

    @property
    def exit_code(self) -> int:
        """-1 while it runs and where a signal ended it."""
        code = self.process.poll()
        return -1 if code is None or code < 0 else code


def run_command(spark: SparkSession, args: list[str], folder: str, stream_id: str = "command") -> tuple[DataFrame, int]:
    """All lines of a command's output, with their source, and its exit code."""
    command, out = Command(args), Lines(spark, f"{folder}/{uuid.uuid4().hex}", stream_id)
    try:
        for text, source in command.lines():
            out.add(text, source)
        command.process.wait()
    finally:
        command.stop()
    return out.frame(), command.exit_code
