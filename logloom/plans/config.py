"""What a run is asked for: the options of a command line, and the run itself as DataFrames."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import rates, search, sequence
from ..sources.lines import parse_size
from ..sources.process import read_pipe, run_command

VERSION = "0.2"


@dataclass
class Options:
    """follow: show the newest lines; exit_on_eof: end with the input; bench: where metrics go; max_disk: bytes kept of each stream, 0 for all; command: what to run instead of reading a pipe."""

    follow: bool = True
    exit_on_eof: bool = False
    bench: str = ""
    max_disk: int = 0
    command: list[str] = field(default_factory=list)
    asks: str = ""
    unknown: list[str] = field(default_factory=list)

    @property
    def mode(self) -> str:
        return self.asks or ("command" if self.command else "pipe")


def parse(args: list[str]) -> Options:
    """Options of arguments; ValueError where a value is missing or no size. Unknown flags are kept apart."""
    out, rest = Options(), list(args)
    if rest[:1] and rest[0] in ("version", "--version", "-v"):
        out.asks = "version"
        return out
    while rest:
        a = rest.pop(0)
        if a == "--":
            out.command, rest = rest, []
        elif a in ("-h", "--help"):
            out.asks = "help"
            return out
        elif a == "--no-follow":
            out.follow = False
        elif a in ("-x", "--exit-on-eof"):
            out.exit_on_eof = True
        elif a in ("--bench", "--max-disk"):
            if not rest:
                raise ValueError(f"{a} needs a value")
            value = rest.pop(0)
            if a == "--bench":
                out.bench = value
            else:
                out.max_disk = parse_size(value)
        else:
            out.unknown.append(a)
    return out


def run(spark: SparkSession, options: Options, folder: str, pipe=None) -> tuple[DataFrame, int]:
    """Typed lines of the pipe or command, the newest that max_disk keeps; the exit code is the command's (-1 for a pipe)."""
    if options.command:
        lines, code = run_command(spark, options.command, folder)
    else:
        lines, code = read_pipe(spark, pipe or sys.stdin.buffer, folder), -1
    typed = sequence.structure(lines)
    if options.max_disk:
        typed = search.retain(typed, options.max_disk).drop("chunk_id")
    if options.bench:
        d = rates.tagged_lines(lines)
        rates.as_text(rates.rate_windows(d)).coalesce(1).write.mode("overwrite").text(options.bench)
    return typed, code
