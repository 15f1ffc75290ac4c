"""External command stage: items as JSON Lines on stdin, items back on stdout.

Runs inside Spark tasks: the JVM renders a partition's rows as JSON lines, one
child process per partition reads them while its output is read, and the JVM
parses the lines that come back, so nothing is held for a whole partition.
Commands must be row-local (filter, map, enrich).  The child's environment is
the task's plus ``env`` entries; a non-zero exit or a timeout fails the task
and reports the beginning of the command's stderr.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
import threading
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import duration_string, parse_duration
from ..schema import ITEM_JSONL_VERSION
from ..session import ship_package

DEFAULT_STDERR_LIMIT = 4096
_LINES_AT_ONCE = 2048


def _complaint(what: str, errors, limit: int) -> RuntimeError:
    """The failure, with up to ``limit`` characters of what the command said."""
    errors.seek(0)
    said = errors.read().decode("utf-8", "replace").strip()
    shown = said[:limit] + " [cut]" * (len(said) > limit)
    return RuntimeError(f"{what}: {shown}" if said else what)


def _through(argv: list[str], env: dict[str, str], timeout_s: float | None, limit: int, label: str,
             lines: Iterator[bytes]) -> Iterator[str]:
    """Output lines of one process that is fed ``lines``."""
    late = threading.Event()
    with tempfile.TemporaryFile() as errors:
        child = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=errors, env={**os.environ, **env})
        failed: list[BaseException] = []

        def feed() -> None:
            try:
                for line in lines:
                    child.stdin.write(line)
            except BrokenPipeError:
                pass  # the command stopped reading; its exit status tells
            except BaseException as e:  # raised in the task below
                failed.append(e)
            finally:
                try:
                    child.stdin.close()
                except BrokenPipeError:
                    pass

        def stop() -> None:
            late.set()
            child.kill()

        clock = threading.Timer(timeout_s, stop) if timeout_s else None
        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        if clock:
            clock.start()
        try:
            for line in child.stdout:
                if line.strip():
                    yield line.decode("utf-8")
            status = child.wait()
            feeder.join()
        finally:
            if clock:
                clock.cancel()
            if child.poll() is None:
                child.kill()
        if late.is_set():
            raise _complaint(f"{label}: command timed out after {duration_string(int(timeout_s * 1e9))}", errors, limit)
        if failed:
            raise failed[0]
        if status:
            raise _complaint(f"{label}: command failed: exit status {status}", errors, limit)


def external_command(df: DataFrame, command: str, args=(), env=(), timeout=None,
                     stderr_limit: int = DEFAULT_STDERR_LIMIT, name: str = "plugin") -> DataFrame:
    """Pipe items through ``command``; output rows keep the input schema.

    ``timeout`` holds for one partition."""
    ship_package(df.sparkSession)
    argv = [command, *list(args or [])]
    extra = dict(e.split("=", 1) for e in (env or []) if "=" in e)
    timeout_s = parse_duration(timeout) / 1e9 if timeout else None
    label, limit = name or "plugin", stderr_limit if stderr_limit > 0 else DEFAULT_STDERR_LIMIT

    def run(batches):
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def lines():
            for batch in chain([first], batches):
                yield from ((x + "\n").encode("utf-8") for x in batch.column(0).to_pylist())

        held: list[str] = []
        for line in _through(argv, extra, timeout_s, limit, label, lines()):
            held.append(line)
            if len(held) >= _LINES_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(held)], ["line"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held)], ["line"])

    record = F.to_json(F.struct(F.lit(ITEM_JSONL_VERSION).alias("schema_version"), *[F.col(c) for c in df.columns]))
    version = F.coalesce(F.get_json_object("line", "$.schema_version"), F.lit(""))
    problem = (F.when(F.try_parse_json(F.col("line")).isNull(), F.raise_error(F.concat(
        F.lit(f"{label}: output is no JSON line: "), F.col("line"))))
        .when(~version.isin("", ITEM_JSONL_VERSION), F.raise_error(F.concat(
            F.lit(f"{label}: unsupported schema_version "), version))))
    back = df.select(record.alias("line")).mapInArrow(run, "line string")
    return back.select(F.when(problem.isNull(), F.from_json("line", df.schema)).alias("r")).select("r.*")
