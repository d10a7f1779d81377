"""Multi-line log events on a stream (S20 in ST1): lines cut by file, split or batch borders come together again.

A line that begins with a date begins an event; the lines after it belong to it. Each task glues the lines of its own splits, so
that whole events need no more than to pass. Only what stands at a split's borders, the lines before its first event and
its last event, goes to the keyed state of its log, where an event stays open until the next one begins. With
``flush_s`` a log that is silent for so long has its open event put out by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Fixed value: a line that matches begins an event.
START_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
SPREAD = 32

PARTS = "file string, way int, written long, path string, block long, kind int, first string, rest string, lines long"
EVENTS = "file string, first string, rest string, lines long"
WHOLE, HEAD, OPEN = 0, 1, 2


def _events(lines: pa.Array) -> tuple[str | None, list[tuple]]:
    """(lines before the first event, (first line, further lines, number) of each event) of lines in order."""
    starts = np.flatnonzero(pc.match_substring_regex(lines, START_PATTERN).to_numpy(zero_copy_only=False))
    text = lines.to_pylist()
    ends = [*starts[1:].tolist(), len(text)]
    head = text[:starts[0]] if len(starts) else text
    return "\n".join(head) if head else None, [(text[a], "\n".join(text[a + 1:b]) or None, b - a) for a, b in zip(starts.tolist(), ends)]


class _Split:
    """The parts of one split: an event is whole once the next one begins."""

    def __init__(self, place: tuple):
        self.place, self.head, self.head_lines, self.open, self.rows = place, [], 0, None, []

    def add(self, lines: pa.Array) -> None:
        head, events = _events(lines)
        if head is not None:
            n = len(lines) - sum(e[2] for e in events)
            if self.open:
                first, rest, k = self.open
                self.open = (first, head if rest is None else f"{rest}\n{head}", k + n)
            else:
                self.head.append(head)
                self.head_lines += n
        if events:
            whole = ([self.open] if self.open else []) + events[:-1]
            self.rows += [(WHOLE, *e) for e in whole]
            self.open = events[-1]

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return [self._row(i, *r) for i, r in enumerate(rows)]

    def close(self) -> list[tuple]:
        border = [(HEAD, None, "\n".join(self.head), self.head_lines)] if self.head_lines else []
        return self.take() + [self._row(0, *r) for r in border + ([(OPEN, *self.open)] if self.open else [])]

    def _row(self, i: int, kind: int, first, rest, n) -> tuple:
        file, written, path, block = self.place
        return (file, 0 if kind else 1 + i % SPREAD, written, path, block, kind, first, rest, n)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PARTS.split(", ")])


def split_parts(batches) -> Iterator[pa.RecordBatch]:
    """Rows of PARTS from lines (``file, written, path, block, line``) that come split by split, in order."""
    schema, split = _schema(), None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for b in batches:
        place = [b.column(c) for c in ("file", "written", "path", "block")]
        change = np.ones(b.num_rows, bool)
        if b.num_rows > 1:
            change[1:] = np.logical_or.reduce([pc.not_equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False) for c in place])
        at = np.flatnonzero(change).tolist()
        for lo, hi in zip(at, [*at[1:], b.num_rows]):
            here = tuple(c[lo].as_py() for c in place)
            if split is None or split.place != here:
                if split and (rows := split.close()):
                    yield batch(rows)
                split = _Split(here)
            split.add(b.column("line").slice(lo, hi - lo))
            if rows := split.take():
                yield batch(rows)
    if split and (rows := split.close()):
        yield batch(rows)


class Stitcher(StatefulProcessor):
    """Holds the open event of each log."""

    def __init__(self, flush_s: float | None):
        self.flush_s = flush_s

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first string, rest string, lines long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1]:  # whole events, on their way
            for part in rows:
                yield part[["file", "first", "rest", "lines"]]
            return
        parts = pd.concat(list(rows)).sort_values(["written", "path", "block", "kind"], kind="stable")
        held = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for part in parts.astype(object).where(parts.notna(), None).itertuples(index=False):
            if part.kind == HEAD:
                if held is None:  # lines of an event that was never seen, or put out already
                    out.append((key[0], None, part.rest, part.lines))
                else:
                    held = (held[0], part.rest if held[1] is None else f"{held[1]}\n{part.rest}", held[2] + part.lines)
            else:
                if held is not None:
                    out.append((key[0], *held))
                held = (part.first, part.rest, part.lines)
        if held is not None:
            self.open.update(held)
            if self.flush_s is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.flush_s * 1000))
        if out:
            yield pd.DataFrame(out, columns=["file", "first", "rest", "lines"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield pd.DataFrame([(key[0], *self.open.get())], columns=["file", "first", "rest", "lines"])
            self.open.clear()

    def close(self) -> None:
        pass


def log_events(spark, source: str, files_per_trigger: int = 1, flush_s: float | None = None) -> DataFrame:
    """A stream of events (``file, first, rest, lines``) of the logs under ``source/file=<log>/``, chunk by chunk as written."""
    text = spark.readStream.schema("value string, file string").format("text").option("maxFilesPerTrigger", files_per_trigger).load(source)
    lines = text.select("file", F.unix_micros("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("path"),
                        F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return lines.mapInArrow(split_parts, PARTS).groupBy("file", "way").transformWithStateInPandas(
        statefulProcessor=Stitcher(flush_s), outputStructType=EVENTS, outputMode="Append",
        timeMode="None" if flush_s is None else "ProcessingTime")
