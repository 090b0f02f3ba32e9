"""A command's output as a stream: its lines are written to small files in the shared folder, which a query reads."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import formats, times
from tidemark.operators.cut import shared_folder
from tidemark.sources.readers import command
from tidemark.streaming.live import Ladder, Live

CAPACITY, SNIFFED = 10_000, 200
END = object()
BREAKS = {10: " ", 13: " "}


class Spool:
    """Writes lines, each with its number and a tab before it, to files in a folder of any file system Spark knows.

    A file gets its name when it is whole, so a query never reads half of one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.n, self.files = folder, 0, 0
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(folder))

    def write(self, lines: list[str]) -> None:
        if not lines:
            return
        rows = [f"{self.n + i}\t{line.translate(BREAKS)}\n" for i, line in enumerate(lines)]
        hidden, whole = self.path(f"{self.folder}/_next"), self.path(f"{self.folder}/lines-{self.files:09d}.txt")
        out = self.fs.create(hidden, True)
        try:
            out.write("".join(rows).encode("utf-8", "replace"))
        finally:
            out.close()
        self.fs.rename(hidden, whole)
        self.n, self.files = self.n + len(lines), self.files + 1


def pump(lines: Iterable[str], room: queue.Queue) -> None:
    """Puts lines into the queue, waiting while it is full; what ends the lines comes last."""
    try:
        for line in lines:
            room.put(line)
        room.put((END, None))
    except Exception as error:  # the reader's failure is told to the one who waits
        room.put((END, error))


def drained(room: queue.Queue, most: int, seconds: float) -> tuple[list[str], tuple | None]:
    """Up to so many lines, waiting so long, and the end if it has come."""
    out, until = [], time.monotonic() + seconds
    while len(out) < most:
        try:
            got = room.get(timeout=max(0.01, until - time.monotonic()))
        except queue.Empty:
            break
        if isinstance(got, tuple):
            return out, got
        out.append(got)
        if time.monotonic() >= until:
            break
    return out, None


def numbered(text: DataFrame, fmt: str) -> DataFrame:
    """Entries of spooled lines, on streams too: idx, ts, level, service, message."""
    lines = text.select(F.substring_index("value", "\t", 1).cast("long").alias("idx"), F.substring("value", F.instr("value", "\t") + 1, F.length("value")).alias("value")).filter(F.col("idx").isNotNull())
    return formats.parsed(lines, fmt).select("idx", times.event_time(F.col("timestamp")).alias("ts"), "level", "service", "message")


def watch(
    spark: SparkSession, cmd: str | None = None, emit: Callable[[list], None] = print, fmt: str | None = None, lines: Iterable[str] | None = None, every: float = 3.0,
    capacity: int = CAPACITY, ladder: bool = True, policy: str = "block",
) -> Live:
    """Runs a command (or takes lines) to its end and scores what it says as it comes; gives the Live with its summary.

    The format is that of the first lines unless it is given. The command waits while the queue is full (block), or
    micro-batches above the capacity are shed by the policy. No output at all gives a summary of no lines; the command's
    failure is raised after its lines are scored. The folder is removed at the end.
    """
    room: queue.Queue = queue.Queue(capacity)
    threading.Thread(target=pump, args=(lines if lines is not None else command(cmd or ""), room), daemon=True).start()
    head, end = drained(room, SNIFFED, every)
    while not head and end is None:
        head, end = drained(room, SNIFFED, every)
    runner = Live(emit, ladder=Ladder(capacity) if ladder else None, limit=capacity, policy=policy, source=cmd or "lines")
    if head:
        if fmt is None:
            found = formats.sniff(spark.createDataFrame(list(enumerate(head)), "idx long, value string")).first()
            fmt = found["format"] if found else "PLAINTEXT"
        folder = f"{shared_folder(spark).rstrip('/')}/watch-{uuid.uuid4().hex}"
        spool = Spool(spark, f"{folder}/lines")
        try:
            spool.write(head)
            query = runner.start(numbered(spark.readStream.text(spool.folder), fmt), f"{folder}/state")
            try:
                while end is None and query.isActive:
                    more, end = drained(room, capacity, 1.0)
                    spool.write(more)
                query.processAllAvailable()
            finally:
                query.stop()
        finally:
            spool.fs.delete(spool.path(folder), True)
    if end and end[1] is not None:
        runner.load.error = str(end[1])
        raise end[1]
    return runner
