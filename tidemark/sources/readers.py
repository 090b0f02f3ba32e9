"""A data source for lines that are no files: an address, a command's output, standard input."""

from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KEPT_ERRORS = 20


def address(url: str, timeout: float = 30):
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as answer:  # an error status raises
        for line in answer:
            yield line.decode("utf-8", "replace").rstrip("\r\n")


def command(cmd: str):
    """Lines of both outputs of a shell command. It fails only if the command did and nothing was said; a command that
    is left is killed after three seconds."""
    import subprocess

    run = subprocess.Popen(cmd, shell=True, stdout=subprocess.PIPE, stderr=subprocess.STDOUT)
    said, last = False, deque(maxlen=KEPT_ERRORS)
    try:
        for line in run.stdout:
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            said = True
            last.append(text)
            yield text
        if run.wait() and not said:
            raise RuntimeError(f"command failed with {run.returncode}: {cmd}")
    finally:
        if run.poll() is None:
            run.terminate()
            try:
                run.wait(3)
            except subprocess.TimeoutExpired:
                run.kill()


class _Reader(DataSourceReader):
    def __init__(self, kind: str, target: str, lines: list[str] | None):
        self.kind, self.target, self.lines = kind, target, lines

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        made = iter(self.lines) if self.lines is not None else command(self.target) if self.kind == "cmd" else address(self.target)
        for i, line in enumerate(made):
            yield i, line


class LinesSource(DataSource):
    @classmethod
    def name(cls):
        return "tidemark_lines"

    def schema(self):
        return "idx long, value string"

    def reader(self, schema):
        kind = self.options.get("kind", "http")
        lines = None
        if kind == "stdin":
            import sys

            lines = [x.rstrip("\r\n") for x in sys.stdin]
        return _Reader(kind, self.options.get("target", ""), lines)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinesSource)
