"""Python's own logging as a source: records go to a folder that a file stream reads."""

from __future__ import annotations

import json
import logging
import os
import threading
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.severity import LOGGING

SCHEMA = "idx long, timestamp string, level string, service string, message string"


class SpoolHandler(logging.Handler):
    """Writes so many records to a file at a time; a file appears in the folder when it is whole."""

    def __init__(self, folder: str, per_file: int = 100, level: int = logging.NOTSET):
        super().__init__(level)
        self.folder, self.per_file, self.rows, self.guard = folder, per_file, [], threading.Lock()
        os.makedirs(folder, exist_ok=True)

    def emit(self, record: logging.LogRecord) -> None:
        when = datetime.fromtimestamp(record.created, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        row = {"idx": int(record.created * 1e6), "timestamp": when, "level": LOGGING.get(record.levelname, record.levelname), "service": record.name, "message": record.getMessage()}
        with self.guard:
            self.rows.append(row)
            full = len(self.rows) >= self.per_file
        if full:
            self.flush()

    def flush(self) -> None:
        with self.guard:
            rows, self.rows = self.rows, []
        if rows:
            name = uuid.uuid4().hex
            hidden = os.path.join(self.folder, f".{name}")
            with open(hidden, "w", encoding="utf-8") as f:
                f.writelines(json.dumps(r) + "\n" for r in rows)
            os.rename(hidden, os.path.join(self.folder, f"{name}.json"))


def stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Records as lines; idx is the time in microseconds. So many files in each micro-batch at most."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).json(folder)
    return rows.select("idx", F.to_timestamp("timestamp").alias("ts"), "level", "service", "message")
