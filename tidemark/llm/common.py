"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small, so that long texts don't add up in a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > limit:
        spark.conf.set(key, str(limit))


def shared_dir(spark: SparkSession) -> str:
    """A folder that every executor sees: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not at:
        known = context._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = known.get() if known.isDefined() else "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: later steps read the rows, not the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; else the planner chooses. df is read to count it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scratch(spark: SparkSession, name: str) -> str:
    """A path for files of one run within the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_of(column: str = "text"):
    """A null text is an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(columns: list[str], name: str) -> str:
    """A column name that isn't taken."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[str]:
    """Names as select() takes them, dots and all."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def map_arrow(df: DataFrame, run, *added: T.StructField) -> DataFrame:
    """mapInArrow over all columns of df, whatever their names; run returns them in their order, and those added."""
    places = [f"c{i}" for i in range(len(df.columns))]
    fields = [T.StructField(c, f.dataType) for c, f in zip(places, df.schema.fields)]
    more = [T.StructField(f"d{i}", f.dataType) for i, f in enumerate(added)]
    return df.toDF(*places).mapInArrow(run, T.StructType(fields + more)).toDF(*df.columns, *(f.name for f in added))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column without nulls and the n + 1 offsets into them."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = str(column.type).startswith("large")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(good: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of good bytes; none crosses from one row to the next."""
    edge = np.zeros(len(good) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], good[:-1])) & ~edge[:-1] if len(good) else good
    after = np.concatenate((good[1:], [False])) & ~edge[1:] if len(good) else good
    starts = np.flatnonzero(good & ~before)
    ends = np.flatnonzero(good & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def pieces(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive ranges of rows of at most so many bytes each, or of one row."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        out.append((a, b))
        a = b
    return out
