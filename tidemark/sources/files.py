"""Where lines come from: files, globs, addresses, commands, lists; labelled files; guards."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Endings of files that hold no lines of text.
BINARY = """pdf doc docx xls xlsx ppt pptx odt png jpg jpeg gif bmp tiff webp ico mp3 mp4 mov avi zip gz tgz bz2 xz 7z rar tar exe dll
so bin o class pyc sqlite db""".split()
SNIFFED = 8192


class InvalidSource(ValueError):
    """A source that can't be read as lines of text."""


def check(path: str, strict: bool = True) -> None:
    """Refuses missing files, folders, binary endings, and content with zero bytes or a third of control characters.

    Spark reads gzip and bzip2 itself; only strict mode refuses them.
    """
    if not path:
        raise InvalidSource("no source given")
    if not os.path.exists(path):
        raise InvalidSource(f"no such file: {path}")
    if os.path.isdir(path):
        raise InvalidSource(f"a folder, not a file: {path}")
    ending = os.path.splitext(path)[1].lower().lstrip(".")
    if ending in BINARY and (strict or ending not in ("gz", "bz2")):
        raise InvalidSource(f"not a text file: {path}")
    if ending in ("gz", "bz2"):
        return
    with open(path, "rb") as f:
        head = f.read(SNIFFED)
    if looks_binary(head):
        raise InvalidSource(f"binary content: {path}")


def looks_binary(head: bytes) -> bool:
    if b"\0" in head:
        return True
    try:
        head.decode()
        return False
    except UnicodeDecodeError as error:
        if error.start >= len(head) - 3 and error.reason == "unexpected end of data":
            return False
    odd = sum(not (b in (9, 10, 11, 12, 13) or 32 <= b < 127 or b >= 160) for b in head)
    return odd > 0.30 * len(head)


def read(spark: SparkSession, paths: str | list[str], source: str | None = None) -> DataFrame:
    """(source, idx, value): lines of text files, numbered from 0 in the order of file and place.

    Files are split and read in parallel; a line's number is its place in its partition plus the lines of the partitions
    before, so there is no global sort.
    """
    lines = spark.read.text(paths).select(
        F.lit(source).alias("source") if source else F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"),
        F.regexp_replace("value", r"\r+$", "").alias("value"),
    )
    local = lines.withColumn("_at", F.spark_partition_id())
    blocks = local.groupBy("_file", "_start", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a row for each split of a file: as small as the number of splits
    return local.join(F.broadcast(before.select("_file", "_start", "_first", "_before")), ["_file", "_start"]).select("source", (F.col("_before") + F.col("_id") - F.col("_first")).alias("idx"), "value")


def from_lines(spark: SparkSession, lines: list[str], source: str = "memory") -> DataFrame:
    return spark.createDataFrame([(source, i, v.rstrip("\r\n")) for i, v in enumerate(lines)], "source string, idx long, value string")


def dispatch(spark: SparkSession, target: str, source: str | None = None) -> DataFrame:
    """Lines of "-" (standard input), "cmd:...", an http address, or else a path."""
    if target == "-" or target.startswith(("cmd:", "http://", "https://")):
        from . import readers

        readers.register(spark)
        kind = "stdin" if target == "-" else "cmd" if target.startswith("cmd:") else "http"
        own = target[4:] if kind == "cmd" else target
        return spark.read.format("tidemark_lines").option("kind", kind).option("target", own).load().select(F.lit(source or kind).alias("source"), "idx", "value")
    return read(spark, target, source)


def analyse_input(spark: SparkSession, source: str | None = None, lines: list[str] | None = None, cmd: str | None = None) -> DataFrame:
    """Exactly one of a source, a list of lines and a command."""
    if sum(x is not None for x in (source, lines, cmd)) != 1:
        raise ValueError("give exactly one of source, lines and cmd")
    if lines is not None:
        return from_lines(spark, lines)
    return dispatch(spark, f"cmd:{cmd}" if cmd is not None else source)


@dataclass(frozen=True)
class Spec:
    id: str
    target: str


def parse_specs(items: list[str]) -> list[Spec]:
    """name=target, cmd:..., address or path; ids are slugs, a repeated one gets -2, -3."""
    out: list[Spec] = []
    for item in items:
        name, eq, tail = item.partition("=")
        named = eq and re.fullmatch(r"[A-Za-z0-9_.-]+", name) and not name.lower().startswith(("http", "cmd"))
        target = (tail if named else item).strip()
        if not target:
            raise ValueError(f"empty target in {item!r}")
        if target.startswith("cmd:"):
            base = (target[4:].split() or ["cmd"])[0]
        else:
            base = os.path.basename(target.rstrip("/")) or ("url" if "://" in target else target)
        slug = re.sub(r"[^a-z0-9_.-]+", "-", (name if named else base).lower()).strip("-") or "source"
        taken, own, n = {s.id for s in out}, slug, 2
        while own in taken:
            own, n = f"{slug}-{n}", n + 1
        out.append(Spec(own, target))
    return out


def read_all(spark: SparkSession, items: list[str]) -> DataFrame:
    """Lines of several sources, one under the other."""
    frames = [dispatch(spark, s.target, s.id) for s in parse_specs(items)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- labelled lines --------------------------------------------------------------------------------------------------


def labelled(lines: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """(idx, label, message) of bgl ("-" is normal), labeled (0 or 1, a tab) or jsonl (label and line) lines."""
    v = F.col(value)
    if kind == "bgl":
        label, message = (F.regexp_extract(v, r"^(\S+)", 1) != "-").cast("int"), F.regexp_replace(v, r"^\S+\s?", "")
    elif kind == "labeled":
        label, message = F.coalesce(F.split_part(v, F.lit("\t"), F.lit(1)).try_cast("int"), F.lit(0)), F.regexp_replace(v, r"^[^\t]*\t", "")
    elif kind == "jsonl":
        label, message = F.coalesce(F.get_json_object(v, "$.label").try_cast("int"), F.lit(0)), F.coalesce(F.get_json_object(v, "$.line"), F.get_json_object(v, "$.message"))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return lines.filter(F.btrim(F.coalesce(v, F.lit(""))) != "").select("idx", label.alias("label"), message.alias("message"))


def block_labels(lines: DataFrame, labels: DataFrame, value: str = "value") -> DataFrame:
    """(idx, label, message): lines that name a block take its label (Anomaly or not); others are normal."""
    block = F.nullif(F.regexp_extract(value, r"(blk_-?\d+)", 1), F.lit(""))
    known = labels.select(F.col("BlockId").alias("_b"), (F.lower("Label") == "anomaly").cast("int").alias("_l"))
    own = lines.withColumn("_block", block)
    return own.join(known, F.col("_block") == F.col("_b"), "left").select("idx", F.coalesce("_l", F.lit(0)).alias("label"), F.col(value).alias("message"))


# --- results ---------------------------------------------------------------------------------------------------------


def save_results(path: str, families: DataFrame, lines: DataFrame, histogram: DataFrame, span: DataFrame) -> None:
    """Four tables under a path; each is replaced as a whole."""
    for name, df in {"families": families, "top_lines": lines, "level_time_hist": histogram, "time_span": span}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("families", "top_lines", "level_time_hist", "time_span")}


def save_baseline(baseline: DataFrame, path: str, version: int) -> str:
    """A version of its own folder, so a reader never meets a half-written one."""
    at = f"{path}/v{version:08}"
    baseline.write.mode("errorifexists").parquet(at)
    return at


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version that was written to its end, or None."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return None
    names = sorted(s.getPath().getName() for s in store.listStatus(root) if store.exists(hadoop.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None
