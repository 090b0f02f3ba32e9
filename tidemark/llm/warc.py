"""WARC archives: records with segments and chunked payloads are written, read back and put together again.

Files are written and read by Spark, so they may be in any store that Spark knows. A record that is longer than a
segment goes on in continuation records; they are brought together by their origin, put in order by segment number,
checked against the total length, and the chunked framing of the transfer is taken off.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, text_of

SEGMENT, CHUNK = 8192, 4096  # bytes of a record's block, and of a chunk of its payload
PER_FILE = 16384  # records
LEAST = 0  # bytes of a payload whose copies become revisits
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def base32(digest: Column) -> Column:
    """Base 32 of a SHA-1 given in hexadecimal."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    bits = lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    part = lambda i: F.concat(*[F.substring(letters, F.shiftright(bits(i), s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), part), "")


def _header(*fields: tuple[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", least: int = LEAST, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """(value): WARC records as bytes in a string, all but the last line end of each."""
    payload = F.col("payload")
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"), text_of(page).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    first = own.groupBy("sha").agg(F.min("page_id").alias("first"))
    rows = own.join(first, "sha").withColumn("bytes", F.octet_length("payload"))
    revisit = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("bytes") / chunk), F.lit(1)).cast("int") - 1), lambda i: F.substring(payload, i * chunk + 1, F.lit(chunk)))
    framed = F.transform(F.filter(pieces, lambda p: F.octet_length(p) > 0), lambda p: F.concat(F.hex(F.octet_length(p)).cast("binary"), F.lit(CRLF).cast("binary"), p, F.lit(CRLF).cast("binary")))
    head = lambda more: F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), more, F.lit(CRLF + CRLF))
    joined = F.concat(F.array_join(F.transform(framed, lambda p: p.cast("string")), ""), F.lit("0" + CRLF + CRLF))
    block = F.when(revisit, head(F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")))).otherwise(F.concat(head(F.lit("Transfer-Encoding: chunked")), joined)).cast("binary")
    name = lambda who: F.concat(F.lit("<urn:page:"), F.coalesce(who.cast("string"), F.lit("none")), F.lit(":"), F.col("sha"), F.lit(">"))
    made = rows.select("page_id", "url", "sha", "bytes", revisit.alias("revisit"), "first", block.alias("block"))
    size = F.octet_length("block")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / segment), F.lit(1)).cast("int") - 1), lambda i: F.substring(F.col("block"), i * segment + 1, F.lit(segment)))
    cut = made.select("page_id", "url", "sha", "bytes", "revisit", "first", size.alias("size"), F.posexplode(parts).alias("at", "part"))
    n = F.ceil(F.col("size") / segment)
    many, started, last = n > 1, F.col("at") == 0, F.col("at") == n - 1
    header = _header(
        ("WARC-Type", F.when(~started, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID", F.when(started, name(F.col("page_id"))).otherwise(F.concat(F.lit("<urn:part:"), F.col("at").cast("string"), F.substring(name(F.col("page_id")), 10, F.lit(1 << 20))))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.when(started, F.concat(F.lit("sha1:"), base32(F.col("sha"))))),
        ("WARC-Profile", F.when(started & F.col("revisit"), PROFILE)),
        ("WARC-Refers-To", F.when(started & F.col("revisit"), name(F.col("first")))),
        ("WARC-Segment-Number", F.when(many, (F.col("at") + 1).cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(many & ~started, name(F.col("page_id")))),
        ("WARC-Segment-Total-Length", F.when(many & last, F.col("size").cast("string"))),
        ("Content-Type", F.when(started, "application/http; msgtype=response")),
        ("Content-Length", F.octet_length("part").cast("string")),
    )
    return cut.select(F.concat(header, F.col("part").cast("string"), F.lit(CRLF)).alias("value"))


def write(pages: DataFrame, path: str, **options) -> None:
    """Archives of the pages, as gzip files of at most so many records each."""
    records(pages, **options).write.option("lineSep", CRLF).option("maxRecordsPerFile", PER_FILE).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of a file, which may be gzipped.

    Records are read one by one, so only one is unpacked at a time; a file that breaks off ends with its last whole one.
    """
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while stream.readline().startswith(b"WARC/"):
            fields = {}
            while line := stream.readline().rstrip(b"\r\n"):
                k, _, v = line.decode("utf-8", "replace").partition(":")
                fields[k.strip().lower()] = v.strip()
            size = int(fields.get("content-length", 0))
            block = stream.read(size)
            if len(block) < size:
                return
            yield fields, block
            stream.readline()
            stream.readline()
    except EOFError:
        return


def unchunk(body: bytes) -> tuple[bytes, bool]:
    """The payload within chunked framing, and whether the framing was whole."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return b"".join(out), False
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return b"".join(out), False
        if not size:
            return b"".join(out), True
        if line + 2 + size + 2 > len(body):
            return b"".join(out), False
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size + 2


def payload_of(block: bytes) -> tuple[bytes, dict[str, str], bool]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split(CRLF)[1:])}
    if fields.get("transfer-encoding", "").lower() == "chunked":
        body, whole = unchunk(body)
        return body, fields, whole
    return body, fields, True


_RECORD = "type string, record_id string, uri string, digest string, refers_to string, origin string, number int, total long, block binary, place string"
_OUT = "record_id string, uri string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string, whole boolean"


def _scan(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """Records of all files that are, or aren't, parts of a segmented one."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for path_, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for i, (f, block) in enumerate(parse(content.as_py())):
                    if ("warc-segment-number" in f) == segmented:
                        number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                        rows.append((f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), f.get("warc-segment-origin-id") or f.get("warc-record-id"), number and int(number), total and int(total), block, f"{path_}:{i:09}"))
                        size += len(block)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(run, _RECORD)


def reassemble(parts: DataFrame) -> DataFrame:
    """One record for each segmented one: parts in order of their number; missing parts or bytes make it not whole.

    If a record was stored twice, each copy is put together for itself.
    """
    copy = F.row_number().over(Window.partitionBy("origin", "number").orderBy("place"))
    grouped = parts.withColumn("copy", copy).groupBy("origin", "copy").agg(F.sort_array(F.collect_list(F.struct("number", "type", "uri", "digest", "refers_to", "total", "block"))).alias("p"))
    first, total = F.element_at("p", 1), F.element_at("p", -1)["total"]
    block = F.array_join(F.transform("p", lambda x: x["block"].cast("string")), "").cast("binary")
    in_order = F.forall(F.transform("p", lambda x, i: x["number"] == i + 1), lambda x: x)
    return grouped.select(first["type"].alias("type"), F.col("origin").alias("record_id"), first["uri"].alias("uri"), first["digest"].alias("digest"), first["refers_to"].alias("refers_to"), block.alias("block"), in_order.alias("in_order"), total.alias("total")).withColumn("whole", F.coalesce(F.col("in_order") & (F.octet_length("block") == F.col("total")), F.lit(False))).drop("in_order", "total")


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of the archives under a path, with payload, its length and digest (bare base 32 SHA-1).

    whole tells whether all segments and chunks were there and the digest is the one in the header. A revisit has no
    payload; its length and digest are those that its header gives. An empty folder of files gives no rows.
    """
    bound_batches(spark)
    plain = _scan(spark, path, False).select("type", "record_id", "uri", "digest", "refers_to", "block", F.lit(True).alias("whole"))
    every = plain.unionByName(reassemble(_scan(spark, path, True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                payload, fields, chunks = payload_of(r["block"])
                stated = (r["digest"] or "").removeprefix("sha1:")
                if r["type"] == "revisit":
                    rows.append((r["record_id"], r["uri"], "revisit", r["refers_to"], None, int(fields.get("content-length", 0)), stated, r["whole"]))
                else:
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((r["record_id"], r["uri"], r["type"], None, payload if keep_payload else None, len(payload), digest, r["whole"] and chunks and digest == stated))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_()))], [x.split()[0] for x in _OUT.split(", ")])

    return every.mapInArrow(run, _OUT)


def page_of(name: Column) -> Column:
    """The page_id that a record's name holds."""
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"<urn:page:(-?\d+):", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")


def round_trip(pages: DataFrame, path: str, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, whole): what the written archives give back.

    One row for each row of pages. Null pages and urls are empty ones. A payload that repeats is stored by the smallest
    page_id that has it (by each row of that page_id, if rows repeat); the others are revisits of it.
    """
    write(pages, path, **options)
    got = read(pages.sparkSession, path, keep_payload=False)
    return got.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"), "whole")
