"""WARC archives: written with Spark's text sink, read by a Python data source.

The reader plans one partition for each archive file, parses the headers of a record first, and decodes the body only of
records that pass the pushed-down predicates. Archives may be plain or gzip compressed, on any file system Arrow opens.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith,
)

CRLF = "\r\n"
#: Shorter payloads are always written in full.
REVISIT_FROM_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column of the source and the header it comes from.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{name} string" for name in HEADERS) + ", content_length bigint, payload_length bigint, payload binary"


def header_safe(value: Column) -> Column:
    """A header value stays on its line: control characters and blanks become ``%20``."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20")


def with_revisits(pages: DataFrame, key: str, digest: str, length: str, at_least: int = REVISIT_FROM_BYTES) -> DataFrame:
    """Add ``refers_to``: null for records written in full, else the smallest key with the same payload.

    Groups are counted per digest before the shuffle and only repeated digests are joined back, as a join that Spark can
    split where one payload makes up much of the table. A null key never is the smallest, rows of the smallest key all count
    as first, and a group in which every key is null has no revisits.
    """
    repeated = (
        pages.filter(F.col(length) >= at_least)
        .groupBy(F.col(digest).alias("_digest")).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").drop("_n")
    )
    is_revisit = (F.col(length) >= at_least) & F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first"))
    joined = pages.join(repeated, F.col(digest) == F.col("_digest"), "left")
    return joined.withColumn("refers_to", F.when(is_revisit, F.col("_first"))).drop("_digest", "_first")


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", records_per_file: int = 100_000,
) -> None:
    """Write one response or revisit record per row; a null payload is empty.

    The record separator of the text sink is the blank line that ends a WARC record, so Spark's own commit protocol writes
    the archives and a lost task leaves nothing behind. A revisit has the HTTP head of its response but no payload.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(key).alias("_key"), F.col(url).alias("_url"), body.alias("_payload"), F.sha2(body.cast("binary"), 256).alias("_digest_hex"),
        F.octet_length(body).cast("bigint").alias("_bytes"),
    )
    rows = with_revisits(rows, "_key", "_digest_hex", "_bytes")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    block = F.when(F.col("refers_to").isNull(), F.concat(http, F.col("_payload"))).otherwise(http)
    urn = lambda c: F.concat(F.lit("<urn:page:"), header_safe(c), F.lit(">"))
    head = [
        ("WARC/1.1", None),
        ("WARC-Type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        ("WARC-Record-ID", urn(F.col("_key"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", header_safe(F.col("_url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest_hex"))),
        ("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), urn(F.col("refers_to")))),
        ("WARC-Profile", F.when(F.col("refers_to").isNotNull(), F.lit(PROFILE))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("_block").cast("string")),
    ]
    lines = [F.lit(name) if value is None else F.concat(F.lit(f"{name}: "), value) for name, value in head]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), F.col("_block"))
    (
        rows.withColumn("_block", block).select(record.alias("value"))
        .write.option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _test(rule, value: str | None) -> bool:
    kind, wanted = rule
    if value is None:
        return False
    return {
        "eq": lambda: value == wanted, "in": lambda: value in wanted, "starts": lambda: value.startswith(wanted),
        "ends": lambda: value.endswith(wanted), "contains": lambda: wanted in value, "present": lambda: True,
    }[kind]()


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.rules: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains", IsNotNull: "present"}
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            kind = kinds.get(type(f))
            if kind is None or column not in HEADERS:
                yield f
            else:
                self.rules.append((column, (kind, f.value if kind != "present" else None)))

    def partitions(self):
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))
        return [_File(name) for name in names]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        schema = pa.schema([(n, pa.string()) for n in HEADERS] + [("content_length", pa.int64()), ("payload_length", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        with system.open_input_stream(partition.path, compression=None) as raw:
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw, 1 << 20)
            for row in records(stream, self.rules, self.payload):
                rows.append(row)
                held += 500 + len(row[-1] or b"")
                if held > 8_000_000:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _skip(stream, n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, 1 << 20)))
        if not got:
            raise ValueError("the archive ends inside a record")
        n -= got


def _header_block(stream) -> dict[str, str]:
    found: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def records(stream, rules: list[tuple[str, tuple]], payload: bool) -> Iterator[tuple]:
    """Rows of the source for the records of one archive that pass all rules."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _header_block(stream)
        length = int(head.get("content-length", 0))
        values = {column: head.get(name.lower()) for column, name in HEADERS.items()}
        if not all(_test(rule, values[column]) for column, rule in rules):
            _skip(stream, length)
            continue
        body, payload_length = None, length
        if head.get("content-type", "").startswith("application/http"):
            block = stream.read(length)
            if len(block) < length:
                raise ValueError("the archive ends inside a record")
            http, _, rest = block.partition(b"\r\n\r\n")
            inner = _header_block(io.BytesIO(http.partition(b"\r\n")[2]))
            payload_length = int(inner.get("content-length", len(rest)))
            body = rest if payload else None
        elif payload:
            body = stream.read(length)
        else:
            _skip(stream, length)
        yield (*values.values(), length, payload_length, body)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under ``path``; equality, membership and text predicates on header columns are evaluated while parsing.

    ``payload=False`` leaves the bodies unread. Turns on Spark's predicate pushdown for Python sources, which is a session
    setting.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(urn: Column) -> Column:
    """The page key inside a record id."""
    return F.regexp_extract(urn, "^<urn:page:(.*)>$", 1)
