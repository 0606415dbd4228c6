"""WARC archives whose repeated payloads become revisit records.

Archives are written by Spark's text writer: one row is one record, and the line separator is the blank line
that ends it (ISO 28500), so files are committed, retried and stored like any other output. Each file is one
gzip stream. They are read back record by record through their Content-Length, since a payload may itself
hold blank lines or the letters of a record header.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm.common import stored, text_or_empty
from paperlode.session import shared_dir

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is one row when it is read, so its bytes bound what a task holds at once. Records are written by classes of size;
#: a file of a class holds so many of them that it stays within the bound (or a single one that is larger itself).
FILE_BYTES, RECORDS_PER_FILE = 1 << 30, 4_000
#: Archives of a class lie in a folder named after the records that its files hold at most.
FOLDER = "records-"
#: How much of decompressed payload goes into one batch towards Spark.
BATCH_BYTES = 8 << 20

READ = (
    "record_id string, record_type string, page_id bigint, target_uri string, date string, refers_to_id string, "
    "payload_bytes bigint, payload_digest string, intact boolean"
)


def record_uuid(*seed: Column) -> Column:
    """A record identifier that follows from its seed, so that a repeated task writes the same archive."""
    h = F.sha2(F.concat_ws("\x1f", *seed), 256)
    parts = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def header_line(name: str, value: Column) -> Column:
    """`name: value` and a line end, or nothing for a null value. Line breaks inside a value are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def record(record_id: Column, kind: Column, page_id: Column, uri: Column, date: str, n_bytes: Column, digest: Column,
           payload: Column, refers: dict[str, Column] | None = None) -> Column:
    """One record as text: an HTTP response with its payload, or for revisits its HTTP header alone."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        n_bytes.cast("string"), F.lit(CRLF * 2)
    )
    block = F.concat(http, payload)
    lines = [
        F.lit(f"WARC/1.1{CRLF}"),
        header_line("WARC-Type", kind),
        header_line("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))),
        header_line("WARC-Date", F.lit(date)),
        header_line("WARC-Target-URI", uri),
        header_line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        *[header_line(name, value) for name, value in (refers or {}).items()],
        header_line("X-Page-ID", page_id),
        header_line("Content-Type", F.lit("application/http; msgtype=response")),
        header_line("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
    ]
    return F.concat(*lines, block)


def _classes(per_file: int, file_bytes: int) -> list[tuple[int, int | None, int]]:
    """(more than, at most, records a file) for classes of record sizes in bytes: fewer records as they get larger."""
    classes, least, n = [], -1, per_file
    while n > 1:
        classes.append((least, file_bytes // n, n))
        least, n = file_bytes // n, max(1, n // 32)
    return [*classes, (least, None, 1)]


def _write(records: DataFrame, path: str, per_file: int) -> None:
    writer = records.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip")
    writer.option("maxRecordsPerFile", per_file).text(f"{path}/{FOLDER}{per_file}")


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html", per_file: int = RECORDS_PER_FILE,
                   file_bytes: int = FILE_BYTES) -> str:
    """A response record for every row, also for rows that repeat; a null payload is empty, a null url or id leaves
    its header out."""
    html = text_or_empty(F.col(html_col))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("uri"),
        html.alias("payload"),
        F.octet_length(html).alias("n"),
        F.sha2(html, 256).alias("digest"),
        record_uuid(F.lit("capture"), F.monotonically_increasing_id().cast("string"), F.col(id_col)).alias("rid"),
    )
    text = record(F.col("rid"), F.lit("response"), F.col("page_id"), F.col("uri"), date, F.col("n"), F.col("digest"),
                  F.col("payload"))
    classes = _classes(per_file, file_bytes)
    sizes = [F.col("n") > more if most is None else F.col("n").between(more + 1, most) for more, most, _ in classes]
    there = rows.agg(*[F.bool_or(size).alias(f"c{k}") for k, size in enumerate(sizes)]).first()
    for k, (size, (_, _, n)) in enumerate(zip(sizes, classes)):
        if there[k] or k == 0:  # a class that no page is in needs no scan
            _write(rows.filter(size).select(text), path, n)
    return path


def _records(archive: bytes):
    """(headers, http headers, payload) of each record of an archive."""
    f = gzip.GzipFile(fileobj=io.BytesIO(archive))

    def headers(source) -> dict[str, str]:
        found = {}
        while (line := source.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            found[name.decode().lower()] = value.decode()
        return found

    while (version := f.readline()):
        if not version.strip():
            continue  # the blank lines between records
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {version[:40]!r}")
        head = headers(f)
        block = io.BytesIO(f.read(int(head["content-length"])))
        block.readline()
        http = headers(block)
        yield head, http, block.read()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives below `path`; with `payloads`, also their text.

    `intact` says that a response's payload has the digest and length that its header names (null for revisits).
    """
    schema = READ + (", payload string" if payloads else "")
    names = [column.split()[0] for column in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = pa.schema([(n, kinds[k]) for n, k in (column.split() for column in schema.split(", "))])

    def parse(batches):
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], types.field(i).type) for i in range(len(names))], schema=types
            )

        for b in batches:
            for content in b.column(0):
                for head, http, payload in _records(content.as_py()):
                    digest, n = head["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
                    response = head["warc-type"] == "response"
                    page, refers = head.get("x-page-id"), head.get("warc-refers-to")
                    intact = hashlib.sha256(payload).hexdigest() == digest and len(payload) == n if response else None
                    row = (head["warc-record-id"].strip("<>"), head["warc-type"], None if page is None else int(page),
                           head.get("warc-target-uri"), head["warc-date"], refers and refers.strip("<>"), n, digest,
                           intact)
                    rows.append((*row, payload.decode()) if payloads else row)
                    held += len(payload) if payloads else 200
                    if held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return _files(spark, path).select("content").mapInArrow(parse, schema)


def revisits(headers: DataFrame, min_bytes: int) -> DataFrame:
    """(record_id, original_id, original_uri, original_date) of every record that repeats an earlier payload.

    Headers meet by payload digest; the smallest page_id of a digest is the original (records without an id
    come last, equal ids go by record identifier).
    """
    large = headers.filter(F.col("payload_bytes") >= min_bytes)
    first = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "record_id", "target_uri", "date")
    originals = (
        large.groupBy("payload_digest")
        .agg(F.min(first).alias("o"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("payload_digest", F.col("o.record_id").alias("original_id"), F.col("o.target_uri").alias("original_uri"),
                F.col("o.date").alias("original_date"))
    )
    # stored, so that both sides of the join are exchanged and the adaptive planner can split a hot digest
    return (
        large.join(stored(originals, "originals"), "payload_digest")
        .filter("record_id != original_id")
        .select("record_id", "original_id", "original_uri", "original_date")
    )


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = 100,
                date: str = "2000-01-02T00:00:00Z") -> str:
    """Rewrite the archives of `source` to `target` with fresh headers: of equal payloads of at least `min_bytes`
    one record stays a response, the others become revisits that refer to it."""
    headers = stored(read_archives(spark, source), "warc-headers")
    repeats = stored(revisits(headers, min_bytes), "warc-revisits")
    again = F.col("original_id").isNotNull()

    def fresh(old: str) -> Column:
        return record_uuid(F.lit("deduplicated"), F.col(old))

    refers = {
        "WARC-Profile": F.when(again, F.lit(PROFILE)),
        "WARC-Refers-To": F.when(again, F.concat(F.lit("<"), fresh("original_id"), F.lit(">"))),
        "WARC-Refers-To-Target-URI": F.col("original_uri"),
        "WARC-Refers-To-Date": F.col("original_date"),
    }
    text = record(fresh("record_id"), F.when(again, "revisit").otherwise("response"), F.col("page_id"),
                  F.col("target_uri"), date, F.col("payload_bytes"), F.col("payload_digest"),
                  F.when(again, "").otherwise(F.col("payload")), refers)
    # folder by folder, each with as many records a file as before: no file gets larger and each is parsed once
    paths = _files(spark, source).select(F.regexp_extract("path", f"/({FOLDER}([0-9]+))/", 2).cast("int").alias("n"))
    for n in sorted(r.n for r in paths.distinct().collect()):
        rows = read_archives(spark, f"{source}/{FOLDER}{n}", payloads=True).join(repeats, "record_id", "left")
        _write(rows.select(text), target, n)
    return target


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) with revisits joined to their responses."""
    records = stored(records, "warc-read")
    responses = records.filter("record_type = 'response'")
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    original = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    repeats = records.filter("record_type = 'revisit'").join(original, "refers_to_id")
    return responses.select(*shown, F.lit(None).cast("bigint").alias("refers_to")).unionByName(
        repeats.select(*shown, "refers_to")
    )


def archive_and_resolve(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write all pages as archives, deduplicate them and read the result back: one row per page.

    Extra columns are ignored and an empty table gives no rows.
    """
    spark = pages.sparkSession
    captured = write_archives(pages, shared_dir(spark, "warc-captured"))
    kept = deduplicate(spark, captured, shared_dir(spark, "warc-deduplicated"), min_bytes)
    return resolved(read_archives(spark, kept))
