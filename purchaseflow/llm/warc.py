"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is written as a request, a response (or a revisit of an equal payload) and a metadata record, linked by
WARC-Concurrent-To. ``assemble`` joins records through those identifiers, whichever way they point, into one nested
row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, column, join_hot, new_folder, utf8, written

#: Payloads from this size on are stored once (fixed by the contract of op1).
REVISIT_FROM = 1000
#: Compressed bytes after which a new archive is begun; one archive is read by one task.
ROLL_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAIN = ("response", "revisit")


def record_id(kind: str, page: Column, digest: Column, nth: Column) -> Column:
    """A URN that the same capture always gets, so that a retried task writes the same archive."""
    code = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), digest, nth.cast("string")))
    part = lambda a, n: F.substring(code, a, n)
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12))


def captures_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Rows to write: page_id, url, payload, digest, and for revisits the record that is referred to.

    Of equal payloads (SHA-1 and length) of at least ``revisit_from`` bytes, the row with the largest id is the
    response. Rows that repeat this id too are responses; null ids count as smaller than any. Only ids and digests
    are compared, and a payload that many pages share is told to their tasks; payloads move once, to meet their decision.
    An empty table gives no rows; other columns are left out, whatever their names.
    """
    rows = pages.select(column(id_col).cast("long").alias("page_id"), column(url_col).cast("string").alias("url"), utf8(column(html_col)).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    ids = rows.select("page_id", "digest", F.length("payload").alias("size")).where(F.col("size") >= revisit_from)
    ids = written(pages.sparkSession, ids.withColumn("key", F.concat_ws(":", "digest", F.col("size").cast("string"))), "warc-ids")
    groups = ids.groupBy(F.col("key").alias("of")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = lambda c: F.coalesce(c.cast("string"), F.lit("null"))  # noqa: E731  plain keys, so that join and numbering share one shuffle
    repeats = (
        join_hot(ids, "key", groups, "of", "n", ids.count()).where(~F.col("page_id").eqNullSafe(F.col("last")))
        .groupBy(named(F.col("page_id")).alias("name"), "digest").agg(F.max("last").alias("last"), F.lit(True).alias("again"))
    )
    out = rows.withColumn("name", named(F.col("page_id"))).join(repeats, ["name", "digest"], "left")
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy("name", "digest").orderBy("url")))
    kinds = {k: record_id(k, F.col("page_id"), F.col("digest"), F.col("nth")) for k in ("request", "capture", "metadata")}
    refers = F.when(F.col("again"), record_id("capture", F.col("last"), F.col("digest"), F.lit(1)))
    return out.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), *(v.alias(f"{k}_id") for k, v in kinds.items()))


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _record(kind: str, rid: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), *fields, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _line(value: str) -> str:
    """A header value on one line: control characters as percent escapes, and the percent sign before them too."""
    return re.sub(r"[\x00-\x1f\x7f]|%(?=[01][0-9A-Fa-f]|7[Ff]|25)", lambda m: f"%{ord(m[0]):02X}", value)


def _plain(value: str) -> str:
    return re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), value)


def transaction(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, request: str, capture: str, meta: str) -> bytes:
    """The three records of a capture, each a gzip member of its own."""
    uri = [] if url is None else [("WARC-Target-URI", _line(url))]
    both = [*uri, ("WARC-Concurrent-To", f"<{capture}>")]
    host, _, path = (url or "").partition("://")[2].partition("/")
    asked = f"GET /{_line(path)} HTTP/1.1\r\nHost: {_line(host)}\r\n\r\n".encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [*uri, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        main = _record("response", capture, head + payload, fields)
    else:
        main = _record("revisit", capture, head, [*fields, ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)])
    known = b"" if page_id is None else b"page-id: %d\r\n" % page_id
    return (
        _record("request", request, asked, [*both, ("Content-Type", "application/http; msgtype=request")])
        + main
        + _record("metadata", meta, known, [*both, ("Content-Type", "application/warc-fields")])
    )


def write_archives(captures: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Writes ``captures_of`` rows as .warc.gz files; returns the manifest (path, captures, bytes), which is written first.

    A file gets its name from its task and is moved there when whole, so a task that runs again, or twice, replaces
    what it wrote and readers never see part of a file.
    """
    spark = captures.sparkSession

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _folder(folder)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        part, attempt, done = task.partitionId(), task.taskAttemptId(), []
        held, size, rows = [], 0, 0

        def close() -> None:
            nonlocal held, size, rows
            if rows:
                name, draft = f"{top}/captures-{part:06d}-{len(done):04d}.warc.gz", f"{top}/_draft-{part}-{attempt}"
                with store.open_output_stream(draft, compression=None) as f:
                    for x in held:
                        f.write(x)
                store.move(draft, name)
                done.append((name, rows, size))
            held, size, rows = [], 0, 0

        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(x := transaction(*row))
                size, rows = size + len(x), rows + 1
                if size >= roll:
                    close()
        close()
        yield from batches(done, pa.schema([("path", pa.string()), ("captures", pa.int64()), ("bytes", pa.int64())]))

    return written(spark, captures.mapInArrow(run, "path string, captures long, bytes long"), "warc-manifest")


RECORD = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()),
    ("refers_to", pa.string()), ("content_type", pa.string()), ("http_head", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_sha1", pa.string()), ("digest_ok", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())),
])
RECORD_SQL = (
    "record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to string, content_type string, "
    "http_head string, payload binary, payload_bytes long, payload_sha1 string, digest_ok boolean, fields map<string,string>"
)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Rows of RECORD from the bytes of an archive. Header names are case-blind. A record shorter than
    its Content-Length raises EOFError: what may follow it would be lost without a word."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head: dict[str, str] = {}
        linked = []
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "warc-concurrent-to":
                linked.append(value.strip("<>"))
            else:
                head[name] = value
        size = int(head.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise EOFError(f"a record of {size} bytes ends after {len(block)}")
        kind, about, http, payload, fields = head.get("warc-type", ""), head.get("content-type", ""), None, block, None
        if about.startswith("application/http"):
            front, _, payload = block.partition(b"\r\n\r\n")
            http = front.decode("utf-8", "replace")
        elif about == "application/warc-fields":
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if x.strip())]
        sha1, ok = None, None
        if kind == "revisit":
            payload = None
        elif payload is not None:
            sha1 = hashlib.sha1(payload).hexdigest()
            if said := head.get("warc-payload-digest"):
                ok = said == f"sha1:{sha1}"
        uri = head.get("warc-target-uri")
        yield (
            head.get("warc-record-id", "").strip("<>"), kind, linked, None if uri is None else _plain(uri), head.get("warc-date"),
            head.get("warc-refers-to", "").strip("<>") or None, about, http, payload, None if payload is None else len(payload), sha1, ok, fields,
        )


def read_archives(spark: SparkSession, folder: str, kinds: tuple[str, ...] = (), payloads: bool = True) -> DataFrame:
    """All records (RECORD) of the .warc.gz files in ``folder``, read by Spark, one file a row of its scan.

    ``kinds`` keeps only such records; without ``payloads`` their bytes stay in the task that read them.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in it:
                for content in b.column(0):
                    with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as f:
                        for r in parse(io.BufferedReader(f, 1 << 18)):
                            if not kinds or r[1] in kinds:
                                yield r if payloads else (*r[:8], None, *r[9:])

        yield from batches(rows(), RECORD, weight=lambda r: r[9] or 0)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content").mapInArrow(run, RECORD_SQL)


def membership(records: DataFrame) -> DataFrame:
    """(record_id, capture_id) of each record that concurrent-to links tie to a response or revisit, directly or over
    one other record, in either direction. Takes record_id, type, concurrent_to; a record of two captures is in both."""
    is_main = F.col("type").isin(*MAIN)
    main = records.where(is_main).select(F.col("record_id").alias("main"))
    linked = records.select("record_id", is_main.alias("is_main"), F.explode("concurrent_to").alias("to"))
    # what captures name needs no look-up; what names something is looked up among the captures
    named = linked.where("is_main").select(F.col("to").alias("record_id"), F.col("record_id").alias("capture_id"))
    named = named.join(main, F.col("record_id") == F.col("main"), "left_anti")
    asked = linked.where("NOT is_main").join(main, F.col("to") == F.col("main"), "left")
    first = named.union(asked.where("main IS NOT NULL").select("record_id", F.col("main").alias("capture_id")))
    # a link between two other records passes on what either has
    other = asked.where("main IS NULL").select(F.col("record_id").alias("a"), F.col("to").alias("b"))
    other = other.union(other.select("b", "a"))
    second = other.join(first.select(F.col("record_id").alias("via"), "capture_id"), F.col("b") == F.col("via")).select(F.col("a").alias("record_id"), "capture_id")
    second = second.join(main, F.col("record_id") == F.col("main"), "left_anti")
    second = second.join(first.select(F.col("record_id").alias("had")), F.col("record_id") == F.col("had"), "left_anti")
    return first.union(second).distinct()


def assemble(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per response or revisit record: the record's columns, and ``requests`` and ``metadata`` as arrays of structs
    (ordered by record id; empty if none). Records that no link ties to a capture are left out, see ``membership``. A record
    that stands in the archives twice is there twice, headers that are missing are null, and no archives give no rows."""
    records = written(spark, read_archives(spark, folder, payloads=False), "warc-records")
    links = membership(records)
    side = records.where(F.col("type").isin("request", "metadata")).select("record_id", "type", "http_head", "fields", "date")
    nested = F.struct("record_id", "date", "http_head", "fields")
    sides = (
        side.join(links, "record_id").groupBy("capture_id")
        .agg(*(F.sort_array(F.collect_list(F.when(F.col("type") == k, nested.dropFields("fields") if k == "request" else F.struct("record_id", "date", F.map_entries("fields").alias("fields"))))).alias(n) for k, n in (("request", "requests"), ("metadata", "metadata"))))
    )
    main = read_archives(spark, folder, MAIN) if payloads else records.where(F.col("type").isin(*MAIN))
    return main.join(sides, main.record_id == sides.capture_id, "left").drop("capture_id", "concurrent_to", "fields")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll: int = ROLL_BYTES) -> DataFrame:
    """Writes all pages as archives into the shared folder, reads these back and returns the assembled captures, one for
    each row. Null html is an empty payload, a null url or id is left out of the headers; an empty table gives no rows."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    total = write_archives(captures_of(pages, id_col, url_col, html_col), folder, roll).agg(F.sum("captures")).first()[0]
    if not total:
        store, top = _folder(folder)
        store.create_dir(top, recursive=True)
    return assemble(spark, folder, payloads=False)


def page_ids(captures: DataFrame) -> DataFrame:
    """Captures with page_id from their metadata, and for revisits payload size, digest and page_id of the record referred to."""
    found = F.filter(F.flatten(F.transform("metadata", lambda m: m["fields"])), lambda e: e["key"] == "page-id")
    rows = captures.withColumn("page_id", F.try_element_at(found, F.lit(1))["value"].cast("long"))
    rows = rows.select("record_id", "type", "refers_to", "page_id", "payload_bytes", "payload_sha1", "target_uri")
    rows = written(captures.sparkSession, rows, "warc-captures")  # else the archives are read for each side of the join
    to = rows.where(F.col("type") == "response").select(F.col("record_id").alias("to_id"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_sha1").alias("to_sha1"))
    return rows.join(to, rows.refers_to == to.to_id, "left")
