"""WARC archives: writing captures, reading records back, and assembling transactions.

Each page becomes three records: a request, a response (or a revisit, if another page with the same payload is the response), and a metadata record; request and metadata name the response or revisit in WARC-Concurrent-To. Each record is a gzip member, so that it can be read alone, and an archive is closed when it has FILE_BYTES. Spark's text writer puts the bytes in place and its binaryFile reader brings them back, so archives can be in any store that Spark reaches and a lost task leaves none of its files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, new_path, stage

END, FILE_BYTES = b"\r\n\r\n", 16 << 20
DATE = "2024-01-01T00:00:00Z"


def _record(kind: str, record_id: str, uri: str, body: bytes, content_type: str, *more: tuple[str, str]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *more, ("Content-Type", content_type), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + END


def _member(record: bytes) -> bytes:
    """A gzip member. Its window isn't larger than the record asks for, as a small one is set up sooner."""
    import zlib

    c = zlib.compressobj(6, zlib.DEFLATED, 16 + min(15, max(9, len(record).bit_length())), 8 if len(record) > 4096 else 5)
    return c.compress(record) + c.flush()


def _uri(url: str | None) -> str:
    from urllib.parse import quote

    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url or "about:blank")


def capture_records(page_id: int | None, url: str | None, html: str | None, sha1: str, owner: int | None) -> list[bytes]:
    """The three records of a page; owner: the page_id whose response this one's payload is."""
    import base64

    uri, payload = _uri(url), (html or "").encode()
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    urn = lambda kind, page: f"urn:page:{'null' if page is None else page}:{sha1}:{kind}"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    main = urn("response", page_id)
    about = ("WARC-Payload-Digest", digest)
    if owner == page_id:
        capture = _record("response", main, uri, head + payload, "application/http; msgtype=response", about)
    else:
        main = urn("revisit", page_id)
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        capture = _record("revisit", main, uri, head, "application/http; msgtype=response", about, profile, ("WARC-Refers-To", f"<{urn('response', owner)}>"))
    path = re.sub(r"^[a-z+.-]+://[^/?#]*", "", uri, flags=re.I) or "/"
    request = _record("request", urn("request", page_id), uri, f"GET {path} HTTP/1.1\r\n\r\n".encode(), "application/http; msgtype=request", ("WARC-Concurrent-To", f"<{main}>"))
    fields = f"page-id: {'' if page_id is None else page_id}\r\npayload-length: {len(payload)}\r\n".encode()
    return [request, capture, _record("metadata", urn("metadata", page_id), uri, fields, "application/warc-fields", ("WARC-Concurrent-To", f"<{main}>"))]


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """pages: page_id (integer), url, html; a null html is an empty payload, a null url about:blank.

    Of pages whose payloads are equal and have at least min_bytes bytes, that with the largest page_id (null is the smallest) is the response, and the others revisit it; smaller payloads are responses each. Rows that repeat the response's page_id and payload are responses too. The largest page_id of each payload that repeats is found first, partially aggregated, so a payload of a third of all pages is a row a task; only those payloads' pages are looked up. An empty table writes no record.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"))
    long = F.octet_length("html") >= min_bytes
    owners = rows.filter(long).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("owner")).filter("n > 1").select("sha1", F.struct("owner").alias("found"))
    owners = stage(owners, "owners")
    rows = rows.join(owners, "sha1", "left").withColumn("owner", F.when(F.col("found").isNotNull() & long, F.col("found.owner")).otherwise(F.col("page_id")))

    def run(batches):
        file = bytearray()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([bytes(file[:-1])], pa.binary())], ["value"])
        for b in batches:
            for k in range(0, b.num_rows, 256):
                for row in zip(*[c.to_pylist() for c in b.slice(k, 256).columns], strict=True):
                    for record in capture_records(*row):
                        file += _member(record)
                    if file[-1]:  # the writer ends a file with the byte 0, which is the last of a record shorter than 16 MiB, and of an empty member
                        file += _member(b"")
                    if len(file) >= file_bytes:
                        yield done()
                        file.clear()
        if file:
            yield done()

    text = rows.select("page_id", "url", "html", "sha1", "owner").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    text.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _inflated(data) -> Iterator[memoryview | bytes]:
    """The bytes of an archive in pieces, whatever the number of its gzip members; of one that isn't compressed, in one piece."""
    import zlib

    view, at = memoryview(data).cast("B"), 0
    if view[:2] != b"\x1f\x8b":
        yield view
        return
    while at < len(view):
        if view[at : at + 2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        d, step = zlib.decompressobj(31), 4096
        while not d.eof:
            fed = view[at : at + step]
            if not fed:
                raise ValueError("the last member is cut short")
            yield d.decompress(fed)
            at += len(fed) - len(d.unused_data)
            step = min(4 * step, 1 << 20)


def parse(data) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """(headers, block) of each record of an archive, gzip or not, members in any number. headers: the values, in order, of each lower-case name. Not more than a record and a piece of the archive are held inflated."""
    buffer, at, pieces, passed = bytearray(), 0, _inflated(data), 0

    def more(n: int) -> bool:
        """Reads until n bytes after `at` are there; whether they are."""
        nonlocal buffer, at, passed
        while len(buffer) - at < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            if at:
                buffer = buffer[at:]  # a new one, as blocks given out may still be in use
                passed, at = passed + at, 0
            buffer = buffer + piece
        return True

    while more(1):
        if buffer[at] in b"\r\n":
            at += 1
            continue
        size = 512
        while (end := buffer.find(END, at)) < 0:
            if not more(size):
                raise ValueError(f"no record at byte {passed + at}")
            size = len(buffer) - at + 1
        first, _, rest = bytes(buffer[at:end]).partition(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {passed + at}")
        headers: dict[str, list[str]] = {}
        name = ""
        for line in rest.decode("utf-8", "replace").split("\r\n"):
            if line[:1] in (" ", "\t") and name:
                headers[name][-1] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                headers.setdefault(name, []).append(value.strip())
        n = end + len(END) - at + int(headers["content-length"][0])
        if not more(n):
            raise ValueError("the last record is cut short")
        yield headers, memoryview(buffer)[at + n - int(headers["content-length"][0]) : at + n]
        at += n


RECORDS = "record_type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, fields string, payload binary"


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record. payload is the HTTP body of a response (null unless asked for), payload_digest the base32 SHA-1 of that body for a response and what the header says for others; fields is the text of a metadata record."""
    import pyarrow as pa

    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.list_(pa.string()) if n == "concurrent_to" else pa.string() for n in names]

    def row(headers: dict[str, list[str]], block: memoryview):
        import base64
        import hashlib

        first = lambda name: headers.get(name, [""])[0]
        kind, digest, size, fields, body = first("warc-type"), first("warc-payload-digest").removeprefix("sha1:") or None, None, None, None
        if kind == "response":
            cut = bytes(block[:65536]).find(END) if first("content-type").startswith("application/http") else -4
            body = block[cut + 4 :]
            digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
        elif kind == "metadata":
            fields = bytes(block).decode("utf-8", "replace")
        bare = lambda name: first(name).strip("<>") or None
        return kind, bare("warc-record-id"), [x.strip("<>") for x in headers.get("warc-concurrent-to", [])], bare("warc-refers-to"), first("warc-target-uri") or None, first("warc-date") or None, digest, size, fields, bytes(body) if payloads and body is not None else None

    def run(batches):
        for b in batches:
            for c in b.column(0):
                rows, size = [], 0
                for headers, block in parse(c.as_buffer()):
                    rows.append(row(headers, block))
                    size += len(rows[-1][-1] or b"")
                    if len(rows) == 4096 or size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).filter("length > 0").select("content").mapInArrow(run, RECORDS)


MAIN = ("response", "revisit", "resource")


def _capture_keys(records: DataFrame) -> DataFrame:
    """records (record_id, concurrent_to, main) with capture_id, the same for all records that concurrent-to identifiers connect, in either direction and over any number of steps."""
    key = F.when(F.col("main"), F.col("record_id")).otherwise(F.coalesce(F.get("concurrent_to", 0), "record_id"))
    keyed = records.withColumn("key", key)
    # The common case is over here: requests and metadata name their response, and it names nothing. What else is named, or is itself a record under another key, ties two keys together.
    refs = keyed.select("key", F.explode(F.array_distinct(F.concat(F.col("concurrent_to"), F.array("key")))).alias("ref"))
    own = keyed.filter("record_id <> key").select(F.col("record_id").alias("ref"), F.col("key").alias("other"))
    ties = refs.distinct().join(own, "ref").select(F.col("key").alias("u"), F.col("other").alias("v")).unionByName(refs.select(F.col("key").alias("u"), F.col("ref").alias("v")))
    ties = stage(ties.filter("u <> v").distinct(), "ties")
    if ties.isEmpty():
        return keyed.withColumnRenamed("key", "capture_id")
    root = components(ties).select(F.col("u").alias("key"), F.col("v").alias("root"))
    return keyed.join(root, "key", "left").withColumn("capture_id", F.coalesce("root", "key")).drop("key", "root")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, capture (the response, revisit or resource, a struct of the record's columns, null if there is none), requests, metadata and others (arrays of such structs by record_id, each record once), n_requests, n_metadata (rows, repeats included).

    Records belong together if WARC-Concurrent-To, which may repeat, connects them: a request that names its response, a response that names its request, or metadata that names either. capture_id is the response's identifier, or that which the first of its records names; where identifiers connect more than that, the least of those. Responses that share a capture give a row each, with the same requests and metadata; those that repeat an identifier do so too. Requests and metadata of a response that isn't there give a row without one. Records without an identifier stand for themselves, each kind in one row; warcinfo records are no part of a capture and left out. Extra columns are dropped.

    Responses meet the others' aggregate in a join, so no group has more than the distinct other records of one capture.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    rows = records.select(*names).filter("record_type <> 'warcinfo'")
    rows = rows.withColumn("main", F.col("record_type").isin(*MAIN)).withColumn("record_id", F.coalesce("record_id", F.lit(""))).withColumn("concurrent_to", F.coalesce("concurrent_to", F.array().cast("array<string>")))
    rows = _capture_keys(rows)
    whole = F.struct(*names)
    kinds = {"requests": F.col("record_type") == "request", "metadata": F.col("record_type") == "metadata", "others": ~F.col("record_type").isin("request", "metadata")}
    gathered = [F.array_sort(F.collect_set(F.when(c, F.struct("record_id", *[n for n in names if n != "record_id"])))).alias(k) for k, c in kinds.items()]
    beside = rows.filter(~F.col("main")).groupBy("capture_id").agg(*gathered, *[F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()])
    out = rows.filter("main").select("capture_id", whole.alias("capture")).join(beside, "capture_id", "full_outer")
    none = lambda k: F.coalesce(k, F.array().cast(beside.schema[k].dataType))
    return out.select("capture_id", "capture", *[none(k).alias(k) for k in kinds], *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in ("requests", "metadata")])


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = assemble(stage(read_records(spark, path, payloads=False), "records"))
    fields = F.get("metadata", 0)["fields"]
    said = lambda name: F.regexp_extract(fields, rf"(?m)^{name}: ([0-9-]+)", 1).try_cast("long")
    return captures.select(
        said("page-id").alias("page_id"),
        F.coalesce("capture.payload_bytes", said("payload-length")).alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.regexp_extract("capture.refers_to", "^urn:page:([0-9-]+):", 1).try_cast("long").alias("refers_to"),
    )


_DIGIT = "CAST('0x' || substr(sha1(h) || '00', CAST(5 * i // 4 + 1 AS BIGINT), 3) AS INTEGER)"
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, h,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_DIGIT} >> CAST(7 - (5 * i) % 4 AS INTEGER)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest FROM p),
o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d JOIN o USING (h)"""
