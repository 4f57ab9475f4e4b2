"""WARC archives: written from pages, read back, and assembled into one nested row for each capture.

A capture is a response (or a revisit of an equal payload's response, or a resource) with the request and metadata records of the same
transaction, which name it in WARC-Concurrent-To, are named by it, or are so tied to another record of it. Spark's own writer
and reader move the bytes, so any file system that Spark knows will do, and a task that is run again leaves no second copy.
Records are split by Content-Length, never by searching for a marker that a payload could hold. Files compressed by gzip are
read as a stream, so a task holds one record at a time, however large a file is; plain ones are read whole (2 GB at most).

Cases: null html is an empty payload, null url an empty target; a null page_id has captures without an id that never
serve as a response for other pages while the group has an id; rows that repeat a page's id, url and html make equal captures, and
each comes back, sharing their requests and metadata; an empty table writes no record; columns of pages other than page_id, url
and html are not read. A very large payload passes through as one value. Of other archives: a record that ends early, lacks a
Content-Length, has another payload than its digest says or isn't a record comes back with a problem instead of an error, and
reading goes on at the next record; headers that aren't UTF-8 are read as Latin-1; digests may be SHA-1 in hex or base32, those
of other algorithms are kept as they are; a header may repeat; request and metadata records without a capture are `loose`.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_count, read, scratch, shared_path, written
from .jaccard_join import least_reachable

#: Payloads of fewer bytes are stored each time.
LEAST_REVISITED = 1000
#: Records in a file. A compressed file is read by one task.
RECORDS_A_FILE = 1500
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

HEADS = ("response", "revisit", "resource")
PAIRS = "array<struct<name:string,value:string>>"
RECORD = f"kind string, record_id string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes long, headers {PAIRS}, block string, payload binary, problem string"


def record_id(page_id: Column, url: Column, digest: Column, kind: str) -> Column:
    """A URN of the page_id, the kind of record, and a hash of the content."""
    h = F.substring(F.md5(F.concat_ws("\n", F.coalesce(url, F.lit("")), digest)), 1, 16)
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(f":{kind}:"), h, F.lit(">"))


def page_of(urn: Column) -> Column:
    """The page_id in such a record id; null for any other one."""
    return F.regexp_extract(urn, r"^<urn:x-page:(-?\d+):", 1).try_cast("long")


def planned(pages: DataFrame) -> DataFrame:
    """pages with digest, bytes, its own record id and, for a revisit, that of the response it refers to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", F.sha1(html.cast("binary")).alias("_digest"), F.octet_length(html).cast("long").alias("_bytes"))
    groups = keyed.where(F.col("_bytes") >= LEAST_REVISITED).groupBy("_digest").agg(F.count("*").alias("_n"), F.max(F.struct("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"))).alias("_top"))
    groups = groups.where("_n > 1")
    own = pages.select("page_id", "url", html.alias("html")).withColumns({"_digest": F.sha1(F.col("html").cast("binary")), "_bytes": F.octet_length("html").cast("long")})
    out = join_by_count(own, groups, "_digest", "_n")
    out = out.withColumns({"_id": record_id(F.col("page_id"), F.col("url"), F.col("_digest"), "response"), "_to": record_id(F.col("_top.page_id"), F.col("_top.url"), F.col("_digest"), "response")})
    return out.withColumn("_revisits", F.coalesce(~F.col("page_id").eqNullSafe(F.col("_top.page_id")), F.lit(False)) & F.col("_top").isNotNull())


def head(kind: str, *fields: tuple[str, Column | str]) -> Column:
    out = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n")]
    for name, value in fields:
        value = F.lit(value) if isinstance(value, str) else value
        out.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*out, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str) -> None:
    """WARC files under path, compressed by gzip, with three records for each row of pages."""
    p = planned(pages)
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ")
    sized = lambda body: F.octet_length(body).cast("string")
    body = F.when(F.col("_revisits"), "").otherwise(F.col("html"))
    length = (F.lit(len(HTTP)) + F.when(F.col("_revisits"), 0).otherwise(F.col("_bytes"))).cast("string")
    asked = F.concat(F.lit("GET "), F.when(url == "", "/").otherwise(F.regexp_replace(url, r"\s", "%20")), F.lit(" HTTP/1.1\r\n\r\n"))
    noted = F.concat(F.lit("payload-bytes: "), F.col("_bytes").cast("string"), F.lit("\r\n"))
    digest = F.concat(F.lit("sha1:"), F.col("_digest"))
    common = [("WARC-Record-ID", F.col("_id")), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", length)]
    revisit = head("revisit", ("WARC-Refers-To", F.col("_to")), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common)
    # Each text is put together once, a page's html copied once. A record ends with two CRLF, of which Spark's writer sets the second.
    end = F.lit("\r\n")
    capture = F.concat(F.when(F.col("_revisits"), revisit).otherwise(head("response", *common)), F.lit(HTTP), body, end)
    request = F.concat(head("request", ("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("_digest"), "request")), ("WARC-Concurrent-To", F.col("_id")), ("WARC-Target-URI", url), ("Content-Type", "application/http;msgtype=request"), ("Content-Length", sized(asked))), asked, end)
    metadata = F.concat(head("metadata", ("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("_digest"), "metadata")), ("WARC-Concurrent-To", F.col("_id")), ("Content-Type", "application/warc-fields"), ("Content-Length", sized(noted))), noted, end)
    rows = p.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    rows.write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_A_FILE).option("compression", "gzip").text(path)


def records(lines: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes, str | None]]:
    """Header fields, block and problem of each record in the lines of an archive, which end with CRLF but come without it."""
    for line in lines:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            skipped = len(line)
            for line in lines:
                if line.startswith(b"WARC/"):
                    break
                skipped += len(line) + 2
            yield [], b"", f"{skipped} bytes are no record"
            if not line.startswith(b"WARC/"):
                return
        fields, ended = [], False
        for x in lines:
            if not x:
                ended = True
                break
            try:
                x = x.decode()
            except UnicodeDecodeError:
                x = x.decode("latin-1")
            name, colon, value = x.partition(":")
            if x[0] in " \t" and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {x.strip()}")
            elif colon:
                fields.append((name.strip(), value.strip()))
        length = next((v for n, v in fields if n.lower() == "content-length"), None)
        if not ended or length is None or not length.isdigit():
            yield fields, b"", "no Content-Length" if ended else "ends early"
            continue
        length, parts, got = int(length), [], 0
        while got < length and (x := next(lines, None)) is not None:
            parts += (x, b"\r\n")
            got += len(x) + 2
        block = b"".join(parts)
        yield fields, block[:length], "ends early" if got < length else "goes on after its Content-Length" if got - length not in (0, 2) or block[length:] not in (b"", b"\r\n") else None


def sha1_hex(digest: str) -> str:
    """Lower-case hex of a SHA-1 given in hex or base32, with or without the algorithm's name; others as they are."""
    name, _, value = digest.rpartition(":")
    if name.lower() in ("", "sha1", "sha-1"):
        if re.fullmatch(r"[0-9a-fA-F]{40}", value):
            return value.lower()
        if re.fullmatch(r"[A-Za-z2-7]{32}", value):
            return base64.b32decode(value.upper()).hex()
    return digest


def row_of(fields: list[tuple[str, str]], block: bytes, problem: str | None, keep_payload: bool) -> dict:
    of = {}
    for name, value in fields:
        of.setdefault(name.lower(), []).append(value)
    one = lambda name: of.get(name, [None])[0]
    kind = (one("warc-type") or "").lower() or None
    out = {"kind": kind, "record_id": one("warc-record-id"), "target_uri": one("warc-target-uri"), "concurrent_to": of.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "headers": [{"name": n, "value": v} for n, v in fields], "problem": problem}
    digest = sha1_hex(one("warc-payload-digest") or "")
    if kind in HEADS:
        http = (one("content-type") or "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        if kind != "revisit":
            own = hashlib.sha1(payload).hexdigest()
            if not problem and len(digest) == 40 and digest != own:
                out["problem"] = "the payload doesn't have its digest"
            digest = digest or own
            out |= {"payload_bytes": len(payload), "payload": payload if keep_payload else None}
    elif kind in ("request", "metadata"):
        out["block"] = block.decode("utf-8", "replace")
    return out | {"payload_digest": digest or None}


SCHEMA = pa.schema([
    *((x, pa.string()) for x in ("kind", "record_id", "target_uri")), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.string()), ("payload", pa.binary()), ("problem", pa.string()),
])


def parsed(keep_payload: bool, whole_files: bool):
    """From batches of (file, a line or all bytes) to rows of RECORD."""

    def run(batches):
        pairs = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        rows, size = [], 0
        for _, own in groupby(pairs, lambda x: x[0]):
            lines = (line for _, x in own for line in (x.split(b"\r\n") if whole_files else (x,)))
            for fields, block, problem in records(lines):
                rows.append(row_of(fields, block, problem, keep_payload))
                size += len(block) + 400
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return run


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each record of the archives under path (names end with .gz, or not if they are plain)."""
    lines = spark.read.option("lineSep", "\r\n").option("pathGlobFilter", "*.gz").text(path).select("_metadata.file_path", F.col("value").cast("binary"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select("path", "content")
    return lines.mapInArrow(parsed(payload, False), RECORD).unionByName(plain.mapInArrow(parsed(payload, True), RECORD))


def tied(found: DataFrame) -> DataFrame:
    """(head, kind, record) of each request and metadata record and each capture that it belongs to.

    Requests and metadata that name each other, in either direction and over any number of steps, belong together, to every capture that
    one of them names or that names one of them. A capture doesn't tie those together that it is named by.
    """
    record = F.struct("record_id", "headers", "block").alias("record")
    others = found.where("kind IN ('request', 'metadata')")
    heads = found.where(F.col("kind").isin(*HEADS))
    names = others.select("record_id", F.explode("concurrent_to").alias("to"))
    named = heads.where(F.size("concurrent_to") > 0).select(F.col("record_id").alias("head"), F.explode("concurrent_to").alias("record_id")).select("record_id", "head")
    links = names.join(others.select(F.col("record_id").alias("to")).distinct(), "to").select(F.col("record_id").alias("a"), F.col("to").alias("b"))
    groups = least_reachable(links)
    direct = names.select("record_id", F.col("to").alias("head")).unionByName(named)
    of_group = direct.join(groups.withColumnRenamed("id", "record_id"), "record_id").select("label", "head").distinct()
    far = groups.join(of_group, "label").select(F.col("id").alias("record_id"), "head")
    more = written(named.unionByName(far).distinct(), "ties")
    out = others.select(F.explode("concurrent_to").alias("head"), "kind", record)
    if more.isEmpty():  # most archives: their records are not moved for it
        return out
    return out.unionByName(others.select("record_id", "kind", record).join(more, "record_id").select("head", "kind", "record"))


def assemble(found: DataFrame) -> DataFrame:
    """One row for each capture: its record's columns, and its request and metadata records, each an array of (record_id, headers, block)."""
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("record")))
    others = tied(found).groupBy("head").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    heads = found.where(F.col("kind").isin(*HEADS)).drop("concurrent_to", "block")
    out = heads.join(others.withColumnRenamed("head", "record_id"), "record_id", "left")
    none = F.array().cast("array<struct<record_id:string,headers:" + PAIRS + ",block:string>>")
    noted = F.regexp_extract(F.array_join(F.transform("metadata", lambda m: m["block"]), "\n"), r"(?m)^payload-bytes: (\d+)", 1).try_cast("long")
    return out.withColumns({"payload_bytes": F.coalesce("payload_bytes", noted), "requests": F.coalesce("requests", none), "metadata": F.coalesce("metadata", none)})


def loose(found: DataFrame) -> DataFrame:
    """Request and metadata records that belong to no capture."""
    heads = found.where(F.col("kind").isin(*HEADS)).select(F.col("record_id").alias("head")).distinct()
    at_home = tied(found).join(heads, "head").select("record.record_id").distinct()
    return found.where("kind IN ('request', 'metadata')").join(at_home, "record_id", "left_anti")


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        path = shared_path(spark, "warc")
        write_archives(read(spark, sf_dir, "pages"), path)
        found = keep(written(read_archives(spark, path, payload=False), "records"))
    return assemble(found).select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
t AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM t
"""
