"""Converter from legacy ARC archives to WARC.

An ARC file begins with a version block, whose lines name the fields of every record's header line: five in
version 1, ten in version 2; the last field is the length of what follows. The converter reads headers by the
version at hand and bodies by their declared lengths, and synthesises what WARC asks for: identifiers (name-based
UUIDs), W3C dates, record types and base32 SHA-1 digests. Of records with equal payloads one is a response and the
others are revisits that refer to it; a revisit keeps the HTTP header, hence the payload's length, but no payload.
Archives are written and read by Spark's text and binary file sources, so any file system that Spark knows serves.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, counted_join, discard, lookup, new_path, small_batches, table, written

#: Fixed by the two versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Bytes of records in one ARC archive that pages are packed into.
SEGMENT = 1 << 20
#: The time that pages without one get.
EPOCH = "20240101000000"
END = b"\r\n\r\n"


def arc_url(url: str | None, page_id) -> str:
    """The URL as an ARC header can hold it: one word of printable ASCII."""
    url = url or f"urn:page:{page_id}"
    return re.sub(r"[^\x21-\x7E]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def arc_archive(version: int, name: str, records: list[tuple[str, str, bytes]]) -> bytes:
    """An ARC archive of (URL, content type, network document)."""
    block = f"{version} 0 {name}\n{FIELDS[version]}\n\n".encode()

    def head(url: str, kind: str, n: int, offset: int) -> bytes:
        if version == 1:
            return f"{url} 0.0.0.0 {EPOCH} {kind} {n}\n".encode()
        return f"{url} 0.0.0.0 {EPOCH} {kind} 200 - - {offset} {name} {n}\n".encode()

    out = io.BytesIO()
    out.write(head(f"filedesc://{name}", "text/plain", len(block), 0) + block)
    for url, kind, doc in records:
        out.write(head(url, kind, len(doc), out.tell()) + doc + b"\n")
    return out.getvalue()


def arc_records(data: bytes):
    """(header fields by name, body) of each record of an ARC archive (plain, or gzip in one or many members), without the version block. ValueError where a header doesn't have its version's fields, or less than a declared length follows."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, fields, first = 0, None, True
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)]
        if not line.strip():
            at = len(data) if end < 0 else end + 1
            continue
        words = line.decode("latin-1").rstrip("\r").split(" ")
        if not words[-1].isdigit() or end < 0:
            raise ValueError(f"no ARC header at {at}")
        body = data[end + 1 : end + 1 + int(words[-1])]
        if len(body) < int(words[-1]):
            raise ValueError(f"ARC record at {at} ends early")
        at = end + 1 + len(body)
        if first:
            lines = body.decode("latin-1").split("\n")
            version = int(lines[0].split(" ")[0])
            if not words[0].startswith("filedesc://") or version not in FIELDS or lines[1].rstrip("\r") != FIELDS[version]:
                raise ValueError("no ARC version block")
            fields, first = FIELDS[version].split(" "), False
            continue
        if len(words) != len(fields):
            raise ValueError(f"an ARC header of {len(words)} fields where the version has {len(fields)}")
        yield dict(zip(fields, words, strict=True)), body


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its empty line, and the payload."""
    at = body.find(END)
    return (body[: at + 4], body[at + 4 :]) if body.startswith(b"HTTP/") and at >= 0 else (b"", body)


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def w3c_date(arc_date: str) -> str:
    d = (arc_date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_field(header: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", header)
    return m[1].decode("latin-1") if m else None


def record_id(url: str, date: str, page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page_id} {digest}')}>"


def pages_to_arcs(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """archive: ARC archives of the rows of pages (page_id, url, html), of versions 1 and 2 in turn. A null html is an empty payload."""
    small_batches(pages.sparkSession)

    def pack(batches):
        version, name, held, size = 1, 0, [], 0
        for b in batches:
            for page_id, url, html in zip(b["page_id"], b["url"], b["html"], strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                own = "" if pd.isna(page_id) else f"X-Page-Id: {int(page_id)}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
                held.append((arc_url(url, page_id), "text/html", head + payload))
                size += len(payload) + len(head)
                if size >= segment:
                    yield pd.DataFrame({"archive": [arc_archive(version, f"pages-{name}.arc", held)]})
                    version, name, held, size = 3 - version, name + 1, [], 0
        if held:
            yield pd.DataFrame({"archive": [arc_archive(version, f"pages-{name}.arc", held)]})

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(pack, "archive binary")


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """archive of each ARC file under path."""
    small_batches(spark)
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive"))


RECORD = "page_id long, url string, ip string, date string, record_id string, http binary, payload binary, payload_bytes long, payload_digest string"


def convert(arcs: DataFrame) -> DataFrame:
    """One row a record of the archives (column archive), with the identifiers and digests that WARC has."""

    def run(batches):
        for b in batches:
            rows = []
            for data in b["archive"]:
                for head, body in arc_records(data):
                    http, payload = split_http(body)
                    own = http_field(http, "X-Page-Id")
                    page_id = int(own) if own else None
                    date, digest = w3c_date(head["Archive-date"]), sha1_32(payload)
                    rows.append((page_id, head["URL"], head["IP-address"], date, record_id(head["URL"], date, page_id, digest), http, payload, len(payload), digest))
                    if len(rows) == 200:
                        yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"page_id": "Int64"})
                        rows = []
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"page_id": "Int64"})

    return arcs.mapInPandas(run, RECORD)


def revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record_id, refers_record of the records that revisit another: of those with equal payloads (digest and length) of at least least_bytes bytes, all but that with the largest page_id (of equal ones, the largest identifier)."""
    small = records.where(F.col("payload_bytes") >= least_bytes).select("page_id", "record_id", "payload_digest", "payload_bytes")
    small = written(small, "warc-index")
    chosen = written(small.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "record_id")).alias("last"), F.count("*").alias("n")).where("n > 1"), "warc-chosen")
    # empty pages may be many
    pairs = counted_join(small, chosen, ["payload_digest", "payload_bytes"], "n").where(F.col("record_id") != F.col("last.record_id"))
    return written(pairs.select("record_id", F.col("last.record_id").alias("refers_record")).distinct(), "warc-revisits")


def warc_head(kind: str, rid: str, date: str, fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + END


def write_warcs(records: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes the records as gzip-compressed WARC files under path, each beginning with a warcinfo record; a file for each partition of the records, which are written down first, so that archives are converted once."""
    records = written(records, "warc-records")
    refs = revisits(records, least_bytes)
    if refs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        refs = F.broadcast(refs)
    typed = records.join(refs, "record_id", "left")

    def block(batches):
        info = b"software: spanloom\r\nformat: WARC File Format 1.1\r\n"
        first = True
        for b in batches:
            out = []
            if first:
                out.append(warc_head("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'spanloom')}>", w3c_date(EPOCH), [("Content-Type", "application/warc-fields")], len(info)) + info)
                first = False
            for r in b.itertuples(index=False):
                own = [("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", f"sha1:{r.payload_digest}"), ("Content-Type", "application/http; msgtype=response")]
                if r.refers_record is None:
                    body = r.http + r.payload
                    out.append(warc_head("response", r.record_id, r.date, [*own, ("WARC-Block-Digest", f"sha1:{sha1_32(body)}")], len(body)) + body)
                else:
                    more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", r.refers_record)]
                    out.append(warc_head("revisit", r.record_id, r.date, [*own, *more], len(r.http)) + r.http)
            yield pd.DataFrame({"record": out})

    rows = typed.mapInPandas(block, "record binary")
    # the end of a record, two line ends, is the writer's separator of rows
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)
    discard(records)


def warc_records(chunks):
    """(fields by lower-case name, block) of each record of a WARC file, given in chunks of bytes; holds a record at a time."""
    held = bytearray()
    chunks = iter(chunks)

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while (end := held.find(END)) < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("a WARC header ends early")
                return
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC header: {lines[0][:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        if not fill(end + 4 + n + 4) or held[end + 4 + n : end + 8 + n] != END:
            raise ValueError("a WARC record ends early")
        yield fields, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 8 + n]


def inflated(data: bytes, step: int = 1 << 20):
    """data in chunks, decompressed if it is gzip of one or many members."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    rest = memoryview(data)
    while len(rest):
        undo = zlib.decompressobj(31)
        while len(rest) and not undo.eof:
            out = undo.decompress(rest[:step])
            rest = rest[step:] if not undo.unused_data else rest[min(step, len(rest)) - len(undo.unused_data) :]
            if out:
                yield out


READ = "page_id long, url string, record_id string, record_type string, refers_record string, payload_bytes long, payload_digest string, intact boolean"


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response and revisit record of the archives under path. A revisit's payload_bytes is the Content-Length of the HTTP header it keeps; intact says that a response's payload has the digest it declares."""
    small_batches(spark)

    def run(batches):
        names = [x.split()[0] for x in READ.split(", ")]
        for b in batches:
            rows = []
            for data in b["content"]:
                for f, block in warc_records(inflated(data)):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    http, payload = split_http(block)
                    own = http_field(http, "X-Page-Id")
                    declared = f["warc-payload-digest"].removeprefix("sha1:")
                    whole = f["warc-type"] == "response"
                    length = len(payload) if whole else int(http_field(http, "Content-Length") or 0)
                    rows.append((int(own) if own else None, f["warc-target-uri"], f["warc-record-id"], f["warc-type"], f.get("warc-refers-to"), length, declared, not whole or sha1_32(payload) == declared))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})
                        rows = []
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInPandas(run, READ)


def archived(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact of each row of pages (page_id, url, html), by way of ARC archives, their conversion to WARC archives under path, and reading those.

    Null html and empty html are empty payloads, which are equal to each other. Rows equal in page_id, url and html
    have one identifier and so one type. A null page_id ranks below all others and is read back as null. URLs are
    percent-encoded where an archive's header could not hold them; null ones become urn:page:<page_id>. Other
    columns are ignored; an empty table gives an empty result.
    """
    write_warcs(convert(pages_to_arcs(pages)), path, least_bytes)
    found = written(read_warcs(pages.sparkSession, path), "warc-read")
    heads = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to")).distinct()
    again = found.where("record_type = 'revisit'")
    # of the responses those that are referred to
    heads = written(heads.join(again.select("refers_record").distinct(), "refers_record", "left_semi"), "warc-heads")
    back = lookup(again, heads, "refers_record", "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact"]
    return found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(cols).unionByName(back.select(cols))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"), new_path(spark, "warc")).drop("url")


OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
s AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, from_hex(sha1(html))::BIT::VARCHAR AS bits, last FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: substr(bits, (i * 5 + j)::INT, 1)::INT * (32 >> j)))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to, true AS intact
FROM s
"""
