"""Legacy archive converter: ARC files of versions 1 and 2 to WARC files, and readers of both.

ARC: each archive opens with a `filedesc:` block whose last line names the fields of every later header line; version 1
has five, version 2 ten. A record is a header line, as many bytes as its last field declares, and a line feed. The
converter reads them by declared length (never by looking for separators), and makes WARC identifiers (name-based UUIDs),
dates, types and digests from what they hold. Equal payloads of at least `least` bytes are written once: the record with
the largest key is the response, the others become revisits.

Archives are written and read by Spark's own writers and readers, so that any store that Spark reaches will do, a failed
task leaves nothing behind, and a lost executor's work is done again. Archives hold a bounded number of bytes and records.

What cannot be read is told, not raised: a header line without its fields, a length that is no number or runs past the end
makes a record of kind `bad` with the archive, the byte where it starts and the reason as its url, and ends that archive (there
is no telling where its next record begins); the other archives are read on. `write_warc` leaves bad records out, and
`read_warc` gives a row of kind `bad` likewise. Keys travel in an HTTP header of their own name; one that is no number of 18
digits is no key. `intact` says of a record that its payload's digest is that of its header.

Defined cases: a null payload is empty; a null url is `urn:none`; blanks in urls are percent-encoded; a null key is kept
as null, and is never the response if an equal payload has a key; records with equal key and payload are of one type.
An empty table gives empty results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path

#: The field lines of the two versions of the ARC format, and the WARC names.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Of these, those without which a record can't be converted; the length is the last of a line.
NEEDED = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

RECORD = "archive string, version int, kind string, record_id string, url string, ip string, ts string, mime string, key long, head binary, payload binary, payload_bytes long, digest string, sha1 string"
READ = "kind string, record_id string, refers_to_id string, url string, ts string, key long, refers_to_key long, payload_bytes long, digest string, payload binary, intact boolean"
BATCH_BYTES = 4 << 20
#: Level 3 takes two fifths of the default's time for a twentieth more bytes.
GZIP = {"compression": "gzip", "zlib.compress.level": "THREE"}
#: Headers of our own: the key that a payload came with, and those of a revisit.
KEY = "X-Quarry-Key"


def arc_builder(archive_bytes: int, archive_records: int):
    """For mapInPandas over (key, url, ip, ts14, mime, payload): one row for each archive, its text without the last line feed."""

    def archive(records: list[tuple], number: int) -> str:
        version = 1 + number % 2
        about = f"{version} 0 quarry\n{ARC_FIELDS[version]}\n"
        extra = "" if version == 1 else " 200 - - 0 quarry.arc"
        out = [f"filedesc://quarry-{number}.arc 0.0.0.0 {records[0][2]} text/plain{extra} {len(about)}\n{about}\n"]
        at = len(out[0])
        for url, ip, ts, mime, body, n in records:
            extra = "" if version == 1 else f" 200 - - {at} quarry-{number}.arc"
            out.append(f"{url} {ip} {ts} {mime}{extra} {n}\n{body}\n")
            at += len(out[-1]) + n - len(body)
        return "".join(out)[:-1]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = number = 0
        for batch in batches:
            for key, url, ip, ts, mime, payload in batch.itertuples(index=False, name=None):
                payload = payload if isinstance(payload, str) else ""
                url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if isinstance(url, str) and url else "urn:none"
                n = len(payload.encode("utf-8", "surrogatepass"))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}; charset=utf-8\r\nContent-Length: {n}\r\n{KEY}: {key or ''}\r\n\r\n"
                held.append((url, ip, ts, mime, head + payload, len(head) + n))
                size += n
                if size >= archive_bytes or len(held) >= archive_records:
                    yield pd.DataFrame({"value": [archive(held, number)]})
                    held, size, number = [], 0, number + 1
        if held:
            yield pd.DataFrame({"value": [archive(held, number)]})

    return build


def write_arc(rows: DataFrame, path: str, archive_bytes: int = 8 << 20, archive_records: int = 4096) -> None:
    """rows (key long, url, ip, ts14, mime, payload string) as gzipped ARC files, versions 1 and 2 in turn."""
    rows = rows.select(F.col("key").cast("string"), "url", "ip", "ts14", "mime", "payload")
    rows.mapInPandas(arc_builder(archive_bytes, archive_records), "value string").write.option("maxRecordsPerFile", 1).options(**GZIP).text(path)


def unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def arc_records(data: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """(version, header fields, body) of each record, the version block included, by declared lengths."""
    at, version, names = 0, 1, ARC_FIELDS[1].split()
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line without an end at byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        opening = line.startswith("filedesc:")
        # A version block tells its own field count only inside its body; its line is told apart by the count of blanks.
        own = (ARC_FIELDS[2] if line.count(" ") >= 9 else ARC_FIELDS[1]).split() if opening else names
        parts = line.rsplit(" ", len(own) - 1)
        fields = dict(zip(own, parts, strict=False))
        n = whole(fields.get("Archive-length", "").encode())
        if len(parts) != len(own) or n is None or n < 0:
            raise ValueError(f"ARC header line at byte {at} is malformed")
        body = data[end + 1 : end + 1 + n]
        if len(body) < n:
            raise ValueError(f"ARC record at byte {at} declares {n} bytes, {len(body)} are left")
        if opening:
            lines = body.decode("utf-8", "replace").splitlines()
            told = re.match(r"\s*(\d{1,9})(\s|$)", lines[0]) if lines else None
            if not told or len(lines) < 2 or not set(NEEDED) <= set(lines[1].split()) or lines[1].split()[-1] != NEEDED[-1]:
                raise ValueError(f"ARC version block at byte {at} names no version, or not the fields of its records")
            version, names = int(told[1]), lines[1].split()
        yield version, fields, body
        at = end + 1 + n


def iso(ts14: str) -> str:
    t = re.sub(r"\D", "", ts14).ljust(14, "0")[:14]
    return f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    if not body.startswith(b"HTTP/"):
        return b"", body
    cut = body.find(b"\r\n\r\n")
    return (body, b"") if cut < 0 else (body[: cut + 4], body[cut + 4 :])


def header(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].strip() if m else None


def sha1_of(value: bytes | None) -> str | None:
    """A labelled digest in base 32 as hexadecimal digits; null where it is none."""
    label, _, digits = (value or b"").partition(b":")
    try:
        return base64.b32decode(digits, casefold=True).hex() if label.lower() == b"sha1" and len(digits) == 32 else None
    except ValueError:
        return None


def whole(value: bytes | None) -> int | None:
    return int(value) if value and re.fullmatch(rb"-?\d{1,18}", value) else None


def in_batches(rows: Iterator[tuple], names: list[str], size) -> Iterator[pd.DataFrame]:
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += size(row) + 500
        if held_bytes >= BATCH_BYTES:
            yield pd.DataFrame(held, columns=names, dtype=object)
            held, held_bytes = [], 0
    if held:
        yield pd.DataFrame(held, columns=names, dtype=object)


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the ARC files under path (RECORD), ready to be written as WARC; without payloads, all but their bytes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for name, content in batch.itertuples(index=False, name=None):
                try:
                    for version, f, body in arc_records(unpacked(content)):
                        url, ts = f["URL"], iso(f["Archive-date"])
                        head, payload = split_http(body)
                        kind = "warcinfo" if url.startswith("filedesc:") else "response" if head else "resource"
                        sha = hashlib.sha1(payload)
                        key = whole(header(head, KEY.encode()))
                        ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {f['IP-address']} {ts} {key} {sha.hexdigest()}")
                        yield name, version, kind, f"<urn:uuid:{ident}>", url, f["IP-address"], ts, f["Content-type"], key, head if payloads else b"", payload if payloads else b"", len(payload), sha.hexdigest(), base64.b32encode(sha.digest()).decode()
                except (ValueError, EOFError, OSError, zlib.error) as e:
                    yield name, None, "bad", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {e}')}>", str(e), None, None, None, None, b"", b"", 0, None, None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_batches(rows(batches), names_of(RECORD), lambda r: len(r[10]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, RECORD)


def write_warc(records: DataFrame, path: str, least: int = 1000, file_records: int = 2048, digests: DataFrame | None = None) -> None:
    """records (RECORD) as gzipped WARC files. Of equal payloads of at least `least` bytes one is a response, the others revisit it.

    Which payloads repeat is told from digests (records, or the same without their bytes) and summed before the shuffle (a row
    for each digest and task), so that a payload which a third of all records hold is no hot group there; the join back is
    one that adaptive execution splits where a key is hot.
    """
    records = records.filter("kind <> 'bad'")
    big = (F.col("kind") == "response") & (F.col("payload_bytes") >= least)
    first = F.max(F.when(F.col("key").isNotNull(), F.struct("key", "record_id", "url", "ts"))).alias("first")
    repeated = (records if digests is None else digests).filter(big).groupBy("digest").agg(F.count("*").alias("n"), first)
    repeated = repeated.filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("match"), "first")
    # Small payloads never revisit; a key of their own keeps them from meeting in one task.
    of = records.withColumn("match", F.when(big, F.col("digest")).otherwise(F.concat(F.lit("-"), "record_id")))
    of = of.join(repeated, "match", "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first.key"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    raw = lambda c: F.col(c).cast("string")
    block = F.when(again, raw("head")).otherwise(F.concat(raw("head"), raw("payload")))
    text = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.col("kind"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.col("ts")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("key").isNotNull(), line(KEY, raw("key"))).otherwise(F.lit("")),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", F.col("first.record_id")),
                line("WARC-Refers-To-Target-URI", F.col("first.url")),
                line("WARC-Refers-To-Date", F.col("first.ts")),
                line(f"{KEY}-Refers-To", F.col("first.key").cast("string")),
                line(f"{KEY}-Payload-Length", raw("payload_bytes")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.when(F.col("kind") == "response", F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))),
        line("Content-Length", (F.octet_length("head") + F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))).cast("string")),
        F.lit("\r\n"),
        block,
    )
    of.select(text.alias("value")).write.option("maxRecordsPerFile", file_records).option("lineSep", "\r\n\r\n").options(**GZIP).text(path)


def warc_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        head = data[at : end + 2]
        n = whole(header(head, b"Content-Length"))
        if n is None or n < 0:
            raise ValueError(f"WARC record at byte {at} declares no length")
        block = data[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError(f"WARC record at byte {at} declares {n} bytes, {len(block)} are left")
        yield head, block
        at = end + 4 + n + 4


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the WARC files under path (READ). intact: the payload's digest is that of its header."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        told = lambda v: v.decode("utf-8", "replace") if v else None
        for batch in batches:
            for (content,) in batch.itertuples(index=False, name=None):
                try:
                    for head, block in warc_records(unpacked(content)):
                        kind = told(header(head, b"WARC-Type"))
                        http, payload = split_http(block)
                        said = sha1_of(header(head, b"WARC-Payload-Digest"))
                        if kind == "revisit":
                            n, digest, intact = whole(header(head, f"{KEY}-Payload-Length".encode())), said, said is not None
                        else:
                            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                            intact = digest == said
                        yield kind, told(header(head, b"WARC-Record-ID")), told(header(head, b"WARC-Refers-To")), told(header(head, b"WARC-Target-URI")), told(header(head, b"WARC-Date")), whole(header(head, KEY.encode())), whole(header(head, f"{KEY}-Refers-To".encode())), n, digest, payload if payloads else None, intact
                except (ValueError, EOFError, OSError, zlib.error) as e:
                    yield "bad", None, None, str(e), None, None, None, 0, None, None, False

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_batches(rows(batches), names_of(READ), lambda r: len(r[9] or b""))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, READ)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 1000) -> None:
    """All ARC files under arc_path as WARC files under warc_path."""
    write_warc(read_arc(spark, arc_path), warc_path, least, digests=read_arc(spark, arc_path, payloads=False))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages to ARC files, those to WARC files, and what the WARC files then hold for each page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").cast("long").alias("key"),
        "url",
        F.lit("192.0.2.1").alias("ip"),
        F.date_format(F.timestamp_seconds(F.lit(1_000_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))), "yyyyMMddHHmmss").alias("ts14"),
        F.lit("text/html").alias("mime"),
        F.col("html").alias("payload"),
    )
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return (
        read_warc(spark, warc, payloads=False)
        .filter(F.col("kind").isin("response", "revisit"))
        .select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to_key").alias("refers_to"), "intact")
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN top END AS refers_to, true AS intact
FROM q
"""
