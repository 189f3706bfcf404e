"""Legacy archive converter: ARC records to WARC records, and WARC archives written and read back.

An ARC file begins with a version block (`filedesc:`) that names the version and the fields of all header lines: version
1 has url, address, date, type and length, version 2 adds result code, checksum, location, offset and file name. A header
line is cut from its end, as a url may hold blanks, and its declared length says where the next record begins. From each
record the converter makes a WARC record: an identifier that depends on url, date and block only, the date in ISO form,
the type that the ARC content means (response, resource or warcinfo), and SHA-1 digests of block and payload.

Archiving tables: rows become the records of ARC files (a version block and HTTP responses), which are read and converted as
any others. Records of equal payloads of at least `min_revisit` bytes keep one response, that with the largest key; the
others become revisit records without payload that refer to it. Which those are comes from a written table of digests,
lengths and keys. Of payloads only those that others repeat are sent through a shuffle: a Bloom filter of repeated
digests passes by all others, which are archived where they are, and a revisit needs its digests only. Equal digests are
a hot key where many pages are equal; they are merged to one row in each task, and rows join that split.
Archives begin with a warcinfo record and are files of about ARCHIVE bytes (or one record), each record a gzip member of its
own, in a folder that Spark writes and reads.

Defined results for odd input: null html is an empty payload; a null url is archived as `urn:unknown`, and white space and
control characters in urls are percent-encoded; very long payloads are a record, and an archive, of their own; rows that repeat the largest key of equal payloads are responses all; null
keys are kept, never referred to, and revisit a record whose key is not null (response if there is none); an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.bloom import suspected
from veritrail.llm.common import new_path, small_batches, written
from veritrail.llm.components import joined

ARCHIVE = 8 << 20
PAGE_ADDRESS = "192.0.2.1"
MIN_REVISIT = 1000
#: Field names of header lines by version. Fixed values of the format.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
END = b"\r\n\r\n"


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def payload(self) -> bytes:
        """The block, without the HTTP header if it is an HTTP message."""
        if self.headers.get("Content-Type", "").startswith("application/http"):
            return split_http(self.block)[1]
        return self.block

    def to_bytes(self) -> bytes:
        """The record without the two line ends that close it."""
        lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in self.headers.items()), f"Content-Length: {len(self.block)}"]
        return "\r\n".join(lines).encode() + END + self.block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers, body) of an HTTP message; either kind of line end."""
    ends = [(k, len(end)) for end in (END, b"\n\n") if (k := block.find(end)) >= 0]
    if not block.startswith(b"HTTP/") or not ends:
        return b"", block
    at, size = min(ends)
    return block[: at + size], block[at + size :]


def arc_header_line(version: int, values: dict[str, str]) -> bytes:
    return (" ".join(values.get(name) or "-" for name in FIELDS[version]) + "\n").encode()


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200",
              "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return arc_header_line(version, values) + body + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an (uncompressed or gzip-compressed) ARC file, its version block first."""
    if data[:2] == b"\x1f\x8b":
        data = gunzip(data)
    at, names, version = 0, FIELDS[1], 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"header line without end at byte {at}")
        line = data[at:stop].rstrip(b"\r").decode("utf-8", "replace")
        first = line.startswith("filedesc:")
        cut = line.rsplit(" ", 4 if first and line.count(" ") < 9 else len(names) - 1)
        if first:
            names = FIELDS[2 if len(cut) > 5 or line.count(" ") >= 9 else 1]
            cut = line.rsplit(" ", len(names) - 1)
        if len(cut) != len(names) or not cut[-1].isdigit():
            raise ValueError(f"malformed header line at byte {at}: {line[:200]!r}")
        size = int(cut[-1])
        block = data[stop + 1 : stop + 1 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} declares {size} bytes and has {len(block)}")
        if first:
            own = block.split(b"\n")
            if own[0][:1].isdigit():
                version = int(own[0].split()[0])
            names = own[1].decode().split() if len(own) > 1 and own[1] else FIELDS.get(version, FIELDS[1])
        yield ArcRecord(version, dict(zip(names if not first else FIELDS[2 if len(cut) > 5 else 1], cut)), block)
        at = stop + 1 + size


def iso_date(date: str) -> str:
    """2024-01-31T10:20:30Z from 20240131102030; shorter dates (version 1 allows them) are filled up."""
    full = date + "00000101000000"[len(date) :] if len(date) < 14 else date[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, block_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {block_digest}')}>"


def converted(arc: ArcRecord) -> WarcRecord:
    """The WARC record that means the same."""
    url, kind = arc.fields["URL"], arc.fields.get("Content-type", "-")
    date, whole = iso_date(arc.fields["Archive-date"]), digest(arc.block)
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id(url, date, whole), "WARC-Date": date}
    if url.startswith("filedesc:"):
        headers |= {"WARC-Type": "warcinfo", "WARC-Filename": url.removeprefix("filedesc:").lstrip("/"), "Content-Type": "application/warc-fields"}
        lines = f"software: arc converter\r\nformat: WARC File Format 1.0\r\narc-version: {arc.version}\r\n"
        return WarcRecord(headers, lines.encode())
    headers["WARC-Target-URI"] = url
    if arc.fields.get("IP-address", "-") not in ("-", "0.0.0.0"):
        headers["WARC-IP-Address"] = arc.fields["IP-address"]
    head, body = split_http(arc.block)
    if head:
        headers |= {"WARC-Payload-Digest": digest(body), "Content-Type": "application/http; msgtype=response"}
    elif url.startswith("dns:"):
        headers["Content-Type"] = "text/dns"
    else:
        headers |= {"WARC-Type": "resource", "Content-Type": kind if kind != "-" else "application/octet-stream", "WARC-Payload-Digest": whole}
    headers["WARC-Block-Digest"] = whole
    return WarcRecord(headers, arc.block)


def revisit(head: bytes, url: str, date: str, whole: str, payload: str, size: int, to_key: str, to_url: str) -> WarcRecord:
    """A record without payload for the HTTP message of this head, block digest, payload digest and payload size; it refers to
    the record of to_key, whose payload is identical."""
    headers = {"WARC-Type": "revisit", "WARC-Record-ID": record_id(url, date, whole), "WARC-Date": date, "WARC-Target-URI": url, "WARC-IP-Address": PAGE_ADDRESS,
               "WARC-Payload-Digest": payload, "Content-Type": "application/http; msgtype=response",
               "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": to_url,
               "WARC-Refers-To-Date": date, "X-Refers-To-Key": to_key, "X-Payload-Length": str(size), "WARC-Block-Digest": digest(head)}
    return WarcRecord(headers, head)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers.pop("Content-Length"))
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size or data[stop + 4 + size : stop + 8 + size] != END:
            raise ValueError(f"record at byte {at} is cut short")
        yield WarcRecord(headers, block)
        at = stop + 8 + size


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data.lstrip(b"\0")
    return b"".join(out)


def _safe(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:unknown"


def http_head(key: str) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Record-Key: {key}\r\n\r\n".encode()


def arc_of_page(version: int, key: str, url: str, html: bytes, date: str) -> bytes:
    block = http_head(key) + html
    values = {"URL": url, "IP-address": PAGE_ADDRESS, "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Offset": "0",
              "Filename": "pages.arc", "Archive-length": str(len(block))}
    return arc_header_line(version, values) + block + b"\n"


def write_archives(records: DataFrame, path: str) -> None:
    """records: one binary column; each row is a whole archive and becomes a file (which a zero byte ends: padding)."""
    text = records.select(F.col(records.columns[0]).cast("string"))
    text.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def member(record: WarcRecord) -> bytes:
    return gzip.compress(record.to_bytes() + END, 6, mtime=0)


def grouped(parts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """parts in lists of at most ARCHIVE bytes, or of one part."""
    held, size = [], 0
    for part in parts:
        if held and size + len(part) > ARCHIVE:
            yield held
            held, size = [], 0
        held.append(part)
        size += len(part)
    if held:
        yield held


def _archived(archives: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for archive in archives:
        yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])


def archive_pages(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT,
                  arc_version: int = 1, date: str = "20240101000000") -> list[str]:
    """Writes a WARC record for each row to archives in folders of path, and returns these."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key_col).alias("key"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("name", F.coalesce(F.col("key").cast("string"), F.lit("-"))).withColumns({"sha": F.sha1("html"), "size": F.octet_length("html")})
    head, tail = (F.lit(x).cast("binary") for x in http_head("|").split(b"|"))
    whole = F.sha1(F.concat(head, F.col("name").cast("binary"), tail, F.col("html")))
    told = written(rows.select("key", "name", "url", "sha", "size", whole.alias("whole")), "digests")
    repeated = (
        told.where(F.col("size") >= min_revisit).groupBy("sha", "size")
        .agg(F.count("*").alias("n"), F.max(F.when(F.col("key").isNotNull(), F.struct("key", "url"))).alias("first"))
        .where("n > 1 and first is not null")
    )
    repeated = written(repeated, "repeated")
    payload = F.struct("sha", "size")
    hit = suspected(rows.withColumn("payload", payload), "payload", repeated.select(payload.alias("payload")))
    iso = iso_date(date)

    def converted_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = version_block(arc_version, "pages.arc", date)
        rows = (zip(*(c.to_pylist() for c in batch.columns)) for batch in batches)
        legacy = (arc_of_page(arc_version, name, _safe(url), html, date) for batch in rows for name, url, html in batch)
        yield from _archived(b"".join(member(converted(arc)) for arc in read_arc(opening + b"".join(held))) for held in grouped(legacy))

    def revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = member(converted(next(read_arc(version_block(arc_version, "pages.arc", date)))))
        sha1 = lambda told: "sha1:" + base64.b32encode(bytes.fromhex(told)).decode()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        made = (member(revisit(http_head(name), _safe(url), iso, sha1(whole), sha1(sha), size, to_key, _safe(to_url))) for name, url, whole, sha, size, to_key, to_url in rows)
        yield from _archived(opening + b"".join(held) for held in grouped(made))

    folders = [f"{path}/responses"]
    if hit is None:
        write_archives(rows.select("name", "url", "html").mapInArrow(converted_pages, "archive binary"), folders[0])
        return folders
    judged = told.withColumn("payload", payload)
    judged = judged.where(suspected(judged, "payload", repeated.select(payload.alias("payload"))))
    most = repeated.agg(F.max("n")).first()[0]
    refers = repeated.select(payload.alias("payload"), "first")
    unknown = judged.select("payload").distinct().join(refers, "payload", "left_anti").select("payload", F.lit(None).cast(refers.schema["first"].dataType).alias("first"))
    judged = written(joined(judged, refers.unionByName(unknown), "payload", "name", most), "judged")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first.key"))
    # the rows that a Bloom filter took for repeated and that are responses after all: the referred ones, and its errors
    page = F.struct("sha", "size", "name")
    kept = written(judged.where(~again).select(page.alias("page")).distinct(), "kept")
    paged = rows.withColumns({"payload": payload, "page": page})
    some = paged.where(hit)
    own = some.where(suspected(some, "page", kept)).join(kept, "page", "left_semi").select("name", "url", "html")
    write_archives(paged.where(~hit).select("name", "url", "html").mapInArrow(converted_pages, "archive binary"), folders[0])
    write_archives(own.mapInArrow(converted_pages, "archive binary"), f"{path}/referred")
    told = judged.where(again).select("name", "url", "whole", "sha", "size", F.col("first.key").cast("string").alias("to_key"), F.col("first.url").alias("to_url"))
    write_archives(told.mapInArrow(revisits, "archive binary"), f"{path}/revisits")
    return [*folders, f"{path}/referred", f"{path}/revisits"]


def convert_files(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Converts every ARC file under arc_path (each read whole by one task; such files hold about 100 MB) to archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(arc_path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (member(converted(arc)) for batch in batches for data in batch.column(0) for arc in read_arc(data.as_py()))
        yield from _archived(b"".join(held) for held in grouped(records))

    write_archives(files.mapInArrow(run, "archive binary"), warc_path)


def read_archives(spark: SparkSession, path: str | list[str], key_type: str = "bigint") -> DataFrame:
    """key, url, date, record_type, payload_bytes, payload_digest (hex), digest_holds, refers_to of each record read back.

    Lengths and digests of responses are taken from the payload as read, and compared with what the header says.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "url", "date", "record_type", "payload_bytes", "payload_digest", "digest_holds", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
        for batch in batches:
            for data in batch.column(0):
                out = [[] for _ in names]
                for r in read_warc(gunzip(data.as_py())):
                    said, kind = r.headers.get("WARC-Payload-Digest", ""), r.headers["WARC-Type"]
                    told = base64.b32decode(said.removeprefix("sha1:")).hex()
                    head, _ = split_http(r.block) if r.headers.get("Content-Type", "").startswith("application/http") else (b"", b"")
                    own = [x.split(b": ", 1)[1].decode() for x in head.split(b"\r\n") if x.startswith(b"X-Record-Key: ")]
                    if kind == "revisit":
                        size, found = int(r.headers["X-Payload-Length"]), told
                    else:
                        payload = r.payload()
                        size, found = len(payload), hashlib.sha1(payload).hexdigest()
                    values = [own[0] if own and own[0] != "-" else None, r.headers.get("WARC-Target-URI"), r.headers["WARC-Date"], kind, size, found, found == told, r.headers.get("X-Refers-To-Key")]
                    for column, value in zip(out, values):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    read = files.mapInArrow(run, "key string, url string, date string, record_type string, payload_bytes long, payload_digest string, digest_holds boolean, refers_to string")
    return read.withColumns({"key": F.col("key").cast(key_type), "refers_to": F.col("refers_to").cast(key_type)})


def round_trip(pages: DataFrame, key_col: str = "page_id", **settings) -> DataFrame:
    """The records of archives written from pages and read back (without warcinfo)."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    folders = archive_pages(pages, path, key_col, **settings)
    found = read_archives(spark, folders, pages.schema[key_col].dataType.simpleString()).where("record_type <> 'warcinfo'")
    return found.withColumnRenamed("key", key_col)
