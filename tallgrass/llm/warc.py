"""Operator 1: legacy ARC archives to WARC, and WARC archives back to rows.

``read_arc`` parses the header line of each ARC record by the version that the
archive declares (1: URL, IP address, date, type, length; 2: also result code,
checksum, location, offset, file name) and takes as many bytes as the line
declares.  ``arc_to_warc`` synthesises what ARC lacks: record ids, WARC dates,
record types and digests; equal payloads become revisits.  ``write_warc``
writes standard archives through Spark's own text writer (a record ends with two
line ends, a compressed one is a gzip member of its own), ``read_warc`` reads
them by their declared lengths.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, scratch_path, staged, table

ARC = "archive string, version int, url string, ip string, arc_date string, content_type string, status int, payload binary"
WARC = "record_id string, record_type string, url string, warc_date string, content_type string, payload_digest string, refers_to_record string, refers_to long, payload_bytes long, page_id long, payload binary, intact boolean"
_ARC_FIELDS = {1: 5, 2: 10}
#: Payload bytes that an archive file is meant to have and has at most (or one record), its records at most.
FILE_BYTES, MOST_BYTES, FILE_RECORDS = 128 << 20, 1 << 30, 20_000
#: Rows, and bytes of their payloads, that move from Python to Spark at once; bytes that are unzipped at a time.
ROWS, ROW_BYTES, UNZIP = 1_000, 32 << 20, 1 << 14
#: What parts compressed records: a gzip member without content.
_NO_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs


def pieces(blob: bytes) -> Iterator[bytes]:
    """What a gzip file of however many members holds, or the bytes as they are, a piece at a time."""
    view, at = memoryview(blob), 0
    if blob[:2] != b"\x1f\x8b":
        for at in range(0, len(view), 4 * UNZIP):
            yield bytes(view[at : at + 4 * UNZIP])
        return
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            part = view[at : at + UNZIP]
            if not len(part):
                raise EOFError("the archive ends within a member")
            yield member.decompress(part)
            at += len(part) - len(member.unused_data)
        while at < len(view) and not view[at]:  # padding
            at += 1


class Reader:
    """Bytes out of pieces, of which only what is asked for is held."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.first, self.at = parts, bytearray(), 0, 0

    def more(self) -> bool:
        part = next((p for p in self.parts if p), None)
        if part is None:
            return False
        del self.held[: self.first]
        self.first = 0
        self.held += part
        return True

    def left(self) -> int:
        return len(self.held) - self.first

    def next_byte(self) -> bytes:
        """The byte that comes next, which stays; none at the end."""
        while not self.left():
            if not self.more():
                return b""
        return bytes(self.held[self.first : self.first + 1])

    def take(self, n: int) -> bytes:
        """So many bytes, or as many as there are."""
        while self.left() < n and self.more():
            pass
        out = bytes(self.held[self.first : self.first + n])
        self.first += len(out)
        self.at += len(out)
        return out

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before a mark, which is passed over; None where there is none."""
        seen = 0
        while (end := self.held.find(mark, self.first + seen)) < 0:
            seen = max(0, self.left() - len(mark) + 1)
            if not self.more():
                return None
        return self.take(end - self.first + len(mark))[: -len(mark)]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse_arc(name: str, blob: bytes) -> Iterator[tuple]:
    """Records of one ARC archive, plain or gzip, its own description left out; ``ValueError`` names the place of a broken record."""
    r, version = Reader(pieces(blob)), 0
    while mark := r.next_byte():
        if mark in (b"\n", b"\r"):  # between records
            r.take(1)
            continue
        at = r.at
        line = r.until(b"\n")
        if line is None:
            raise ValueError(f"{name}: no end of the header line at byte {at}")
        fields = line.rstrip(b"\r").decode("utf-8", "replace").split(" ")
        described = fields[0].startswith("filedesc://")
        length = int(fields[-1]) if fields[-1].isdigit() else None
        start = r.at
        payload = r.take(length) if length is not None else b""
        if described:
            own = payload.split(b"\n", 1)[0].split(b" ")
            version = int(own[0]) if own[0].isdigit() else 0
        want = _ARC_FIELDS.get(version)
        if want is None or length is None or len(fields) < want:
            raise ValueError(f"{name}: not a header line of ARC version {version} at byte {at}")
        if len(payload) < length:
            raise ValueError(f"{name}: the record at byte {start} declares {length} bytes, {len(payload)} are there")
        if not described:
            head, tail = " ".join(fields[: len(fields) - want + 1]), fields[len(fields) - want + 1 :]  # a URL may hold spaces
            yield name, version, head, tail[0], tail[1], tail[2], int(tail[3]) if version == 2 and tail[3].isdigit() else None, payload


def in_batches(schema: pa.Schema, rows: Iterator[tuple], payload: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded length and size; ``payload`` is the place of the column that counts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[payload] or b"")
        if len(held) >= ROWS or size >= ROW_BYTES:
            yield arrow_rows(schema, held)
            held, size = [], 0
    yield arrow_rows(schema, held)


def read_arc(archives: DataFrame) -> DataFrame:
    """Records of ARC archives given as rows (path, content), plain or gzip; Spark's ``binaryFile`` source gives such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ARC)
        for batch in batches:
            records = (x for name, blob in zip(batch["path"].to_pylist(), batch["content"], strict=True) for x in parse_arc(name, blob.as_py() or b""))
            yield from in_batches(schema, records, 7)

    return archives.select("path", "content").mapInArrow(run, ARC)


def write_arc_rows(pages: DataFrame) -> DataFrame:
    """An ARC archive (path, content) for each page: version 1 for even ids, 2 for odd and null ones; a null url is ``about:blank``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    first = F.col("page_id") % 2 == 0
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("about:blank")), r"[\r\n]", "%0A")
    date, ip = F.lit("20200101000000"), F.lit("0.0.0.0")
    about = F.when(first, F.lit("1 0 tallgrass\nURL IP-address Archive-date Content-type Archive-length\n")).otherwise(F.lit("2 0 tallgrass\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"))
    name = F.concat(F.lit("page-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(".arc"))
    own = F.concat(F.lit("filedesc://"), name, F.lit(" "), ip, F.lit(" "), date, F.lit(" text/plain "), F.when(first, F.lit("")).otherwise(F.concat(F.lit("200 - - 0 "), name, F.lit(" "))), F.length(about).cast("string"), F.lit("\n"), about, F.lit("\n"))
    line = F.concat(url, F.lit(" "), ip, F.lit(" "), date, F.lit(" text/html "), F.when(first, F.lit("")).otherwise(F.concat(F.lit("200 - - 0 "), name, F.lit(" "))), F.octet_length(payload).cast("string"), F.lit("\n"))
    return pages.select(name.alias("path"), F.concat(own.cast("binary"), line.cast("binary"), payload, F.lit("\n").cast("binary")).alias("content"))


def arc_to_warc(records: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, int]:
    """WARC records (as ``write_warc`` takes them) of ARC records with a ``page_id``, and the bytes of the longest payload.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest page id is the response (``refers`` null) and those of other
    pages revisit it (``refers`` names its page, url and date); a record without
    a page id is a response of its own.  Digests are joined as rows of a few
    bytes each, payloads move once, by page id and digest.
    """
    records = records.withColumn("digest", F.sha1("payload"))
    marks = staged(records.select("page_id", "digest", "url", "arc_date", F.octet_length("payload").alias("size")), "arc-digests")
    files, longest = marks.agg(F.ceil(F.sum("size") / FILE_BYTES), F.max("size")).first()
    marks = marks.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).drop("size")
    first = marks.groupBy("digest").agg(F.min(F.struct("page_id", "url", "arc_date")).alias("refers"))
    again = marks.join(first, "digest").where(F.col("page_id") != F.col("refers.page_id")).select("page_id", "digest", "refers").distinct()
    # as many parts as there are to be files, and no fewer than Spark would make
    parts = max(files or 1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return records.repartition(parts, "page_id", "digest").join(again, ["page_id", "digest"], "left"), longest or 0


def warc_record(page_id: int | None, url: str, date: str, content_type: str, payload: bytes | None, refers: dict | None) -> bytes:
    """The bytes of one record up to the two line ends that close it."""
    payload = payload or b""
    block, digest = b"" if refers else payload, base32_sha1(payload)
    head = {
        "WARC-Type": "revisit" if refers else "response",
        "WARC-Record-ID": record_id(url, date, page_id, digest),
        "WARC-Target-URI": one_line(url),
        "WARC-Date": warc_date(date),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block) if refers else digest}",
    }
    if refers:
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": record_id(refers["url"], refers["arc_date"], refers["page_id"], digest),
            "WARC-Refers-To-Target-URI": one_line(refers["url"]),
            "WARC-Refers-To-Date": warc_date(refers["arc_date"]),
            "X-Refers-To-Page": refers["page_id"],
        }
    head |= {"X-Page-Id": page_id, "X-Payload-Length": len(payload), "Content-Type": content_type, "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def one_line(url: str) -> str:
    return re.sub(r"[\r\n]", "", url)


def warc_date(date: str) -> str:
    return re.sub(r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*$", r"\1-\2-\3T\4:\5:\6Z", date)


def record_id(url: str, date: str, page_id: int | None, digest: str) -> str:
    """The same for the same record; rows that repeat a page with its payload share it."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{one_line(url)} {date} {page_id} {digest}')}>"


def write_warc(records: DataFrame, path: str, compression: str = "none", longest: int = 0) -> None:
    """Write records (page_id, url, arc_date, content_type, payload, refers) as WARC archives below ``path``.

    With ``gzip`` each record is a member of its own, as readers that seek to a
    record need it; members without content stand between them.  A part of
    ``records`` becomes a file, or several: of as many records as have no more
    than ``MOST_BYTES`` even if all were like the ``longest`` payload.
    """
    zipped = {"none": False, "gzip": True}[compression]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                made = [warc_record(*r.values()) for r in batch.slice(at, ROWS).to_pylist()]
                yield pa.RecordBatch.from_pydict({"value": [gzip.compress(x + b"\r\n\r\n", 6, mtime=0) for x in made] if zipped else made})

    archives = records.select("page_id", "url", "arc_date", "content_type", "payload", "refers").mapInArrow(run, "value binary")
    writer = archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", max(1, min(FILE_RECORDS, MOST_BYTES // max(1, longest))))
    writer.option("encoding", "ISO-8859-1").option("lineSep", _NO_MEMBER if zipped else "\r\n\r\n").text(path)


def parse_warc(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, plain or gzip, by their declared lengths."""
    r = Reader(pieces(blob))
    while r.next_byte():
        at = r.at
        lines = r.until(b"\r\n\r\n")
        version, *lines = (lines or b"").decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        block = r.take(int(head["content-length"]))
        if len(block) < int(head["content-length"]) or r.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it declares")
        yield head, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (columns ``WARC``) of all archives below ``path``, plain or gzip; ``intact`` tells whether block and digest agree.

    An archive comes as one ``binaryFile`` value, so it may have 2 GB at most; it
    is unzipped and cut a record at a time.
    """

    whole = lambda x: None if x is None else int(x)

    def row(h: dict[str, str], block: bytes) -> tuple:
        digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
        return h["warc-record-id"], kind, h.get("warc-target-uri"), h["warc-date"], h.get("content-type"), digest, h.get("warc-refers-to"), whole(h.get("x-refers-to-page")), whole(h.get("x-payload-length")), whole(h.get("x-page-id")), block, kind == "revisit" or base32_sha1(block) == digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                yield from in_batches(arrow_schema(WARC), (row(*x) for x in parse_warc(content.as_py())), 10)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, WARC)


def pages_to_warc(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> DataFrame:
    """Pages through ARC archives into WARC archives below ``path``, and back as one row per page.

    A null html is an empty payload, a null url ``about:blank``, a null
    ``page_id`` a response of its own; rows that repeat a page id with another
    payload are records of their own, rows that repeat it with the same payload
    are all responses if they are the first, else all revisits; an empty table
    gives no rows.  Other columns are dropped.
    """
    spark = pages.sparkSession
    arc = read_arc(write_arc_rows(pages)).withColumn("page_id", F.expr("try_cast(regexp_extract(archive, 'page-(-?[0-9]+)[.]arc$', 1) AS long)"))
    records, longest = arc_to_warc(arc, min_bytes)
    write_warc(records, path, compression, longest)
    back = read_warc(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_to_warc(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT h, min(page_id) AS first_page FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(p.h, (10 * (k // 8) + 1)::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::BIGINT) & 31) + 1)::INT, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to,
       true AS intact
FROM p JOIN f USING (h)
"""
