"""Legacy ARC archives to WARC.

``write_arc`` makes ARC files of pages, ``convert`` turns ARC files into WARC files, ``read_warc`` reads these back.
The converter parses each file's version block, which says how many fields a header line has, and then header line
by header line takes the declared number of bytes. WARC identifiers are made from page and digest, so that a lost
task that runs again writes the same ones, and where a record has no page identifier, as in archives of other makers,
of its URL, date and digest; dates come from the 14 digits of the ARC header, types from the record's
content, digests from payload and block.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page identifier (none of them
having one, the earliest) is the response; the others become revisits that refer to it and carry their HTTP head alone.
Equal payloads are found on rows of digests, and each archive is then given the list of its revisits by their places
in it. Payloads are not shuffled; where there are too many revisits to broadcast, whole archives are, compressed.

Files are written by Spark's text writer, whose strings are bytes and whose lines end where a record does, so that
any store can hold them; each has at most about SEGMENT bytes before compression (or one record, if that is longer)
and is read whole.

Header lines are read byte for byte as Latin-1, so that any archive can be read; what is not ASCII in a URL is escaped
in the WARC file.

Defined cases: a null payload is empty; a null page identifier, and a null or odd URL, come back as they were given;
rows that repeat identifier and payload are the same record and have the same type; empty tables make no files.
Only the columns named as parameters are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote_from_bytes, unquote_to_bytes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sahifa.cluster import materialize, new_path
from sahifa.llm.arrow import map_stream

SEGMENT = 64 << 20
MIN_REVISIT = 100
#: Revisits up to this many are broadcast (about 150 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
ARC_DATE, ARC_IP, ARC_TYPE = "20010101000000", "0.0.0.0", "text/html"
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PAGE_HEADER, REVISIT_PROFILE = "X-Page-Id", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The length of the payload that a revisit leaves out; a field of our own, as the standard has none.
LENGTH_FIELD = "X-Payload-Length"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's own for URLs
SAFE = "!#$%&'()*+,/:;=?@[]~-._"
NO_URL = "urn:none"

RECORD = T.StructType(
    [
        T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("record_id", T.StringType()),
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("date", T.StringType()), T.StructField("head", T.BinaryType()),
        T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    ]
)
READ = T.StructType(
    [
        T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to_id", T.StringType()), T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()), T.StructField("date", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    ]
)


def escaped(url: str | None) -> str:
    """A URL as header lines can hold it: white space, control and non-ASCII bytes as escapes, % as %25 where odd."""
    return NO_URL if url is None else quote_from_bytes(url.replace("%", "%25").encode(), safe=SAFE)


def unescaped(url: str) -> str | None:
    return None if url == NO_URL else unquote_to_bytes(url).decode(errors="replace")


def head_of(page_id: int | None, payload_bytes: int) -> bytes:
    page = "" if page_id is None else f"{PAGE_HEADER}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: {ARC_TYPE}; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n{page}\r\n".encode()


def head_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1") if found else None


def page_of(head: bytes) -> int | None:
    found = head_value(head, PAGE_HEADER)
    return int(found) if found and re.fullmatch(r"-?[0-9]{1,18}", found) else None


def arc_begin(version: int, name: str) -> bytes:
    block = f"{version} 0 sahifa\n{FIELDS[version]}\n\n".encode()
    rest = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} {ARC_IP} {ARC_DATE} text/plain {rest}{len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, block: bytes) -> bytes:
    rest = "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} "
    return f"{url} {ARC_IP} {ARC_DATE} {ARC_TYPE} {rest}{len(block)}\n".encode() + block + b"\n"


def arc_records(data: bytes) -> Iterator[tuple[int, list[str], bytes]]:
    """(place, header fields, block) of each record after the version block, by the version's fields and declared lengths."""
    fields, at = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("latin-1").rstrip("\r")
        if not fields:
            if not line.startswith("filedesc://"):
                raise ValueError(f"no version block but {line[:80]!r}")
            length = int(line.rsplit(" ", 1)[1])
            fields = len(FIELDS[int(data[end + 1 : end + 1 + length].split(b" ", 1)[0])].split())
            at = end + 1 + length
            continue
        head = line.rsplit(" ", fields - 1)
        length = int(head[-1])
        if len(head) != fields or end + 1 + length > len(data):
            raise ValueError(f"{len(head)} of {fields} fields, or a length beyond the end, at {at}: {line[:80]!r}")
        yield at, head, data[end + 1 : end + 1 + length]
        at = end + 1 + length


def warc_record(kind: str, record_id: str, url: str, date: str, payload_digest: str, block: bytes, refers_to: str | None, payload_bytes: int) -> bytes:
    day = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Target-URI: {url}", f"WARC-Date: {day}",
        f"WARC-Payload-Digest: sha256:{payload_digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers_to}>", f"{LENGTH_FIELD}: {payload_bytes}"] if refers_to else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("latin-1").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}: {version[:80]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin = end + 4
        after = begin + int(fields["content-length"])
        if data[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        yield fields, data[begin:after]
        at = after + 4


def record_uuid(page_id: int | None, url: str, date: str, digest: str) -> str:
    """A record's identifier: of the page and its payload, or of where and when it was taken."""
    return str(uuid.uuid5(NAMESPACE, f"{page_id}/{digest}" if page_id is not None else f"{url} {date} {digest}"))


def split_block(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head of a block, if it has one, and the payload."""
    head, mark, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    return head + mark, payload


def ascii_url(url: str) -> str:
    return quote_from_bytes(url.encode("latin-1"), safe=SAFE + "%")


def whole(content: bytes) -> bytes:
    """A file's bytes; gzip files may have several members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def segments(records: Iterator[bytes]) -> Iterator[dict[str, list]]:
    """Records gathered to files; the last byte of a file is left to the text writer's line end."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= SEGMENT:
            yield {"value": [b"".join(held)[:-1]]}
            held, size = [], 0
    if held:
        yield {"value": [b"".join(held)[:-1]]}


SEGMENT_SCHEMA = T.StructType([T.StructField("value", T.BinaryType())])


def write_files(files: DataFrame, path: str) -> None:
    """One file for each row. Spark's strings are bytes, so the cast changes nothing."""
    out = files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip")
    out.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Pages as ARC files; files of a task take turns between the two versions."""

    def run(batches):
        version, held, size = 1, [], 0
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"pages-{version}.arc"
                if not held:
                    held, size = [arc_begin(version, name)], 0
                payload = (html or "").encode()
                held.append(arc_record(version, name, sum(map(len, held[:1])) + size, escaped(url), head_of(page_id, len(payload)) + payload))
                size += len(held[-1])
                if size >= SEGMENT:
                    yield {"value": [b"".join(held)[:-1]]}
                    version, held = 3 - version, []
        if held:
            yield {"value": [b"".join(held)[:-1]]}

    source = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    write_files(map_stream(source, run, SEGMENT_SCHEMA), path)


def parse_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per ARC record: file and place, identifiers, URL, date, HTTP head, payload and its digest."""
    schema = T.StructType([f for f in RECORD if with_payload or f.name not in ("payload", "head")])

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[dict] = []
                held = 0
                for offset, fields, block in arc_records(whole(content.as_py())):
                    head, payload = split_block(block)
                    page, digest = page_of(head), hashlib.sha256(payload).hexdigest()
                    row = {"file": file, "offset": offset, "record_id": record_uuid(page, fields[0], fields[2], digest), "page_id": page, "url": fields[0], "date": fields[2]}
                    rows.append(row | {"payload_bytes": len(payload), "payload_digest": digest, "head": head, "payload": payload if with_payload else None})
                    held += len(payload) if with_payload else 256
                    if held > 1 << 20:
                        yield {f.name: [r[f.name] for r in rows] for f in schema}
                        rows, held = [], 0
                if rows:
                    yield {f.name: [r[f.name] for r in rows] for f in schema}

    return map_stream(read_files(spark, path), run, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT) -> None:
    """ARC files to WARC files, with revisits for equal payloads of at least ``min_revisit`` bytes."""
    rows = materialize(parse_arc(spark, arc_path, with_payload=False), "digests")
    key = ["payload_digest", "payload_bytes"]
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "date", "url", "record_id")).alias("first")
    groups = rows.filter(F.col("payload_bytes") >= min_revisit).groupBy(*key).agg(first, F.min("record_id").alias("x"), F.max("record_id").alias("y"))
    several = groups.filter("x <> y").select(*key, F.col("first.record_id").alias("owner"))
    revisits = materialize(rows.join(several, key).filter("record_id <> owner").select("file", "offset", "owner"), "revisits")
    # A list is of one file, and no longer than that has records.
    lists = revisits.groupBy("file").agg(F.collect_list(F.struct("offset", "owner")).alias("revisits")).withColumnRenamed("file", "path")
    side = F.broadcast(lists) if revisits.count() <= BROADCAST_ROWS else lists
    files = read_files(spark, arc_path).join(side, "path", "left")

    def run(batches):
        def converted():
            for batch in batches:
                for content, found in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    owners = {r["offset"]: r["owner"] for r in found or ()}
                    for offset, fields, block in arc_records(whole(content.as_py())):
                        head, payload = split_block(block)
                        page, digest, owner = page_of(head), hashlib.sha256(payload).hexdigest(), owners.get(offset)
                        kind = "revisit" if owner else "response" if head else "resource"
                        yield warc_record(kind, record_uuid(page, fields[0], fields[2], digest), ascii_url(fields[0]), fields[2], digest, head if owner else block, owner, len(payload))

        yield from segments(converted())

    write_files(map_stream(files.select("content", "revisits"), run, SEGMENT_SCHEMA), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record, without its payload; length and digest are those of the full payload.

    A response's are taken from the bytes read back, and its declared digest must agree with them.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for fields, block in warc_records(whole(content.as_py())):
                    head, payload = split_block(block)
                    digest, page = fields["warc-payload-digest"].partition(":")[2], page_of(head)
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['warc-record-id']} has another payload than its digest says")
                    length = int(fields.get(LENGTH_FIELD.lower(), 0)) if revisit else len(payload)
                    of = lambda name: fields[name][len("<urn:uuid:") : -1] if name in fields else None
                    rows.append((of("warc-record-id"), fields["warc-type"], of("warc-refers-to"), page, unescaped(fields["warc-target-uri"]), fields["warc-date"], length, digest))
                for at in range(0, len(rows), 1000):
                    yield dict(zip(READ.names, map(list, zip(*rows[at : at + 1000], strict=True)), strict=True))

    return map_stream(read_files(spark, path), run, READ)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC, to WARC, and read back: one row per page, ``refers_to`` being the page that a revisit repeats."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    convert(spark, arc, warc)
    rows = materialize(read_warc(spark, warc), "records")
    revisits = rows.filter("record_type = 'revisit'").select("refers_to_id").distinct()
    named = rows.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).join(revisits, "refers_to_id", "left_semi").distinct()
    return rows.join(named, "refers_to_id", "left").select(F.col("page_id").alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
