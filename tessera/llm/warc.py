"""Legacy archive converter: ARC files to WARC files, and a WARC reader.

``convert`` parses ARC containers: a version block says which header fields a
record line has (version 1: URL, IP address, date, type, length; version 2 has
result code, checksum, location, offset and file name before the length), and
the declared length cuts the record.  For each record it synthesises what
WARC asks for: an identifier from container and offset, an ISO date from the
14-digit one, and the SHA-1 digest of the payload in base32.  ``mark_revisits``
keeps the first record of equal payloads as ``response``; others become
``revisit`` records that hold the HTTP headers and refer to it.  ``write_warc``
writes gzipped files with Spark's text writer (each record ends with the two
line breaks that the writer puts after a row); ``read_warc`` cuts them by
their declared lengths and checks the digests.

Scale: containers are cut by bytes, WARC files after ``RECORDS_PER_FILE``
records; a reader holds one compressed file and one unpacked record.  The
payload is shuffled once, to meet the first record of its digest, and that join
can be split where one payload is hot: the other side has one row per digest.

Defined results: a null payload or URL is empty (the URL then names the page);
of rows equal in all of the order, the first by container and offset is the
response; an empty table writes no records and reads back none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import scratch_dir, stored, table

#: Bytes after which a container is closed; records of a WARC file.
CONTAINER_BYTES = 4 << 20
RECORDS_PER_FILE = 256
MIN_REVISIT_BYTES = 0
#: Parts that the revisits of one response are dealt to.
SALT = 16
#: FIXED VALUES: header fields of a record line by ARC version.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
CRLF = "\r\n"


class ArcWriter:
    """Builds the bytes of one container."""

    def __init__(self, name: str, version: str):
        self.name, self.version, self.size, self.parts = name, version, 0, []
        block = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n"
        self._line(f"filedesc://{name}", "0.0.0.0", "20240101000000", "text/plain", block.encode(), "200")

    def _line(self, url, ip, date, kind, block: bytes, code: str) -> None:
        value = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": code, "Checksum": "-",
                 "Location": "-", "Offset": str(self.size), "Filename": self.name, "Archive-length": str(len(block))}
        head = " ".join(value[f] for f in ARC_FIELDS[self.version]).encode() + b"\n"
        self.parts += [head, block, b"\n"]
        self.size += len(head) + len(block) + 1

    def add(self, url: str, date: str, kind: str, http: bytes, payload: bytes) -> None:
        clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
        self._line(clean, "0.0.0.0", date, kind, http + payload, "200")

    def content(self) -> bytes:
        return b"".join(self.parts)


def arc_records(content: bytes):
    """(offset, fields by name, block) of every record of a container but its version block."""
    at, fields = 0, ARC_FIELDS["1"]
    while at < len(content):
        stop = content.find(b"\n", at)
        if not content[at:stop if stop >= 0 else None].strip():
            at = len(content) if stop < 0 else stop + 1
            continue
        if stop < 0:
            raise ValueError(f"ARC header line at {at} is cut off")
        line = content[at:stop].decode("utf-8", "replace")
        if line.startswith("filedesc://"):
            size = int(line.rsplit(" ", 1)[1])
            block = content[stop + 1:stop + 1 + size].decode("utf-8", "replace").split("\n")
            version = block[0].split(" ")[0]
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version!r}")
            fields = block[1].split(" ") if len(block) > 1 and block[1] else ARC_FIELDS[version]
        else:
            values = line.rsplit(" ", len(fields) - 1)  # a URL may hold blanks
            if len(values) != len(fields):
                raise ValueError(f"ARC header line with {len(values)} of {len(fields)} fields: {line[:200]!r}")
            named = dict(zip(fields, values, strict=True))
            size = int(named["Archive-length"])
            if stop + 1 + size > len(content):
                raise ValueError(f"ARC record at {at} is cut off")
            yield at, named, content[stop + 1:stop + 1 + size]
        at = stop + 1 + size


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers, with the blank line, and payload; a block without headers is all payload."""
    if block[:5] == b"HTTP/":
        cut = block.find(b"\r\n\r\n")
        if cut >= 0:
            return block[:cut + 4], block[cut + 4:]
    return b"", block


def digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


RECORD = ("record_id string, container string, offset bigint, uri string, ip string, date string, mime string, "
          "http binary, payload binary, payload_digest string")


def _columns(rows: list[tuple], ddl: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def pack_arc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as ARC containers (path, content), of version 1 and 2 in turn: what a crawl of the time would have left."""
    def run(batches):
        from datetime import datetime, timedelta

        from pyspark import TaskContext

        part, n, arc = TaskContext.get().partitionId(), 0, None
        start = datetime(2024, 1, 1)
        for batch in batches:
            for pid, u, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if arc is None:
                    arc = ArcWriter(f"pages-{part:05d}-{n:05d}.arc", "12"[n % 2])
                payload = (text or "").encode("utf-8", "surrogatepass")
                date = (start + timedelta(seconds=(pid or 0) % 31_536_000)).strftime("%Y%m%d%H%M%S")
                named = "" if pid is None else f"X-Page-Id: {pid}{CRLF}"
                http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{named}{CRLF}".encode()
                arc.add(u or f"urn:page:{pid}", date, "text/html", http, payload)
                if arc.size >= CONTAINER_BYTES:
                    yield _columns([(arc.name, arc.content())], "path string, content binary")
                    arc, n = None, n + 1
        if arc is not None:
            yield _columns([(arc.name, arc.content())], "path string, content binary")

    ship_package(pages.sparkSession)
    return pages.select(page_id, url, html).mapInArrow(run, "path string, content binary")


def convert(arcs: DataFrame) -> DataFrame:
    """One row per record of the containers ``arcs`` (path, content), such as the ``binaryFile`` source gives them."""
    def run(batches):
        import gzip
        import uuid

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path, content = path.as_py(), content.as_py()
                if content[:2] == b"\x1f\x8b":
                    content = gzip.decompress(content)
                rows, size = [], 0
                for at, named, block in arc_records(content):
                    http, payload = http_parts(block)
                    d = named["Archive-date"].ljust(14, "0")
                    iso = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    rid = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{at}')}"
                    rows.append((rid, path, at, named["URL"], named["IP-address"], iso, named["Content-type"], http, payload, digest(payload)))
                    size += len(block)
                    if size >= CONTAINER_BYTES:
                        yield _columns(rows, RECORD)
                        rows, size = [], 0
                yield _columns(rows, RECORD)

    ship_package(arcs.sparkSession)
    return arcs.select("path", "content").mapInArrow(run, RECORD)


def mark_revisits(records: DataFrame, order: list, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``records`` with ``record_type`` and, for revisits, ``refers_to`` (identifier), ``refers_uri`` and ``refers_date``."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "container", "offset", "record_id", "uri", "date")
    big = records.where(F.octet_length("payload") >= min_bytes)
    first = big.groupBy("payload_digest").agg(F.min(place).alias("_first"))
    both = records.join(first, "payload_digest", "left")
    again = (F.octet_length("payload") >= min_bytes) & (F.col("_first.record_id") != F.col("record_id"))
    return both.select(*records.columns, F.when(again, "revisit").otherwise("response").alias("record_type"),
                       *[F.when(again, F.col(f"_first.{c}")).alias(n) for c, n in (("record_id", "refers_to"), ("uri", "refers_uri"), ("date", "refers_date"))])


def write_warc(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Gzipped WARC files below ``path``."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.col("http")).otherwise(F.concat(F.col("http"), F.col("payload")))
    angled = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    is_http = F.octet_length("http") > 0
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", angled("record_id")),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("uri")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", angled("refers_to")), line("WARC-Refers-To-Target-URI", F.col("refers_uri")), line("WARC-Refers-To-Date", F.col("refers_date")),
        line("Content-Type", F.when(is_http, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF))
    # a cast to string keeps the bytes as they are, and the writer writes them so
    records.select(F.concat(head.cast("binary"), block).cast("string").alias("value")).write.option("lineSep", CRLF * 2) \
        .option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def warc_records(file):
    """(headers by lower-case name, block) of every record of a binary file
    object; one record is in memory at a time."""
    at = 0
    while first := file.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        lines, size = [], len(first)
        while (line := file.readline()) not in (b"\r\n", b""):
            lines.append(line.decode("utf-8", "replace"))
            size += len(line)
        named = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        length = int(named["content-length"])
        block = file.read(length)
        if len(block) != length or file.read(4) != b"\r\n\r\n":
            raise ValueError(f"WARC record at {at} is cut off")
        yield named, block
        at += size + 2 + length + 4


READ = "record_id string, record_type string, uri string, date string, refers_to string, payload_digest string, payload_bytes bigint, http string"


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record below ``path``; a response whose payload does not have its digest raises."""
    ddl = READ + ", payload binary" * with_payload

    def run(batches):
        import gzip
        import io

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for named, block in warc_records(gzip.open(io.BytesIO(content.as_py()))):
                    http, payload = http_parts(block)
                    kind, declared = named["warc-type"], named.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "revisit":
                        sizes = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        size = int(sizes[0]) if sizes else None
                    else:
                        size = len(payload)
                        if digest(payload) != declared:
                            raise ValueError(f"digest of {named.get('warc-record-id')} differs")
                    rows.append((named["warc-record-id"].strip("<>"), kind, named.get("warc-target-uri"), named.get("warc-date"),
                                 named["warc-refers-to"].strip("<>") if "warc-refers-to" in named else None, declared, size,
                                 http.decode("utf-8", "replace"), *([payload] if with_payload else [])))
                    held += len(http) + len(payload) * with_payload
                    if held >= CONTAINER_BYTES:
                        yield _columns(rows, ddl)
                        rows, held = [], 0
                yield _columns(rows, ddl)

    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, ddl)


def op10_arc_to_warc(spark, sf_dir) -> DataFrame:
    numbered = lambda c: F.regexp_extract(c, r"(?m)^X-Page-Id: (-?\d+)\r?$", 1)
    page = lambda c: F.when(numbered(c) != "", numbered(c).cast("bigint"))
    records = convert(pack_arc(table(spark, sf_dir, "pages")))
    path = scratch_dir(spark, "warc")
    write_warc(mark_revisits(records, [page(F.col("http").cast("string")).isNull(), page(F.col("http").cast("string"))]), path)
    # the archives are read once; what is joined from here on has no payload
    back = stored(read_warc(spark, path).withColumn("page_id", page(F.col("http"))).drop("http"), "warc-read")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "date"]
    return referred_pages(back).select(*columns)


def referred_pages(back: DataFrame) -> DataFrame:
    """``back`` with the page of the response in ``refers_to`` instead of its
    identifier.  Only revisits are joined, each with the few responses that
    any revisit names; those of one response are dealt to ``SALT`` parts."""
    again = back.where("refers_to is not null")
    named = again.select(F.col("refers_to").alias("record_id")).distinct()
    first = back.where(F.col("record_type") == "response").join(named, "record_id", "left_semi").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_part"))
    dealt = again.withColumn("_part", F.pmod(F.xxhash64("record_id"), F.lit(SALT)).cast("int"))
    found = dealt.join(first, ["refers_to", "_part"], "left").withColumn("refers_to", F.col("_page")).drop("_page", "_part")
    return back.where("refers_to is null").withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(found)


#: DuckDB has no SHA-1 of bytes in base32; tests/llm compares with hashlib.
ORACLE: dict[str, str] = {}
QUERIES = {"op10_arc_to_warc": op10_arc_to_warc}
