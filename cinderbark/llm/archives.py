"""WARC records in ZIP packages, read back by range without extraction.

Packages hold stored members: WARC files, whose records are single gzip members,
and an index of the records.  ``read_directory`` parses the end record, the ZIP64 end record where
there is one, and the central directory; ``members`` then says where a member's
bytes lie, and a record is one range read at member offset + record offset.

The writer packs the rows of each task into packages of bounded size in the
folder that the cluster shares.  Names are unique to a task attempt, and the
manifest lists the packages of successful attempts only, so lost executors leave
nothing but unlisted files.  The reader deals packages out to tasks.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, that with
the largest ``page_id`` (null ids last, then the earliest row) is the response,
the others revisit it and carry no payload.  The group's winner is found by an
aggregation before the shuffle, so a payload with very many copies is no hot
key, and only winners of real groups are joined back.

Results.  Null html is an empty payload; null urls have no target.  Null ids are
carried; ``refers_to`` is null for a response.  Repeated rows are records like
others; of ties for the response the earliest row wins.  A very long page has a
package of its own.  Other columns are ignored, whatever their names.  An empty
table gives an empty result.

Packages are opened by address (``file``, ``hdfs``, ``s3``, ``gs``, ``abfs`` and
the Hadoop spellings of these in ``SCHEMES``); other schemes raise an error that
names them.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbark.llm.common import arrow_fields, cut, fresh, new_folder, with_row_id

LEAST_REVISIT = 1000
#: Bytes of compressed WARC records in a package; a larger record has a package of its own.
PACKAGE_BYTES = 32_000_000
WARC_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.cdx"
#: Level at which single records are compressed, as in any ``.warc.gz``.
LEVEL = 3

# Hadoop's names of file systems, and those of the Arrow library.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "wasb": "abfs", "wasbs": "abfss"}

# --- ZIP --------------------------------------------------------------------

# Signatures and layouts of the ZIP format.
_LOCAL = struct.Struct("<4sHHHHHIIIHH")
_CENTRAL = struct.Struct("<4sHHHHHHIIIHHHHHII")
_END = struct.Struct("<4sHHHHIIH")
_END64 = struct.Struct("<4sQHHIIQQQQ")
_LOCATOR = struct.Struct("<4sIQI")
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def write_package(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP file of stored members, with ZIP64 fields throughout."""
    import zlib

    body, central, at = [], [], 0
    for name, data in members:
        raw, crc = name.encode(), zlib.crc32(data)
        sizes = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        local = _LOCAL.pack(b"PK\3\4", 45, 0x800, 0, 0, 0x21, crc, _MAX32, _MAX32, len(raw), len(sizes)) + raw + sizes
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central.append(_CENTRAL.pack(b"PK\1\2", 45, 45, 0x800, 0, 0, 0x21, crc, _MAX32, _MAX32, len(raw), len(extra), 0, 0, 0, 0, _MAX32) + raw + extra)
        body += local, data
        at += len(local) + len(data)
    directory = b"".join(central)
    end64 = _END64.pack(b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(directory), at)
    locator = _LOCATOR.pack(b"PK\6\7", 0, at + len(directory), 1)
    end = _END.pack(b"PK\5\6", 0, 0, min(len(members), _MAX16), min(len(members), _MAX16), min(len(directory), _MAX32), _MAX32, 0)
    return b"".join([*body, directory, end64, locator, end])


def _at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    out = file.read(length)
    if len(out) != length:
        raise ValueError(f"the package ends before byte {offset + length}")
    return out


def read_directory(file, size: int) -> list[Member]:
    """The members that the central directory lists."""
    tail_at = max(0, size - 65_557 - _LOCATOR.size)
    tail = _at(file, tail_at, size - tail_at)
    end_at = tail.rfind(b"PK\5\6")
    if end_at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    _, _, _, _, count, length, start, _ = _END.unpack_from(tail, end_at)
    if end_at >= _LOCATOR.size and tail[end_at - _LOCATOR.size :][:4] == b"PK\6\7":
        _, _, end64_at, _ = _LOCATOR.unpack_from(tail, end_at - _LOCATOR.size)
        signature, _, _, _, _, _, _, count, length, start = _END64.unpack(_at(file, end64_at, _END64.size))
        if signature != b"PK\6\6":
            raise ValueError("the ZIP64 locator points at something else")
    raw, at, out = _at(file, start, length), 0, []
    for _ in range(count):
        signature, _, _, _, method, _, _, _, packed, full, n, m, k, _, _, _, header = _CENTRAL.unpack_from(raw, at)
        if signature != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        name, extra = raw[at + _CENTRAL.size :][:n].decode("utf-8"), raw[at + _CENTRAL.size + n :][:m]
        at += _CENTRAL.size + n + m + k
        while len(extra) >= 4:
            kind, long = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{long // 8}Q", extra, 4))
                full = wide.pop(0) if full == _MAX32 else full
                packed = wide.pop(0) if packed == _MAX32 else packed
                header = wide.pop(0) if header == _MAX32 else header
            extra = extra[4 + long :]
        out.append(Member(name, method, packed, header))
    return out


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = _LOCAL.unpack(_at(file, member.header, _LOCAL.size))
    return member.header + _LOCAL.size + head[9] + head[10]


# --- WARC -------------------------------------------------------------------


#: Pages carry no time of their own.
_DATE = "2000-01-01T00:00:00Z"


def _urn(key: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, key).urn


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(row: dict) -> bytes:
    """One WARC record of a page; a revisit has no payload."""
    payload, kind = row["payload"], row["record_type"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_urn(row['key'])}>", "WARC-Date: " + _DATE]
    if row["url"]:
        head.append("WARC-Target-URI: " + _safe(row["url"]))
    head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    head.append(f"X-Payload-Length: {len(payload)}")
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{_urn(row['first_key'])}>")
        head.append("WARC-Refers-To-Date: " + _DATE)
        if row["first_url"]:
            head.append("WARC-Refers-To-Target-URI: " + _safe(row["first_url"]))
        if row["refers_to"] is not None:
            head.append(f"X-Refers-To-Page: {row['refers_to']}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and its payload; checks lengths and the digest of a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response":
        if len(payload) != int(headers["X-Payload-Length"]) or "sha1:" + hashlib.sha1(payload).hexdigest() != headers["WARC-Payload-Digest"]:
            raise ValueError(f"damaged payload in {headers['WARC-Record-ID']}")
    return headers, payload


def open_system(address: str):
    """(file system, path) of an address as Hadoop writes it."""
    from pyarrow import fs

    scheme, mark, rest = address.partition(":")
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")
    except pa.ArrowInvalid as e:
        raise ValueError(f"packages can't be kept in {scheme!r}; name a folder on file, hdfs, s3, gs or abfs in spark.checkpoint.dir") from e


_MANIFEST = "package string, size bigint, records bigint"


def _writer(folder: str, package_bytes: int):
    def write(batches):
        system, path = open_system(folder)
        records, index, at = [], [], 0

        def flush():
            name = f"{uuid.uuid4().hex}.wacz"
            data = write_package([(WARC_NAME, b"".join(records)), (INDEX_NAME, "".join(index).encode())])
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(data)]), pa.array([len(records)])], schema=arrow_fields(_MANIFEST))

        for b in batches:
            for row in b.to_pylist():
                raw = gzip.compress(record(row), LEVEL, mtime=0)
                if records and at + len(raw) > package_bytes:
                    yield flush()
                    records, index, at = [], [], 0
                records.append(raw)
                index.append(f"{at} {len(raw)}\n")
                at += len(raw)
        if records:
            yield flush()

    return write


def write(pages: DataFrame, least: int = LEAST_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for each page; returns the manifest (package, size, records)."""
    spark = pages.sparkSession
    (row,) = fresh(pages, "row_id")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    whole = with_row_id(pages.select("page_id", "url", "html"), row).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("payload_digest"), F.col(row).alias("row")
    )
    # complements order ids from the largest, and none overflows
    rank = F.struct(F.col("page_id").isNull().alias("n"), F.bitwise_not("page_id").alias("p"), "row", "url")
    narrow = cut(whole.filter(F.octet_length("payload") >= least).select("payload_digest", "page_id", "row", "url"), "payloads")
    winners = narrow.groupBy("payload_digest").agg(F.min(rank).alias("win"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    winners = winners.select("payload_digest", F.col("win.row").alias("first"), F.bitwise_not("win.p").alias("first_page"), F.col("win.url").alias("first_url"))
    joined = whole.join(winners, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.octet_length("payload") >= least) & (F.col("row") != F.col("first"))
    records = joined.select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_page")).alias("refers_to"),
        F.concat_ws("/", F.lit("page"), "row.f", "row.r").alias("key"),
        F.when(revisit, F.concat_ws("/", F.lit("page"), "first.f", "first.r")).alias("first_key"),
        F.when(revisit, F.col("first_url")).alias("first_url"),
    )
    folder = new_folder(spark, "packages")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return cut(records.mapInArrow(_writer(folder, package_bytes), _MANIFEST), "manifest")


_RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _reader(with_payload: bool):
    schema = _RECORDS + (", payload binary" if with_payload else "")

    def read(batches):
        fields = arrow_fields(schema)
        for b in batches:
            for package, size in zip(b.column("package").to_pylist(), b.column("size").to_pylist()):
                system, path = open_system(package)
                with system.open_input_file(path) as file:
                    found = {m.name: m for m in read_directory(file, size)}
                    index, start = found[INDEX_NAME], data_start(file, found[WARC_NAME])
                    lines = _at(file, data_start(file, index), index.size).decode().split("\n")[:-1]
                    for at in range(0, len(lines), 256):
                        columns: list[list] = [[] for _ in fields]
                        for line in lines[at : at + 256]:
                            offset, length = map(int, line.split(" "))
                            h, payload = parse(gzip.decompress(_at(file, start + offset, length)))
                            number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                            values = (number("X-Page-Id"), h.get("WARC-Target-URI"), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], number("X-Refers-To-Page"), payload)
                            for c, v in zip(columns, values):
                                c.append(v)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return schema, read


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all packages; ``with_payload`` adds the payloads of responses."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema, reader = _reader(with_payload)
    return manifest.select("package", "size").repartition(n, "package").mapInArrow(reader, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
