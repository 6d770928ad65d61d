"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package has stored (uncompressed) members: archive/data.warc.gz, where each record is a gzip
member of its own, and indexes/index.cdxj with the place of each record in it.  The reader fetches
the end of the file, the central directory (ZIP64 where it is), the local header of a member and the
index; then any range of records, on any executor.

Equal payloads of at least ``min_bytes`` bytes are stored once: the row with the smallest page_id is
a response, the others are revisits that refer to it.

Cases: a null html is an empty payload, a null url an empty target.  Rows with the smallest page_id
of a payload are all responses, if there are several.  A null page_id counts as larger than any
other; if all of a payload's are null, all are responses.  Line ends in urls are written as %0D and
%0A.  An empty table gives no package.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ID = "urn:lineweave:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in a package before the next is begun, and in one range that a task reads.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
SALTS = 16

END, LOCATOR, END64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP header but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "none" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{name}>",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: None if x is None or x.strip("<>")[len(ID) :] == "none" else int(x.strip("<>")[len(ID) :])
    digest = field["warc-payload-digest"].partition(":")[2]
    kind = field["warc-type"]
    if kind == "response":
        size = len(payload)
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload of {field['warc-record-id']} doesn't have its digest")
    else:
        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        payload = None
    return {"page_id": number(field["warc-record-id"]), "url": field["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(field.get("warc-refers-to")), "payload": payload}


class PackageWriter:
    """One package, written front to back."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at = 0
        self.index: list[str] = []

    def add(self, name: int | None, raw: bytes) -> None:
        squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
        packed = squeeze.compress(raw) + squeeze.flush()
        self.data.write(packed)
        self.index.append(f'{"none" if name is None else name} {{"offset": {self.at}, "length": {len(packed)}}}\n')
        self.at += len(packed)

    def close(self) -> int:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            f.write("".join(self.index).encode())
        self.zip.close()
        return len(self.index)


def directory(read_at, size: int) -> dict[str, tuple[int, int, int]]:
    """Of each member: offset of its local header, stored size, compression method.  read_at(n, at)
    gives n bytes from a place; only the directories are read."""
    tail_size = min(size, 22 + 0xFFFF)
    tail = read_at(tail_size, size - tail_size)
    at = tail.rfind(END, 0, max(0, tail_size - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at + 3)
    if at < 0:
        raise ValueError("no ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end_at = size - tail_size + at
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and end_at >= 20:
        locator = read_at(20, end_at - 20)
        if locator[:4] == LOCATOR:
            where = struct.unpack_from("<Q", locator, 8)[0]
            end64 = read_at(56, where)
            if end64[:4] != END64:
                raise ValueError("the ZIP64 directory isn't where it should be")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
    entries = read_at(length, start)
    out, at = {}, 0
    for _ in range(count):
        if entries[at : at + 4] != ENTRY:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        stored, whole = struct.unpack_from("<II", entries, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", entries, at + 28)
        local = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = entries[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, x)
            if tag == 1:  # ZIP64: only the fields that are full above, in this order
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                whole = values.pop(0) if whole == 0xFFFFFFFF else whole
                stored = values.pop(0) if stored == 0xFFFFFFFF else stored
                local = values.pop(0) if local == 0xFFFFFFFF else local
            x += 4 + n
        out[name] = (local, stored, method)
        at += 46 + n_name + n_extra + n_comment
    return out


class Package:
    """Random access to the stored members of a package."""

    def __init__(self, path: str):
        fs, where = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(where)
        self.members = directory(lambda n, at: self.file.read_at(n, at), self.file.size())

    def locate(self, name: str) -> tuple[int, int]:
        """Place and size of a stored member's bytes in the package."""
        local, stored, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} isn't stored as it is")
        head = self.file.read_at(30, local)
        if head[:4] != LOCAL:
            raise ValueError(f"{name} isn't where the directory says")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n_name + n_extra, stored

    def ranges(self, size: int = RANGE_BYTES) -> Iterator[tuple[int, int]]:
        """Ranges of whole records, of about size bytes, as places in the package.  The index is read
        in blocks."""
        data, _ = self.locate(DATA)
        at, total = self.locate(INDEX)
        first = last = 0
        rest = b""
        for block in range(0, total, 1 << 20):
            *lines, rest = (rest + self.file.read_at(min(1 << 20, total - block), at + block)).split(b"\n")
            for line in lines:
                offset, length = (int(x.split(b":")[1].strip(b" }")) for x in line.split(b" ", 1)[1].split(b","))
                if offset != last:
                    raise ValueError("records don't follow each other")
                if last - first >= size:
                    yield data + first, data + last
                    first = last
                last = offset + length
        if last > first:
            yield data + first, data + last


def records_of(package: Package, a: int, b: int) -> Iterator[bytes]:
    """The records of a range, a few hundred KB at a time: each range begins at a record."""
    at, raw = a, b""
    one, parts = zlib.decompressobj(31), []
    while at < b or raw:
        if not raw:
            raw = package.file.read_at(min(1 << 18, b - at), at)
            at += len(raw)
        parts.append(one.decompress(raw))
        raw = one.unused_data if one.eof else b""
        if one.eof:
            yield b"".join(parts)
            one, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("a record ends too early")


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to of the rows whose payload a smaller page_id has too.  A payload that
    many pages share is one row after the first aggregation; its pages meet it in SALTS groups."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes).select("page_id", "digest")
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    first = first.select("digest", "refers_to", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return rows.join(first, ["digest", "salt"]).where("page_id IS NULL OR page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages below folder, and their written manifest: path, n_records.  Each row goes to the task
    of its page_id; a task's packages have a bounded size."""
    spark = pages.sparkSession
    known = revisits(pages, min_bytes)
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    same = p["page_id"].eqNullSafe(known["page_id"]) & (p["digest"] == known["digest"])
    rows = p.join(known, same, "left").select(p["page_id"], "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, where = pafs.FileSystem.from_uri(folder)
        package = out = None
        done = 0

        def close() -> pa.RecordBatch:
            n = package.close()
            out.close()
            name = f"pages-{number:06d}-{done:04d}.wacz"
            fs.move(f"{where}/.{name}.{attempt}", f"{where}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (batch.column(k)[i].as_py() for k in range(4))
                if package is None:
                    fs.create_dir(where, recursive=True)
                    out = fs.open_output_stream(f"{where}/.pages-{number:06d}-{done:04d}.wacz.{attempt}")
                    package = PackageWriter(out)
                package.add(page_id, record(page_id, url or "", html.encode(), refers_to, date))
                if package.at >= package_bytes:
                    yield close()
                    package, done = None, done + 1
        if package is not None:
            yield close()

    written = rows.mapInArrow(run, "path string, n_records long")
    written.write.parquet(f"{folder}/manifest")
    return spark.read.schema(written.schema).parquet(f"{folder}/manifest")


def read_packages(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, and
    payload (null for revisits) unless with_payload is false.  ``packages`` has path; directories
    and indexes are read first, then ranges of records are dealt to all tasks."""

    def list_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                package = Package(path)
                found = list(package.ranges())
                package.file.close()
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(found), pa.string()), "a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
        for batch in batches:
            for row in batch.to_pylist():
                package = Package(row["path"])
                found, held = [], 0
                for raw in records_of(package, row["a"], row["b"]):
                    found.append(parse_record(raw))
                    held += len(raw) if with_payload else 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)], names=names)
                        found, held = [], 0
                package.file.close()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)], names=names)

    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = packages.select("path").mapInArrow(list_ranges, "path string, a long, b long").repartition(parts)
    return ranges.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload)


def op7_warc_zip(spark, sf_dir: str) -> DataFrame:
    packages = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared_dir(spark)}/warc")
    return read_packages(packages, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i * 5 // 4 + 1)::INT, 2))::INT >> (3 - i * 5 % 4)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (hex)
"""
