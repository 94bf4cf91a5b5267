"""WARC records in ZIP-packaged archives: written, listed and range-read by Spark tasks.

An archive is a ZIP file with two stored (not deflated) members: ``archive/data.warc.gz``, one gzip
member per WARC record, and ``indexes/index.cdx``, one line ``offset length`` per record with offsets
into the first. The reader parses the end record (ZIP64 too), the central directory and local
headers, finds the members in place, and then reads each record by its range; nothing is extracted.

Archives lie in the folder that driver and executors share, and are opened through
``pyarrow.fs`` by their URI (file, hdfs, s3, gs). Each task attempt writes files of its own new
name, and only names that a finished attempt reports are ever read, so lost tasks leave no trace
in the result. A task holds one record and its archive's index while it writes, and one range while it reads.

Defined cases: a null payload is the empty one; null urls are written as empty; null ids are kept and
never referred to while their group has another id; rows that repeat the id of a response are
responses too; keys are whole numbers, others raise;
an empty table writes no archive and reads back empty; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, integer_key, materialize, new_path

DATE, RECORDS, BYTES, LEVEL, RANGE, SPREAD, TASK = "2024-01-01T00:00:00Z", 4096, 256 << 20, 1, 4 << 20, 256, 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the response ``refers_to`` (HTTP headers only)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; the payload of a response is held against its digest."""
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    name = lambda key: int(x) if (x := fields[key][len("<urn:page:") : -1]) else None
    found = {"page_id": name("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
    if found["record_type"] == "revisit":
        return found | {"payload": None, "refers_to": name("WARC-Refers-To")}
    if len(payload) != size or digest(payload) != found["payload_digest"]:
        raise ValueError(f"payload of record {found['page_id']} is damaged")
    return found | {"payload": payload, "refers_to": None}


def roles(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """(key, url, payload, refers_to): of equal payloads of at least ``least`` bytes the largest key is the response."""
    rows = pages.select(integer_key(pages, key).alias("page_id"), column(url).alias("url"), F.coalesce(column(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    groups = rows.where("same is not null").groupBy("same").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null")
    joined = rows.join(materialize(groups, "warc-groups"), "same", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, per_archive: int = RECORDS) -> DataFrame:
    """Writes rows (page_id, url, payload, refers_to) as archives below ``folder``; returns (archive, records, bytes).

    The result is made once and kept as a table: reading it again writes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        more = next(rows, None)
        while more is not None:
            name, n, at, index = f"{path}/{uuid.uuid4().hex}.zip", 0, 0, io.BytesIO()
            with fs.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                with archive.open(DATA, "w", force_zip64=True) as member:  # records go straight into the open member
                    while more is not None and n < per_archive and (n == 0 or at < BYTES):
                        pack = zlib.compressobj(LEVEL, wbits=31)
                        size = member.write(pack.compress(record(*more)) + pack.flush())
                        index.write(b"%d %d\n" % (at, size))
                        n, at, more = n + 1, at + size, next(rows, None)
                archive.writestr(INDEX, index.getvalue())
            yield row((name, n, at))

    def row(found: tuple[str, int, int]) -> pa.RecordBatch:
        name, n, size = found
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([n]), pa.array([size])], ["archive", "records", "bytes"])

    done = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, records bigint, bytes bigint")
    return materialize(done, "warc-manifest")


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of an open ZIP file: name -> (offset of its bytes, length). Others raise."""
    tail_at = max(0, size - 65_557 - 20)
    tail = read(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (end + 22 > len(tail) or struct.unpack_from("<H", tail, end + 20)[0] != len(tail) - end - 22):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no ZIP end record")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF) and end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
        where = struct.unpack_from("<Q", tail, end - 12)[0]
        wide = read(f, where, 56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record where its locator points")
        count, length, at = struct.unpack_from("<QQQ", wide, 32)
    directory, found, p = read(f, at, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method, packed, plain, n, m, k, local = struct.unpack_from("<10xH8xIIHHH8xI", directory, p)
        name, extra = directory[p + 46 : p + 46 + n].decode(), directory[p + 46 + n : p + 46 + n + m]
        wide = [x == 0xFFFFFFFF for x in (plain, packed, local)]
        while any(wide) and len(extra) >= 4:
            tag, room = struct.unpack_from("<HH", extra)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{sum(wide)}Q", extra, 4))
                plain, packed, local = (next(values) if w else x for w, x in zip(wide, (plain, packed, local), strict=True))
                break
            extra = extra[4 + room :]
        if method != 0:
            raise ValueError(f"member {name} is not stored")
        head = read(f, local, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header for {name}")
        found[name] = local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed
        p += 46 + n + m + k
    return found


def read(f, at: int, length: int) -> bytes:
    f.seek(at)
    data = f.read(length)
    if len(data) != length:
        raise ValueError(f"{length} bytes asked for at {at}, {len(data)} there")
    return data


def list_records(archives: DataFrame) -> DataFrame:
    """(archive, at, length) of every record, from the indexes of the archives; ``at`` counts from the archive's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    found = members(f, f.size())
                    at, length = found[INDEX]
                    lines = [tuple(map(int, x.split())) for x in read(f, at, length).splitlines()]
                if lines:
                    first = found[DATA][0]
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(lines)), pa.array([first + a for a, _ in lines]), pa.array([n for _, n in lines])], ["archive", "at", "length"])

    return archives.select("archive").mapInArrow(run, "archive string, at bigint, length bigint")


RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, payload binary, refers_to bigint"


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of an index; rows that follow each other in an archive are read in ranges of up to ``RANGE`` bytes."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, opened, f, out = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)), None, None, []
            i = size = 0
            while i < len(rows):
                uri, at, length = rows[i]
                j = i + 1
                while j < len(rows) and rows[j][0] == uri and rows[j][1] == at + length and length + rows[j][2] <= RANGE:
                    length += rows[j][2]
                    j += 1
                if opened != uri:
                    if f:
                        f.close()
                    fs, path = pafs.FileSystem.from_uri(uri)
                    opened, f = uri, fs.open_input_file(path)
                data = memoryview(read(f, at, length))
                for _, start, n in rows[i:j]:
                    out.append(parse(zlib.decompress(data[start - at : start - at + n], 31)))
                    size += out[-1]["payload_bytes"]
                    if not payloads:
                        out[-1]["payload"] = None
                i = j
                if size >= 8 << 20:
                    yield columns(out)
                    out, size = [], 0
            if f:
                f.close()
            yield columns(out)

    def columns(out: list[dict]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], k) for n, k in zip(names, kinds, strict=True)], names)

    return index.select("archive", "at", "length").mapInArrow(run, RECORD)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives (archive, records, bytes). Ranges of ``SPREAD`` neighbouring records are dealt over the
    cluster, about ``TASK`` bytes of archives to a task: the index's own bytes, which adaptive execution goes by, tell nothing of that."""
    spark = archives.sparkSession
    size = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("records"), F.lit(0)).alias("records")).first()
    tasks = max(1, -(-size["bytes"] // TASK), min(spark.sparkContext.defaultParallelism, -(-size["records"] // SPREAD)))
    near = F.floor(F.row_number().over(Window.partitionBy("archive").orderBy("at")) / SPREAD)
    index = list_records(archives).withColumn("near", near)
    return read_records(index.repartition(tasks, "archive", "near").sortWithinPartitions("archive", "at"), payloads)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    manifest = write_archives(rows, new_path(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
