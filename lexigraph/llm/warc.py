"""WARC archives: a writer with revisit records and a splittable reader.

Writer: one gzip member per record. Rows with equal payloads form a group; the smallest page_id
is the response, the others are revisits that refer to it and carry no payload of their own (their HTTP
header keeps the length). An empty table gives no files and no records; a very long payload is one record, held whole by the task that writes or reads it; other columns are not read. Null html is the empty payload; a null page_id is written with an empty id and never
serves as a group's response while another id exists. Repeated rows with the smallest id are all responses.

Reader: the files are cut into byte ranges. A task looks for the gzip magic in its range, accepts a candidate
only when it decodes as a whole member (deflate stream, CRC-32, length) that begins a WARC record, and owns
the records that start inside its range, reading past the end for the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, store, table, utf8

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
FILES = "path string, n_records long, n_bytes long"
RECORDS = (
    "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, "
    "refers_to string, payload binary, path string, offset long, sound boolean"
)


def digest32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(kind: str, name: str, uri: str, digest: str, length: int, payload: bytes, refers: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", level: int = 3, file_bytes: int = 64 << 20
) -> DataFrame:
    """Writes the archives below path and returns the table of files. Only the group's key is aggregated;
    a group's rows may be split over tasks, as the join needs one row of the other side."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col), F.lit("")).alias("body"),
    ).withColumn("sha", F.sha1(F.encode("body", "UTF-8")))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    rows = rows.join(first, "sha").select("page_id", "url", "body", "first_id")

    def write(batches):
        out, at, n, size = None, "", 0, 0
        for batch in batches:
            for i, url, body, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    at, n, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs, name = store(at)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                raw = utf8(body)
                again = first_id is not None and i != first_id
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:none"
                data = member(
                    record("revisit" if again else "response", "" if i is None else str(i), uri, digest32(raw), len(raw), b"" if again else raw, str(first_id) if again else None), level
                )
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [at], "n_records": [n], "n_bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [at], "n_records": [n], "n_bytes": [size]})

    # only files in this table count: what a lost task left behind is never read
    return cut(rows.mapInArrow(write, FILES), "warc-files")


def inflate(data: memoryview | bytes, more) -> tuple[bytes, int] | None:
    """The member that begins data, and its stored length; more() gives further bytes, or b"" at the end."""
    z, parts, used = zlib.decompressobj(31), [], 0
    try:
        while True:
            parts.append(z.decompress(data))
            used += len(data)
            if z.eof:
                return b"".join(parts), used - len(z.unused_data)
            if not (data := more()):
                return None
    except zlib.error:
        return None


def parse(raw: bytes) -> dict:
    """A record's fields; sound is false where a length or digest does not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields.setdefault(k.strip().lower(), v.strip())
    stated = fields.get("content-length") or "0"
    length = int(stated) if re.fullmatch("[0-9]{1,18}", stated) else -1  # what is no number is no length, and the record not sound
    block = rest[: max(length, 0)]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
    full = int(said[1]) if said else len(payload)
    sound = len(block) == length
    if kind == "response":
        found = digest32(payload)
        sound, digest, full = sound and found == digest and full == len(payload), found, len(payload)
    bare = lambda x: None if x is None else re.sub(r"^<urn:page:|>$", "", x)
    return {
        "record_id": bare(fields.get("warc-record-id")), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload_bytes": full, "payload_digest": digest,
        "refers_to": bare(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None, "sound": sound,
    }


def records_in(uri: str, start: int, end: int, step: int = 1 << 20):
    """(offset, decoded member) of the records that start in [start, end) of a file."""
    fs, name = store(uri)
    with fs.open_input_file(name) as f:
        whole = f.size()
        at, synced = start, False
        buffer, base = b"", start
        while at < min(end, whole):
            if at < base or at - base + len(MAGIC) > len(buffer):
                f.seek(at)
                buffer, base = f.read(step), at
                if len(buffer) < len(MAGIC):
                    return
            hit = at - base if synced and buffer[at - base : at - base + 3] == MAGIC else buffer.find(MAGIC, at - base)
            if hit < 0:
                synced, at = False, base + len(buffer) - len(MAGIC) + 1
                if base + len(buffer) >= whole:
                    return
                continue
            at = base + hit
            if at >= end:
                return
            f.seek(base + len(buffer))
            found = inflate(buffer[hit:], lambda: f.read(step))
            if found and found[0].startswith(b"WARC/"):
                yield at, found[0]
                at, synced = at + found[1], True
            else:
                at, synced = at + 1, False


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = 8 << 20, payload: bool = True) -> DataFrame:
    """Records of the files in a table with columns path and n_bytes, by byte ranges of split_bytes."""
    splits = files.where("n_bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    names = [x.split()[0] for x in RECORDS.split(", ")]
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64()), ("sound", pa.bool_())])

    def read(batches):
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                for offset, raw in records_in(path, start, start + split_bytes):
                    row = parse(raw) | {"path": path, "offset": offset}
                    if not payload:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"") + 300
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    assert names == schema.names
    n = files.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 1
    return splits.repartition(min(int(n), 10_000), "path", "start").mapInArrow(read, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    back = read_warc(spark, files, payload=False)
    return back.select(
        F.when(F.col("record_id") != "", F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "sound"
    )
