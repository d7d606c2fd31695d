"""Media columns: MPEG transport streams that carry a payload losslessly, and their parser.

Muxer: a PAT, a PMT with one private stream, then the payload cut into access units, each a PES packet with a
90 kHz presentation time stamp; every GOP-th unit is a random-access point with a PCR. Adaptation fields stuff the last packet
of a unit. Demuxer: reads the tables (sections may span packets; their CRC-32/MPEG-2 is checked, and the first sound one counts), follows the program's stream, checks continuity
counters, strips the PES headers and returns payload, time stamps and random-access points. Packets are handled as
matrices of 188 columns. Damaged packets, headers and tables are counted as lost, never raised. Null and empty texts carry 64 zero bytes; a stream of any length is handled unit by
unit. Repeated rows and ids get each its own, equal result; an empty table gives an empty one. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_blocks, table, utf8

PACKET, SYNC, PMT_PID, ES_PID = 188, 0x47, 0x1000, 0x0100
TICK, UNIT, GOP = 3600, 16384, 4


def crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        out.append(c)
    return out


CRC = crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def section(table_id: int, ident: int, body: bytes) -> bytes:
    raw = bytes([table_id, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255]) + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return raw + crc_mpeg(raw).to_bytes(4, "big")


def psi(pid: int, raw: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return np.frombuffer((head + raw).ljust(PACKET, b"\xff"), np.uint8)


PAT = psi(0, section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = psi(PMT_PID, section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def stamp(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 14, t >> 22 & 255, 1 | t >> 14 & 254, t >> 7 & 255, 1 | t << 1 & 254])


def mux(payload: bytes) -> bytes:
    """payload as a transport stream."""
    out, counter = [PAT[None], PMT[None]], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        t = k * TICK
        # the length field counts what follows it: 3 flag bytes, the stamp, the data
        pes = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(t) + data
        if k % GOP == 0:
            field = bytes([7, 0x50]) + (t << 15 | 0x7E00).to_bytes(6, "big")  # random access, PCR; reserved bits are set
        else:
            field = b""
        body = np.frombuffer(pes, np.uint8)
        first = min(len(body), 184 - len(field))
        rest = len(body) - first
        n = 1 + -(-rest // 184)
        m = np.empty((n, PACKET), np.uint8)
        m[:, 0], m[:, 1], m[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        m[0, 1] |= 0x40
        m[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        if n > 2:
            m[1:-1, 4:] = body[first : first + (n - 2) * 184].reshape(-1, 184)
        for i, lo, hi, af in {0: (0, 0, first, field), n - 1: (n - 1, first + max(0, n - 2) * 184, len(body), b"")}.values() if n > 1 else [(0, 0, first, field)]:
            room = 184 - (hi - lo)
            if room:  # an adaptation field of exactly room bytes
                af = af or (b"\x00" if room == 1 else bytes([room - 1, 0]))
                af = bytes([room - 1]) + af[1:].ljust(room - 1, b"\xff") if room > 1 else b"\x00"
                m[i, 3] |= 0x20
                m[i, 4 : 4 + room] = np.frombuffer(af, np.uint8)
            m[i, 4 + room :] = body[lo:hi]
        out.append(m)
    return np.concatenate(out).tobytes()


def sections(m: np.ndarray, pid: np.ndarray, at: int):
    """The sections that packets of a PID carry, each until its length is reached."""
    held = b""
    for row in m[pid == at]:
        raw = row.tobytes()
        lo = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        if not raw[3] & 0x10 or lo >= PACKET:
            continue
        if raw[1] & 0x40:  # a section begins after what the pointer skips, which belongs to the one before
            begin = lo + 1 + raw[lo]
            yield held + raw[lo + 1 : begin]
            held = raw[begin:]
        elif held:
            held += raw[lo:]
    yield held


def body(m: np.ndarray, pid: np.ndarray, at: int, kind: int) -> tuple[bytes, bool] | None:
    """What stands in the first sound section of a table, else in the first whole one, and whether its checksum holds."""
    spare = None
    for raw in sections(m, pid, at):
        n = 3 + ((raw[1] & 15) << 8 | raw[2]) if len(raw) >= 3 else 0
        if n < 12 or len(raw) < n or raw[0] != kind:
            continue
        if crc_mpeg(raw[:n]) == 0:
            return raw[8 : n - 4], True
        spare = spare or (raw[8 : n - 4], False)
    return spare


def tables(m: np.ndarray, pid: np.ndarray) -> tuple[int | None, int, bool]:
    """The first program's elementary PID, its stream type, and whether both tables' checksums hold."""
    pat = body(m, pid, 0, 0)
    for k in range(0, len(pat[0]) - 3, 4) if pat else ():
        if pat[0][k : k + 2] != b"\x00\x00":
            pmt = body(m, pid, (pat[0][k + 2] & 31) << 8 | pat[0][k + 3], 2)
            at = 4 + ((pmt[0][2] & 15) << 8 | pmt[0][3]) if pmt and len(pmt[0]) >= 4 else 0
            if at and len(pmt[0]) >= at + 5:
                return (pmt[0][at + 1] & 31) << 8 | pmt[0][at + 2], pmt[0][at], pat[1] and pmt[1]
    return None, 0, False


def demux(media: bytes) -> dict:
    """Payload, time stamps and random-access points (index of the unit) of a transport stream, with what its checks found. A packet without the sync byte is lost, and so is a
    unit whose header is not whole."""
    m = np.frombuffer(media, np.uint8)[: len(media) // PACKET * PACKET].reshape(-1, PACKET)
    synced = m[:, 0] == SYNC
    lost, packets, m = int((~synced).sum()), len(m), m[synced]
    pid = (m[:, 1].astype(np.int32) & 31) << 8 | m[:, 2]
    es, kind, crc_ok = tables(m, pid)
    s = m[pid == es] if es is not None else m[:0]
    has_field, has_data = s[:, 3] & 0x20 > 0, s[:, 3] & 0x10 > 0
    s, has_field = s[has_data], has_field[has_data]
    counter = s[:, 3] & 15
    jumps = int(((counter[1:] - counter[:-1]) & 15 != 1).sum())
    skip = np.minimum(np.where(has_field, 5 + s[:, 4].astype(np.int64), 4), PACKET)
    data = s[np.arange(PACKET)[None] >= skip[:, None]]
    ends = np.cumsum(PACKET - skip)
    starts = np.flatnonzero(s[:, 1] & 0x40)
    raw, parts, pts, points, pcr = data.tobytes(), [], [], [], []
    at = (ends - (PACKET - skip))[starts].tolist() + [len(raw)]
    for k, row in enumerate(starts.tolist()):
        lo, hi = at[k], at[k + 1]
        if hi - lo < 9 or raw[lo : lo + 3] != b"\x00\x00\x01":
            lost += 1
            continue
        n, head = raw[lo + 4] << 8 | raw[lo + 5], raw[lo + 8]
        lost += n > 0 and hi < lo + 6 + n  # cut short
        hi = min(hi, lo + 6 + n) if n else hi
        if raw[lo + 7] & 0x80 and head >= 5 and lo + 14 <= hi:
            p = raw[lo + 9 : lo + 14]
            pts.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        parts.append(raw[lo + 9 + head : hi])
        if has_field[row] and s[row, 4] and s[row, 5] & 0x40:
            points.append(k)
            if s[row, 5] & 0x10 and s[row, 4] >= 7:
                pcr.append(int.from_bytes(s[row, 6:12].tobytes(), "big") >> 15)
    return {"payload": b"".join(parts), "pts": pts, "points": points, "pcr": pcr, "packets": packets, "pid": es or 0, "stream_type": kind, "crc_ok": crc_ok, "jumps": jumps, "lost": int(lost)}


def padded(text: str | None) -> tuple[int, bytes]:
    raw = utf8(text)
    return len(raw), raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) per row."""
    def run(batches):
        for b in in_blocks(batches, 8 << 20):
            made = [padded(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([mux(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, access_points array<int>"


def media_features(media: DataFrame) -> DataFrame:
    """Parses the media column and adds what is read back from it. feature: stream type, packets, units, time span, random-access
    points, counter jumps, table check, and the mean and share of ASCII letters of the samples."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches):
        for b in in_blocks(batches, 8 << 20, "media"):
            rows = {k: [] for k in names}
            for media_bytes in b.column(2):
                raw = media_bytes.as_buffer().to_pybytes()
                x = demux(raw)
                p = x["payload"]
                samples = np.frombuffer(p, np.uint8)
                low = samples | 32
                letters = int(((low >= 97) & (low <= 122)).sum())
                values = (
                    len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(raw), hashlib.sha256(raw).hexdigest(),
                    f"type={x['stream_type']};packets={x['packets']};units={len(x['pts'])};span={(max(x['pts']) - min(x['pts'])) if x['pts'] else 0};points={len(x['points'])};pcr={len(x['pcr'])};jumps={x['jumps']};lost={x['lost']};"
                    f"tables={'ok' if x['crc_ok'] else 'bad'};mean={samples.mean() if len(samples) else 0:.3f};letters={letters / max(1, len(samples)):.4f}",
                    x["pts"], x["points"],
                )
                for k, v in zip(names, values, strict=True):
                    rows[k].append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(rows[k], t) for k, t in zip(names, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return media.mapInArrow(run, "doc_id long, n_bytes long, " + FEATURES)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(to_media(table(spark, sf_dir, "documents")), "media")
    return media_features(stored)
