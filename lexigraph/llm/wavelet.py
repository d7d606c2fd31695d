"""Token ids as wavelet matrices: one compressed file a shard, with access, rank, select and occurrence lookup.

A matrix holds a sequence of ids as bit-planes from the top bit down, each plane's order being that of the plane above with zeros moved
to the front (stable). Planes are stored in blocks, each compressed by itself, with a directory of the ones before every block; rank adds a popcount within the block, select
searches directory and block. Access walks down the planes; counting narrows an interval; the k-th occurrence walks back up: each reads one or two blocks a plane and
no more of the file. A file also has its documents' ids and sizes, so that it is read alone.

Rows are dealt by ranges of doc_id and sorted (nulls first, repeated ids by text), so the shards in order hold the documents in ascending
order. A null or empty text is its end id alone. A shard holds whole documents, as many as fit in `shard` ids and always one.
Equal rows are documents of their own, one after the other. An empty table gives no file and no row; a very long text is read in pieces; other columns are not read.
"""

from __future__ import annotations

import contextlib
import struct
import unicodedata
import uuid
import zlib
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, in_blocks, new_path, store, table

MAGIC = b"WVM2"
END, SEP = 0, "\ud800"
U64, BASE, LONG = np.uint64, 0x9E3779B97F4A7C15, 200
BLOCK = 1 << 18


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def classes() -> np.ndarray:
    """Class of every code point: 0 letter, 1 number, 2 white space, 3 other, 4 left to the library (its Unicode version may differ), 5 end of a text."""
    out = np.full(0x110000, 4, np.uint8)
    for lo, hi in ((0, 0x0530), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2190, 0x2200), (0x3000, 0x3100), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)):
        for c in range(lo, hi):
            kind = unicodedata.category(chr(c))
            out[c] = {"L": 0, "N": 1, "C": 3}.get(kind[0], 3) if kind != "Cn" else 4
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 2
    out[0xD800] = 5
    return out


class Pieces:
    """Token ids of up to `most` pieces by 64-bit hash: an open table of twice as many places or more, allocated once. Row 0 is the end id."""

    def __init__(self, most: int, kind):
        self.most, self.bits = most, max(4, (2 * most - 1).bit_length())
        self.key, self.row = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32)
        self.size, self.start, self.flat = np.ones(most + 1, np.int64), np.zeros(most + 1, np.int64), np.full(4 * most, END, kind)
        self.n, self.used = 1, 1

    def reset(self):
        self.key[:] = 0
        self.n, self.used = 1, 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of the hashes, -1 where there is none."""
        at, out, open_ = (h >> U64(64 - self.bits)).astype(np.int64), np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(open_):
            k = self.key[at[open_]]
            hit = k == h[open_]
            out[open_[hit]] = self.row[at[open_[hit]]]
            open_ = open_[~hit & (k != 0)]
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> bool:
        """Keeps new, distinct hashes with their ids, one after the other; false if there is no room."""
        if self.n + len(h) > self.most + 1 or self.used + len(ids) > len(self.flat):
            return False
        rows = self.n + np.arange(len(h))
        self.size[rows], self.start[rows] = size, self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(h), self.used + len(ids)
        at, open_ = (h >> U64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(open_):
            free = open_[self.key[at[open_]] == 0]
            self.key[at[free]] = h[free]  # of several for one place the last stays
            kept = self.key[at[open_]] == h[open_]
            self.row[at[open_[kept]]] = rows[open_[kept]]
            open_ = open_[~kept]
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
        return True


class Encoder:
    """ids of many texts at once. Texts are cut where the tokenizer's own pre-tokenizer cuts; each distinct piece of text goes through the library once
    (as long as it is kept). What comes out is turned back into bytes and compared, so that a hash shared by two pieces cannot give wrong ids. Texts with rare scripts, very
    long pieces or a special token's string, and all texts of a tokenizer that cuts otherwise, go through the library whole."""

    def __init__(self, path: str, most: int = 1_200_000):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.split = Tokenizer.from_file(path), Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        first = made.get("pre_tokenizer") or {}
        self.fast = (first.get("type"), first.get("add_prefix_space"), first.get("use_regex", True), made.get("normalizer"), made["model"]["type"]) == ("ByteLevel", False, True, None, "BPE")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bits = max(1, (size - 1).bit_length())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not self.fast:
            return
        self.split.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kind = classes()
        self.powers = self.inverse = np.zeros(0, U64)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves; the others are moved past 255 in order
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        raw = [b""] * size
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            raw[i] = bytes(byte[c] for c in piece)
        self.width = np.array([len(x) for x in raw], np.int64)
        self.begin, self.raw = np.cumsum(self.width) - self.width, np.frombuffer(b"".join(raw), np.uint8)
        self.pieces = Pieces(most, np.uint16 if self.bits <= 16 else np.uint32)

    def hashes(self, codes: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each piece, never 0, from running sums of a polynomial."""
        if len(self.powers) < len(codes) + 1:
            n = len(codes) * 5 // 4 + 1
            self.powers, self.inverse = (np.cumprod(np.r_[U64(1), np.full(n, U64(b))]) for b in (BASE, pow(BASE, -1, 1 << 64)))
        with np.errstate(over="ignore"):
            x = codes.astype(U64) + U64(1)
            x = (x ^ (x << U64(21))) * U64(0xD6E8FEB86659FD93)
            sums = np.r_[U64(0), np.cumsum((x ^ (x >> U64(32))) * self.powers[: len(codes)])]
            h = (sums[ends] - sums[at]) * self.inverse[at] + (ends - at).astype(U64)
            h = (h ^ (h >> U64(32))) * U64(0x9E3779B97F4A7C15)
            h ^= h >> U64(29)
            return np.maximum(h, U64(1))

    def cuts(self, codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pieces begin, for texts that each end in SEP."""
        begins = np.r_[True, kind[1:] != kind[:-1]] | (kind == 5)
        space = kind == 2
        after_blank = np.r_[False, codes[:-1] == 32]
        out = begins & ~(after_blank & (kind != 2) & (kind != 5))
        # a run's last white space stands apart from the rest of the run if text follows
        last = space & np.r_[(kind[1:] != 2) & (kind[1:] != 5), False]
        out |= last
        quote = np.flatnonzero((codes == 39) & begins & ~after_blank & np.r_[kind[1:] == 0, False])
        if len(quote):
            a = codes[quote + 1]
            b = codes[np.minimum(quote + 2, len(codes) - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for which, n in ((one, 2), (two, 3)):
                q = quote[which]
                out[q + 1] = False
                out[q + n] |= kind[q + n] == 0
        return np.flatnonzero(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text, END last."""
        out: list = [None] * len(texts)
        rest = [i for i, x in enumerate(texts) if self.fast and not any(s in x for s in self.special)]
        while rest:
            cat = "".join(x for i in rest for x in (texts[i], SEP))
            codes = np.frombuffer(cat.encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = self.kind[codes]
            at = self.cuts(codes, kind)
            ends = np.r_[at[1:], len(codes)]
            stops = np.flatnonzero(kind == 5)
            odd = set(np.searchsorted(stops, np.r_[np.flatnonzero(kind == 4), at[ends - at > LONG]]).tolist())
            if odd:
                rest = [i for k, i in enumerate(rest) if k not in odd]
                continue
            flat, stop = self.ids(cat, codes, kind, at, ends)
            if flat is not None:
                for i, lo, hi in zip(rest, np.r_[0, stop[:-1]].tolist(), stop.tolist(), strict=True):
                    out[i] = flat[lo:hi]
            break
        return [self.whole(x) if y is None else y for x, y in zip(texts, out, strict=True)]

    def ids(self, cat: str, codes: np.ndarray, kind: np.ndarray, at: np.ndarray, ends: np.ndarray):
        """(ids of all pieces, where each text ends in them), or nothing if they do not give the texts back."""
        p, last = self.pieces, kind[at] == 5
        h = self.hashes(codes, at, ends)
        h[last] = 0
        row = p.find(h)
        row[last] = 0
        missing = np.flatnonzero(row < 0)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            strings = [cat[a:b] for a, b in zip(at[missing[first]].tolist(), ends[missing[first]].tolist(), strict=True)]
            found = self.split.encode_batch_fast([strings[k : k + 1000] for k in range(0, len(strings), 1000)], is_pretokenized=True, add_special_tokens=False)
            made = np.concatenate([np.array(x.ids, p.flat.dtype) for x in found])
            # a piece's tokens have as many bytes as it
            stop = np.searchsorted(np.cumsum(self.width[made]), np.cumsum([len(x.encode()) for x in strings])) + 1
            if not p.add(new, made, np.diff(np.r_[0, stop])):
                if p.n == 1:
                    return None, None
                p.reset()
                return self.ids(cat, codes, kind, at, ends)
            row[missing] = p.n - len(new) + back
        size = p.size[row]
        total = np.cumsum(size)
        flat = p.flat[np.repeat(p.start[row] - (total - size), size) + np.arange(total[-1])]
        stop = total[last]
        width = self.width[flat]
        width[stop - 1] = 0
        total = np.cumsum(width)
        raw = np.frombuffer(cat.replace(SEP, "").encode(), np.uint8)
        same = total[-1] == len(raw) and bool((self.raw[np.repeat(self.begin[flat] - (total - width), width) + np.arange(total[-1])] == raw).all())
        return (flat, stop) if same else (None, None)

    def whole(self, text: str) -> np.ndarray:
        return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], np.uint32)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One a worker process, whose tasks share the pieces."""
    return Encoder(path)


HEAD = struct.Struct("<qii")  # ids, bits, block


class WaveletMatrix:
    """A sequence of unsigned ids below 2**bits, in its stored form. The directory (zeros of each plane; per block of a plane its place, its bytes and the ones before it) is read at
    once, blocks of planes as they are asked for; up to `most` stay decompressed."""

    def __init__(self, read, at: int = 0, most: int = 256):
        self.read, self.most, self.held = read, most, OrderedDict()
        self.n, self.bits, self.block = HEAD.unpack(read(at, HEAD.size))
        blocks = -(-self.n // self.block)
        raw = read(at + HEAD.size, self.bits * (8 + 20 * blocks))
        self.zeros = np.frombuffer(raw, "<i8", self.bits)
        self.before, self.place = np.frombuffer(raw, "<i8", 2 * self.bits * blocks, 8 * self.bits).reshape(2, self.bits, blocks)
        self.stored = np.frombuffer(raw, "<i4", self.bits * blocks, (8 + 16 * blocks) * self.bits).reshape(self.bits, blocks)
        self.base = at + HEAD.size + len(raw)

    @staticmethod
    def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
        """The stored form. Planes from the top bit down; each plane's order is that of the plane above with its zeros moved to the front."""
        import zstandard

        z = zstandard.ZstdCompressor(level=1, write_checksum=True)
        now, zeros, before, parts = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], [], []
        for b in range(bits - 1, -1, -1):
            on = (now & now.dtype.type(1 << b)) != 0
            ones = np.add.reduceat(on, np.arange(0, len(on), block), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
            before.append(np.cumsum(ones) - ones)
            plane = np.packbits(on, bitorder="little").tobytes()
            parts += [z.compress(plane[k : k + block // 8]) for k in range(0, len(plane), block // 8)]
            low, high = np.flatnonzero(~on), np.flatnonzero(on)
            zeros.append(len(low))
            now = np.concatenate([now.take(low), now.take(high)])
        stored = np.array([len(x) for x in parts], "<i4")
        place = np.cumsum(stored, dtype=np.int64) - stored
        return HEAD.pack(len(ids), bits, block) + np.array(zeros, "<i8").tobytes() + np.array(before, "<i8").tobytes() + place.astype("<i8").tobytes() + stored.tobytes() + b"".join(parts)

    @classmethod
    def of(cls, raw: bytes) -> WaveletMatrix:
        return cls(lambda at, n: raw[at : at + n])

    def raw(self, plane: int, block: int) -> bytes:
        """Bits of one block."""
        import zstandard

        n = min(self.block, self.n - block * self.block)
        return zstandard.ZstdDecompressor().decompress(self.read(self.base + int(self.place[plane, block]), int(self.stored[plane, block])), max_output_size=-(-n // 8))

    def words(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bits in words of 64, one more at the end, and the ones of the plane before each word."""
        key = plane, block
        if key not in self.held:
            raw = self.raw(plane, block)
            words = np.frombuffer(raw.ljust((len(raw) // 8 + 1) * 8, b"\0"), "<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.held[key] = words, self.before[plane, block] + np.cumsum(ones) - ones
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]

    def look(self, plane: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits of a plane at the places i, ones before them)."""
        bit, rank = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        block = i // self.block
        for k in np.unique(block).tolist():
            here = np.flatnonzero(block == k)
            if k * self.block == self.n:  # the end, if it begins a block
                rank[here] = self.n - self.zeros[plane]
                continue
            words, before = self.words(plane, k)
            w, b = np.divmod(i[here] - k * self.block, 64)
            x, b = words[w], b.astype(U64)
            bit[here] = (x >> b & U64(1)).astype(np.int64)
            rank[here] = before[w] + np.bitwise_count(x & ((U64(1) << b) - U64(1)))
        return bit, rank

    def access(self, i) -> np.ndarray:
        """The ids at the places i."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        value = np.zeros(len(i), np.int64)
        for p in range(self.bits):
            bit, rank = self.look(p, i)
            i = np.where(bit == 1, self.zeros[p] + rank, i - rank)
            value = value << 1 | bit
        return value

    def interval(self, value: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the value's entries of [lo, hi) stand below the last plane."""
        for p in range(self.bits):
            a, b = self.look(p, lo)[1], self.look(p, hi)[1]
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if value >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo=0, hi=None) -> np.ndarray:
        """How often the value stands in each [lo, hi)."""
        lo, hi = (np.atleast_1d(np.asarray(x, np.int64)) for x in (lo, self.n if hi is None else hi))
        if value >> self.bits or not self.n:
            return np.zeros(len(lo), np.int64)
        a, b = self.interval(value, lo, hi)
        return b - a

    def select(self, plane: int, k: int, one: bool) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        seen = self.before[plane] if one else np.arange(len(self.before[plane])) * self.block - self.before[plane]
        block = int(np.searchsorted(seen, k, side="right")) - 1
        words, before = self.words(plane, block)
        seen = before if one else block * self.block + np.arange(len(words)) * 64 - before
        w = int(np.searchsorted(seen, k, side="right")) - 1
        bits = np.unpackbits(words[w : w + 1].view(np.uint8), bitorder="little")
        return block * self.block + w * 64 + int(np.flatnonzero(bits == one)[k - int(seen[w])])

    def occurrence(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence, -1 if there are fewer."""
        if value >> self.bits or not self.n:
            return -1
        (lo,), (hi,) = self.interval(value, np.zeros(1, np.int64), np.full(1, self.n))
        if not 0 <= k < hi - lo:
            return -1
        i = int(lo) + k
        for p in range(self.bits - 1, -1, -1):
            one = bool(value >> (self.bits - 1 - p) & 1)
            i = self.select(p, i - int(self.zeros[p]) if one else i, one)
        return i

    def all(self) -> np.ndarray:
        """The whole sequence, by undoing the planes from the last."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            raw = b"".join(self.raw(p, k) for k in range(self.stored.shape[1]))
            on = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            z = int(self.zeros[p])
            up = np.empty_like(now)
            up[np.flatnonzero(~on)] = now[:z]
            up[np.flatnonzero(on)] = now[z:] | now.dtype.type(1 << (self.bits - 1 - p))
            now = up
        return now


def shard_bytes(doc_ids: list, sizes: list[int], ids: np.ndarray, bits: int) -> bytes:
    """A file: mark, CRC-32 and number of the documents, their ids and sizes, the matrix."""
    names = np.array([-(1 << 63) if i is None else i for i in doc_ids], "<i8").tobytes()
    head = struct.pack("<q", len(doc_ids)) + names + np.array(sizes, "<i8").tobytes()
    return MAGIC + struct.pack("<I", zlib.crc32(head)) + head + WaveletMatrix.pack(ids, bits)


def read_shard(read) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Document ids, ids of each document, and the matrix of a file; read(at, size) gives its bytes."""
    head = read(0, 16)
    if head[:4] != MAGIC:
        raise ValueError("not a shard file")
    n = struct.unpack_from("<q", head, 8)[0]
    names = read(16, 16 * n)
    if zlib.crc32(head[8:] + names) != struct.unpack_from("<I", head, 4)[0]:
        raise ValueError("a damaged shard file")
    ids, sizes = np.frombuffer(names, "<i8").reshape(2, n)
    return [None if i == -(1 << 63) else i for i in ids.tolist()], sizes, WaveletMatrix(read, 16 + 16 * n)


@contextlib.contextmanager
def open_shard(uri: str):
    """read_shard of a file on any store; only what is asked for is read."""
    fs, name = store(uri)
    with fs.open_input_file(name) as f:
        def read(at: int, size: int) -> bytes:
            f.seek(at)
            return f.read(size)

        yield read_shard(read)


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, shard: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the texts and writes the files below path: the table (path, part, number, n_docs, n_tokens), in order of (part, number)."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        coder, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list = []

        def flush():
            sizes = [len(x) for _, x in held]
            at = f"{path}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.wvm"
            fs, name = store(at)
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(name, compression=None) as f:
                f.write(shard_bytes([i for i, _ in held], sizes, np.concatenate([x for _, x in held]), coder.bits))
            return pa.RecordBatch.from_pydict({"path": [at], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_docs": [len(held)], "n_tokens": [sum(sizes)]})

        total = 0
        for b in in_blocks(batches, 1 << 19):
            for i, x in zip(b.column(0).to_pylist(), coder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                if held and total + len(x) > shard:
                    yield flush()
                    held, total, number = [], 0, number + 1
                held.append((i, x))
                total += len(x)
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return cut(dealt.mapInArrow(run, "path string, part int, number int, n_docs long, n_tokens long"), "shard-files")


def read_documents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Per document, from the files: where its ids start among all, how many, their CRC-32, the first of them and how many equal END (by rank)."""
    sizes = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one number a task of the writer
    base, at = {}, 0
    for p in sorted(sizes):
        base[p] = at
        at += sizes[p]
    here = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    spread = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(here), F.lit(0).cast("long"))).select("path", "part", "before")
    n = files.count()

    def run(batches):
        for b in batches:
            for path, part, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open_shard(path) as (ids, sizes, matrix):
                    flat, ends = matrix.all().astype("<u4"), np.cumsum(sizes)
                    first, zeros = matrix.access(ends - sizes), matrix.count(END, ends - sizes, ends)
                raw = memoryview(flat.tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                cols = [pa.array(ids, pa.int64()), *map(pa.array, (base[part] + before + ends - sizes, sizes)), pa.array(crc, pa.int64()), *map(pa.array, (first, zeros))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "first_id", "n_end_ids"])

    return spread.repartition(max(1, min(n, 10_000)), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, n_end_ids long")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_shards(table(spark, sf_dir, "documents"), new_path(spark, "tokens"))
    return read_documents(spark, files)
