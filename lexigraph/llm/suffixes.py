"""Exact substring de-duplication with suffix arrays by induced sorting.

A byte goes when it is covered by a string of `length` bytes that also starts earlier (smaller id, or same document and earlier start), anywhere in
the input. Every window of that length is owned by one anchor, the smallest of its k-gram hashes; equal windows own equal anchors, so they
meet under the anchor's hash. A run of windows with one anchor travels as one row (anchor, hash of the run's bytes): equal runs need nothing else,
and an anchor whose runs are all equal is done. What is left, anchors with different runs around them, forms the shards: their bytes go
through suffix sorting (suffixes classified, leftmost-smaller substrings named by 64-bit hashes and sorted by prefix doubling, the rest induced), common prefixes in text order tell
neighbours that share a window, and in each class of equal windows all but the earliest go.

Rows equal within a block of input are combined before the shuffle, so a passage in a third of all documents sends a row a block. An anchor with more
than `most` different runs is dealt out by window hashes instead, which combine before their shuffle too; its result is the same.

Null texts are empty; texts shorter than `length` lose nothing; long ones are cut into runs like any others. Repeated ids are ordered by text and null ids come last; both are numbered
anew first. Equal rows are copies like any others, ties fall to the order of rows. An empty table gives an empty one. Other columns are kept by the stage and may have any name but the
ones that begin with __lexigraph_seq.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_blocks, table, trim, utf8

GRAM = 24
U64 = np.uint64
TABLE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
MULTIPLIER = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of the k bytes from each place."""
    with np.errstate(over="ignore"):
        n, h, width, total, used = len(raw) - k + 1, TABLE[raw], 1, None, 0
        while width <= k:  # the hash over k bytes is put together from those over its powers of two, smallest first
            if k & width:
                part = h[used : used + n]
                total = part.copy() if total is None else total * U64(pow(MULTIPLIER, width, 1 << 64)) + part
                used += width
            if width * 2 <= k:
                h = h[:-width] * U64(pow(MULTIPLIER, width, 1 << 64)) + h[width:]
            width *= 2
        total ^= total >> U64(32)
        total *= U64(0xD6E8FEB86659FD93)
        total ^= total >> U64(29)
        return total


def window_runs(raw: np.ndarray, ends: np.ndarray, length: int = 100, k: int = GRAM):
    """(start, number of windows, anchor hash, anchor's place) of each run in texts that end at `ends`; places are those of raw."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    h = gram_hashes(raw, k)
    bits = U64(max(1, int(len(h)).bit_length()))
    least = (h >> bits << bits) | np.arange(len(h), dtype=U64)
    width, size = 1, length - k + 1
    while width * 2 <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(raw) - length + 1
    least = np.minimum(least[:n], least[size - width : size - width + n])
    at = (least & U64((1 << int(bits)) - 1)).astype(np.int64)
    end = np.repeat(ends, np.diff(np.r_[0, ends]))[:n]
    good = np.arange(n) + length <= end
    first = np.flatnonzero(good & np.r_[True, (at[1:] != at[:-1]) | ~good[:-1]])
    last = np.flatnonzero(good & np.r_[(at[1:] != at[:-1]) | ~good[1:], True])
    return first, last - first + 1, h[at[first]], at[first]


def deal(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each value its place among equals, in order, on top of at[value]."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    place = np.empty(len(v), np.int64)
    place[order] = np.arange(len(v)) - np.repeat(first, np.diff(np.r_[first, len(v)]))
    return at[values] + place


def induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Suffixes in order, induced from the leftmost-smaller ones (seeds) in theirs. Buckets are scanned as in the linear algorithm, a stretch of known
    entries at a time."""
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(len(s), -1)
    seed_counts = np.bincount(s[seeds], minlength=len(counts))
    sa[deal(s[seeds], ends - seed_counts)] = seeds
    present = np.flatnonzero(counts).tolist()
    heads = starts.copy()

    def forward(batch):
        j = batch - 1
        j = j[j >= 0]
        j = j[~small[j]]
        if len(j):
            c = s[j]
            sa[deal(c, heads)] = j
            np.add.at(heads, c, 1)

    for c in present:
        at = int(starts[c])
        while at < heads[c]:
            to = int(heads[c])
            forward(sa[at:to])
            at = to
        forward(sa[ends[c] - seed_counts[c] : ends[c]])
    tails = ends.copy()

    def backward(batch):
        j = batch[::-1] - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            c = s[j]
            sa[2 * tails[c] - 1 - deal(c, tails)] = j
            np.subtract.at(tails, c, 1)

    for c in reversed(present):
        at = int(ends[c])
        while at > tails[c]:
            to = int(tails[c])
            backward(sa[to:at])
            at = to
        backward(sa[starts[c] : heads[c]])
    if small[-1]:
        sa[0] = len(s) - 1  # the end mark has no right neighbour to be induced from
    return sa


def doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a reduced string, whose alphabet is about as large as the string: ranks by doubling."""
    rank, step = names.astype(np.int64), 1
    while True:
        nxt = np.r_[rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)][: len(rank)]
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.r_[0, np.cumsum(k[1:] != k[:-1])]
        rank = np.empty_like(rank)
        rank[order] = new
        if new[-1] == len(rank) - 1 or step > len(rank):
            return order
        step *= 2


def suffix_array(s, sigma: int) -> np.ndarray:
    """Suffixes of s in order, by induced sorting; s ends in a 0 that stands nowhere else. The leftmost-smaller substrings are ordered by a first induction and
    named; the string of names is sorted in turn, and its order induces that of all suffixes."""
    s = np.asarray(s, np.int64)
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    differ = np.flatnonzero(s[1:] != s[:-1])  # a suffix is smaller than its neighbour if the next different symbol is larger
    nxt = np.searchsorted(differ, np.arange(n - 1))
    at = differ[np.minimum(nxt, len(differ) - 1)]
    small = np.r_[s[at] < s[at + 1], True]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(s, minlength=sigma)
    if len(lms) == 1:
        return induce(s, small, lms, counts)
    by_name = induce(s, small, lms, counts)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_name = by_name[is_lms[by_name]]
    following = np.full(n, n)
    following[lms] = np.r_[lms[1:] + 1, n]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[U64(1), np.full(n, U64(MULTIPLIER))])
        x = s.astype(U64) + U64(1)
        x = (x ^ (x << U64(29))) * U64(0xD6E8FEB86659FD93)
        sums = np.r_[U64(0), np.cumsum((x ^ (x >> U64(32))) * power[:n])]
        a, b = by_name, following[by_name]
        h = (sums[b] - sums[a])
        # equal substrings have hashes that differ by the power of their distance
        same = (b[1:] - a[1:] == b[:-1] - a[:-1]) & (h[1:] * power[np.maximum(0, a[:-1] - a[1:])] == h[:-1] * power[np.maximum(0, a[1:] - a[:-1])])
    name = np.zeros(n, np.int64)
    name[by_name] = np.r_[0, np.cumsum(~same)]
    names = name[lms]
    return induce(s, small, lms[doubled(names)], counts)


def common_prefixes(raw: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """In text order (permuted): the common prefix of each suffix and the one before it in sa. Where the symbols before both agree it is one less than at the place before;
    only the others, the irreducible ones, are compared."""
    n = len(sa)
    before = np.full(n, -1)  # by suffix
    before[sa[1:]] = sa[:-1]
    follows = np.r_[False, (before[1:] > 0) & (raw[:-1] == raw[before[1:] - 1])]
    at = np.flatnonzero(~follows & (before >= 0))
    size = np.zeros(n, np.int64)
    padded = np.r_[raw, np.zeros(1 << 12, raw.dtype)]  # the last symbol stands nowhere else, so no comparison gets past it
    for k in range(0, len(at), 1 << 15):  # so few at once that their comparisons stay small
        live, width = at[k : k + (1 << 15)], 16
        while len(live):
            same = padded[(live + size[live])[:, None] + np.arange(width)] == padded[(before[live] + size[live])[:, None] + np.arange(width)]
            whole = same.all(axis=1)
            size[live] += np.where(whole, width, same.argmin(axis=1))
            live = live[whole]
            width = min(1 << 12, max(16, (1 << 19) // max(1, len(live))))
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return size[start] - np.where(follows, np.arange(n) - start, 0)


def repeated_windows(runs: list[tuple[int, int, bytes]], length: int = 100) -> list[tuple[int, int, int]]:
    """runs: (id, start, bytes). (id, start, windows) of the stretches of windows whose equals start earlier in another run given."""
    body = np.concatenate([np.r_[np.frombuffer(r, np.uint8).astype(np.int32) + 2, np.int32(1)] for _, _, r in runs] + [np.zeros(1, np.int32)])
    sa = suffix_array(body, 258)
    shared = common_prefixes(body, sa)[sa] >= length
    size = np.array([len(r) for _, _, r in runs])
    offset = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(runs)), size + 1)
    # classes of suffixes with a common window: neighbours in sa that share length bytes; only whole windows can
    group = np.cumsum(~shared)
    inside = np.r_[np.arange(len(owner)) - offset[owner] + length <= size[owner], False][sa]
    many = (np.r_[False, shared[1:]] | np.r_[shared[1:], False]) & inside
    place, group = sa[many], group[many]
    if not len(place):
        return []
    own = owner[place]
    ids = np.array([i for i, _, _ in runs], np.int64)[own]
    starts = np.array([t for _, t, _ in runs], np.int64)[own] + place - offset[own]
    order = np.lexsort((starts, ids, group))
    later = np.r_[False, group[order][1:] == group[order][:-1]]
    gone = np.sort(place[order][later])
    cuts = np.flatnonzero(np.r_[True, np.diff(gone) != 1])
    ends = np.r_[cuts[1:], len(gone)]
    out = []
    for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
        k = int(owner[gone[a]])
        out.append((runs[k][0], runs[k][1] + int(gone[a] - offset[k]), b - a))
    return out


def may_repeat(anchors: list[int], raws: list[bytes], length: int = 100, k: int = GRAM, bins: int = 8) -> list[int]:
    """Which runs can share a window with another one of their anchor. A window spends length - k bytes left and right of its anchor; for each of `bins` ranges of the left
    share, two runs with a common window agree on the bytes that any window of the range has. The rest need no sorting."""
    ends = np.cumsum([len(r) for r in raws])
    whole = b"".join(raws)
    first, _, _, at = window_runs(np.frombuffer(whole, np.uint8), ends, length, k)
    run = np.searchsorted(ends, first, side="right")
    place = np.zeros(len(raws), np.int64)
    place[run] = at - np.r_[0, ends[:-1]][run]
    free, keep = length - k, set()
    step = -(-(free + 1) // bins)
    for low in range(0, free + 1, step):
        high = min(low + step - 1, free)
        seen: dict[tuple[int, bytes], int] = {}
        for i, (a, r, p) in enumerate(zip(anchors, raws, place.tolist(), strict=True)):
            lo, hi = p - low, p + k + free - high
            if lo >= 0 and hi <= len(r):
                other = seen.setdefault((a, r[lo:hi]), i)
                if other != i:
                    keep.add(i)
                    keep.add(other)
    return sorted(keep)


KINDS = "kind int, seq long, start long, windows int, anchor long"
GONE, SHARD, WIDE = 0, 1, 2
SEQ = "__lexigraph_seq"


def numbered(docs: DataFrame, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    """(seq, doc_id, text), or seq with all columns: seq is the order's key; the id where ids are unique and not null."""
    i = F.col(id_col).cast("long")
    cols = list(docs.columns) if keep else [i.alias("doc_id"), F.col(text_col).alias("text")]
    ids = docs.select(i.alias("i"))
    if ids.where("i is null").limit(1).count() or ids.groupBy("i").count().where("count > 1").limit(1).count():
        last = i.asc_nulls_last()
        dealt = docs.repartitionByRange(last, F.col(text_col)).sortWithinPartitions(last, F.col(text_col))
        return cut(dealt.select(F.monotonically_increasing_id().alias("seq" if not keep else SEQ), *cols), "numbered")
    return docs.select(i.alias("seq" if not keep else SEQ), *cols)


def anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """Runs of windows, equal ones of a block combined: later ones are marked as gone at once."""
    def run(batches):
        for b in in_blocks(batches, 3 << 20, most=1 << 16):
            seqs, raws = b.column(0).to_numpy(), [utf8(x) for x in b.column(1).to_pylist()]
            keep = [k for k, r in enumerate(raws) if len(r) >= length]
            if not keep:
                continue
            sizes = np.array([len(raws[k]) for k in keep])
            ends = np.cumsum(sizes)
            whole = b"".join(raws[k] for k in keep)
            first, windows, anchor, _ = window_runs(np.frombuffer(whole, np.uint8), ends, length)
            view = memoryview(whole)
            content = np.fromiter((xxhash.xxh64_intdigest(view[a : a + w + length - 1]) for a, w in zip(first.tolist(), windows.tolist(), strict=True)), U64, len(first))
            doc = np.searchsorted(ends, first, side="right")
            seq, start = seqs[keep][doc], first - (ends - sizes)[doc]
            order = np.lexsort((start, seq, content, anchor))
            a, c = anchor[order], content[order]
            again = np.r_[False, (a[1:] == a[:-1]) & (c[1:] == c[:-1])]
            kind = np.where(again, GONE, SHARD).astype(np.int32)
            # what is gone needs no partner; it travels with its document
            a = np.where(again, seq[order].astype(np.int64).view(U64), a)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(seq[order]), pa.array(start[order]), pa.array(windows[order].astype(np.int32)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], ["kind", "seq", "start", "windows", "anchor", "content"])

    return rows.select("seq", "text").mapInArrow(run, KINDS + ", content long")


def judge(rows: DataFrame, most: int) -> DataFrame:
    """Runs equal to an earlier one are gone; anchors with several different runs go on, as shard or, past `most`, as wide."""
    def run(batches):
        last, held, wide = None, None, False
        names = ["kind", "seq", "start", "windows", "anchor"]

        def out(kind, c, at):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *(pa.array(c[n][at]) for n in names[1:])], names)

        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(k).to_numpy() for k, n in enumerate([*names, "content"])}
            gone = c["kind"] == GONE
            if gone.any():
                yield out(GONE, c, np.flatnonzero(gone))
                c = {n: v[~gone] for n, v in c.items()}
            if not len(c["seq"]):
                continue
            same = np.r_[last is not None and last == (c["anchor"][0], c["content"][0]), (c["anchor"][1:] == c["anchor"][:-1]) & (c["content"][1:] == c["content"][:-1])]
            last = (c["anchor"][-1], c["content"][-1])
            yield out(GONE, c, np.flatnonzero(same))
            c = {n: v[~same] for n, v in c.items()}
            if held is not None:
                c = {n: np.concatenate([held[n], c[n]]) for n in c}
            held = None
            if not len(c["seq"]):
                continue
            cuts = np.flatnonzero(np.r_[True, c["anchor"][1:] != c["anchor"][:-1]])
            size = np.diff(np.r_[cuts, len(c["anchor"])])
            kinds = np.where(size > most, WIDE, np.where(size > 1, SHARD, -1))
            if wide and wide == int(c["anchor"][0]) + (1 << 64):
                kinds[0] = WIDE
            if kinds[-1] != WIDE:  # the last anchor may go on
                held = {n: v[cuts[-1] :] for n, v in c.items()}
                kinds[-1] = -1
                wide = False
            else:
                wide = int(c["anchor"][-1]) + (1 << 64)
            each = np.repeat(kinds, size)
            for kind in (SHARD, WIDE):
                yield out(kind, c, np.flatnonzero(each == kind))
        if held is not None and len(held["seq"]) > 1:
            yield out(WIDE if len(held["seq"]) > most else SHARD, held, np.arange(len(held["seq"])))

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "content", "seq", "start")
    return dealt.mapInArrow(run, KINDS)


def with_bytes(open_runs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Adds the runs' bytes from the texts: one row of the right side for each of the left's."""
    each = open_runs.groupBy("seq").agg(F.collect_list(F.struct("kind", "start", "windows", "anchor")).alias("runs"))

    def run(batches):
        for b in in_blocks(batches, 4 << 20):
            cols = [[], [], [], [], [], []]
            for seq, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = utf8(text)
                for r in runs:
                    for col, v in zip(cols, (r["kind"], seq, r["start"], r["windows"], r["anchor"], raw[r["start"] : r["start"] + r["windows"] + length - 1]), strict=True):
                        col.append(v)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kind", "seq", "start", "windows", "anchor", "bytes"])

    return rows.select("seq", "text").join(each, "seq").select("seq", "text", "runs").mapInArrow(run, KINDS + ", bytes binary")


def sort_shards(runs: DataFrame, length: int, batch: int = 1 << 20) -> DataFrame:
    """(seq, start, windows) that suffix sorting finds gone; anchors stay whole and are sorted together in shards of about `batch` bytes."""
    def run(batches):
        held, total, anchor = [], 0, None

        def flush():
            some = [held[i][:3] for i in may_repeat([r[3] for r in held], [r[2] for r in held], length)]
            found = repeated_windows(some, length) if some else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int32())], ["seq", "start", "windows"])

        for b in batches:
            for seq, start, a, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if a != anchor and total >= batch:
                    yield flush()
                    held, total = [], 0
                held.append((seq, start, raw, a))
                total, anchor = total + len(raw), a
        if held:
            yield flush()
        trim()

    dealt = runs.repartition("anchor").sortWithinPartitions("anchor").select("seq", "start", "anchor", "bytes")
    return dealt.mapInArrow(run, "seq long, start long, windows int")


def split_wide(runs: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many runs, by window hashes."""
    def run(batches):
        for b in batches:
            for seq, start, windows, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                view = memoryview(raw)
                hashes = [xxhash.xxh3_128_digest(view[k : k + length]) for k in range(windows)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(np.full(windows, seq)), pa.array(start + np.arange(windows))], ["hash", "seq", "start"])

    each = runs.select("seq", "start", "windows", "bytes").mapInArrow(run, "hash binary, seq long, start long")
    first = each.groupBy("hash").agg(F.min(F.struct("seq", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = each.join(first, "hash").where("struct(seq, start) > first")
    return gone.select("seq", "start", F.lit(1).alias("windows"))


def spans(starts: list[int], windows: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    out: list[list[int]] = []
    for a, b in sorted((s, s + w + length - 1) for s, w in zip(starts, windows, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def gone_windows(rows: DataFrame, length: int, most: int) -> DataFrame:
    """(seq, starts, windows) of every document that loses something."""
    judged = cut(judge(anchor_rows(rows, length), most), "judged")
    left = cut(with_bytes(judged.where(F.col("kind") != GONE), rows, length), "runs")
    gone = judged.where(F.col("kind") == GONE).select("seq", "start", "windows")
    gone = gone.union(sort_shards(left.where(F.col("kind") == SHARD), length)).union(split_wide(left.where(F.col("kind") == WIDE), length))
    return gone.groupBy("seq").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("windows"))


def remove_repeats(docs: DataFrame, length: int = 100, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, spans removed, and the bytes kept."""
    rows = numbered(docs, id_col, text_col)
    found = gone_windows(rows, length, most)

    def run(batches):
        for b in in_blocks(batches):
            n, cuts, kept = [], [], []
            for text, starts, windows in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = utf8(text)
                gone = spans(starts or [], windows or [], length)
                n.append(len(raw))
                cuts.append([{"start": a, "end": e} for a, e in gone])
                kept.append(b"".join(raw[a:e] for a, e in zip([0, *(e for _, e in gone)], [*(a for a, _ in gone), len(raw)], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cuts, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    whole = rows.join(found, "seq", "left").select("doc_id", "text", "starts", "windows")
    return whole.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated strings, with n_chars of what is left; every row stays, also where nothing is left. Characters of which only some bytes go,
    go whole. Repeated and null ids are ordered as above."""
    names, n = list(docs.columns), len(docs.columns)
    keyed = numbered(docs, "doc_id", "text", keep=True)
    found = gone_windows(keyed.select(F.col(SEQ).alias("seq"), "text"), 100, 20_000)
    found = found.select(F.col("seq").alias(SEQ), F.col("starts").alias(SEQ + "_starts"), F.col("windows").alias(SEQ + "_windows"))
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in batches:
            texts, sizes = b.column(text).to_pylist(), b.column(chars).to_pylist() if chars is not None else None
            starts, windows = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            for k, at in enumerate(starts):
                if at:
                    raw, kept, last = utf8(texts[k]), [], 0
                    for a, e in spans(at, windows[k], 100):
                        kept.append(raw[last:a])
                        last = e
                    texts[k] = "".join(x.decode("utf-8", "ignore") for x in (*kept, raw[last:]))
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            cols = [b.column(k) for k in range(n)]
            cols[text] = pa.array(texts, cols[text].type)
            if sizes is not None:
                cols[chars] = pa.array(sizes, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return keyed.join(found, SEQ, "left").drop(SEQ).mapInArrow(run, docs.schema)
