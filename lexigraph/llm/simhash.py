"""SimHash near-duplicates through a hierarchical index in Gray order.

A fingerprint has 64 bits; texts link when 2 or fewer bits differ. Of three disjoint bit masks at least one must agree exactly between
two linked fingerprints, so the index's top nodes are the masked patterns of each mask (no difference accumulated). Within a node the distinct fingerprints are
sorted by Gray rank, which puts those with shared bits side by side; runs of them form leaves whose constant bits are factored into
their parent, and so on upwards. A search goes down with the differences accumulated so far and drops whole groups past the limit.

A node with more than `most` fingerprints is split again by three masks over its free bits, which stays exact, so no task holds more than the bits
that are left allow. A node yields a spanning forest of its links, never all pairs; equal fingerprints are one entry.

Null and empty texts have fingerprint zero and link like any other; texts are read whole, in blocks of shingles. Rows without an id keep their fingerprint and take the class of
the ids they link to (null if there are none). Repeated rows have equal results; repeated ids share a row's class if any of their texts link. Ties do not arise: a class is
named by its smallest id. An empty table gives an empty one. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigraph.operators.components import connected_components

from .common import cut, in_blocks, table, utf8

BITS = np.uint64(64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42, block: int = 1 << 15) -> int:
    """Unsigned: bit set where over half the shingles' XXH64 have it."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width))))) if len(words) >= width else [b" ".join(words)]
    raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(raw), block):
        counts += np.unpackbits(raw[at : at + block], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a long."""
    def run(batches):
        for b in in_blocks(batches):
            fps = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(col):
    """Place of the bits in Gray order, as a long whose signed order is that order."""
    r = col
    for k in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, k))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


def parts(bits: list[int], n: int) -> list[list[int]]:
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


def masks(levels: int, bits: list[int] | None = None, held: int = 0, limit: int = 2) -> list[int]:
    """All masks of the last of so many levels: each level adds one of limit + 1 parts of the free bits."""
    bits = list(range(64)) if bits is None else bits
    out = []
    for part in parts(bits, limit + 1):
        mask = held | sum(1 << b for b in part)
        out += [mask] if levels == 1 else masks(levels - 1, [b for b in bits if b not in part], mask, limit)
    return out


def tree(x: np.ndarray, leaf: int = 16, fan: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (pattern, mask, own bits) from the top; x is in Gray order. own: bits of the mask that the parent lacks."""
    levels, step = [], leaf
    while True:
        at = np.arange(0, len(x), step)
        differ = np.bitwise_or.reduceat(x, at) ^ np.bitwise_and.reduceat(x, at)
        levels.append((x[at], ~differ))
        if len(at) == 1:
            break
        step *= fan
    levels.reverse()
    out = []
    for k, (pattern, mask) in enumerate(levels):
        above = levels[k - 1][1][np.arange(len(mask)) // fan] if k else np.zeros(1, np.uint64)
        out.append((pattern, mask, mask & ~above))
    return out


def links(x: np.ndarray, limit: int = 2, leaf: int = 16, fan: int = 8, block: int = 256):
    """Yields index arrays (i, j), i < j, of all pairs of x within limit bits, by descending the tree for blocks of queries."""
    levels = tree(x, leaf, fan)
    for at in range(0, len(x), block):
        q = np.arange(at, min(at + block, len(x)))
        node, acc = np.zeros(len(q), np.int64), np.zeros(len(q), np.uint8)
        for k, (pattern, _, own) in enumerate(levels):
            if k:
                width = len(pattern)
                q, acc = np.repeat(q, fan), np.repeat(acc, fan)
                node = (node[:, None] * fan + np.arange(fan)).ravel()
                keep = node < width
                q, acc, node = q[keep], acc[keep], node[keep]
            acc = acc + np.bitwise_count((x[q] ^ pattern[node]) & own[node])
            keep = acc <= limit
            q, acc, node = q[keep], acc[keep], node[keep]
        step = max(1, (1 << 20) // leaf)
        for s in range(0, len(q), step):
            a = np.repeat(q[s : s + step], leaf)
            b = (node[s : s + step, None] * leaf + np.arange(leaf)).ravel()
            keep = (b < len(x)) & (a < b)
            a, b = a[keep], b[keep]
            keep = np.bitwise_count(x[a] ^ x[b]) <= limit
            yield a[keep], b[keep]


def forest(x: np.ndarray, limit: int = 2) -> np.ndarray:
    """For each of x in Gray order, the index of its class's first."""
    root = np.arange(len(x))
    for a, b in links(x, limit):
        while len(a):
            la, lb = root[a], root[b]
            keep = la != lb
            a, b, la, lb = a[keep], b[keep], la[keep], lb[keep]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(la, lb), np.minimum(la, lb))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return root


def index_links(nodes: DataFrame, limit: int = 2, most: int = 8192, depth: int = 3) -> DataFrame:
    """nodes(fp, doc_id), distinct in fp -> (src, dst) ids, linear in the nodes, whose components are those of all links."""
    def search(batches):
        held: list[pa.Table] = []

        def groups(rows: pa.Table):
            mask, key = rows["mask"].to_numpy(), rows["key"].to_numpy()
            fp, ids = rows["fp"].to_numpy().view(np.uint64), rows["doc_id"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[starts[1:], len(fp)]
            src, dst = [], []
            for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                root = forest(fp[lo:hi], limit)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                src.append(ids[lo:hi][moved])
                dst.append(ids[lo:hi][root[moved]])
            empty = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *src])), pa.array(np.concatenate([empty, *dst]))], ["src", "dst"])

        for b in batches:  # sorted by mask and key; the last group of a batch may go on in the next
            if not b.num_rows:
                continue
            rows = pa.concat_tables([*held, pa.Table.from_batches([b])]).combine_chunks()
            mask, key = rows["mask"].to_numpy(), rows["key"].to_numpy()
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield groups(rows.slice(0, done))
            held = [rows.slice(done)]
        if held:
            yield groups(held[0].combine_chunks())

    out, now = None, nodes.select("fp", "doc_id", F.lit(0).alias("mask"), F.lit(0).cast("long").alias("key"))
    for level in range(1, depth + 1):
        ms = masks(level, limit=limit)
        wide = limit + 1
        # the parent's place in the list of masks gives its children's
        kids = F.explode(F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda k: F.col("mask") * wide + k))
        now = now.select("fp", "doc_id", kids.alias("mask"))
        signed = F.element_at(F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in ms)), (F.col("mask") + 1).cast("int"))
        now = now.withColumn("key", F.col("fp").bitwiseAND(signed))
        small = now
        if level < depth:
            size = now.groupBy("mask", "key").count()
            large = cut(size.where(F.col("count") > most).select("mask", "key"), "large")
            some = bool(large.take(1))
            if some:
                small = now.join(large, ["mask", "key"], "left_anti")
        dealt = small.repartition(F.col("mask"), F.col("key")).sortWithinPartitions("mask", "key", gray_rank(F.col("fp")))
        found = dealt.mapInArrow(search, "src long, dst long")
        out = found if out is None else out.union(found)
        if level == depth or not some:
            return out
        now = now.join(large, ["mask", "key"], "left_semi")
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs."""
    prints = cut(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    stars = connected_components(index_links(nodes.where("doc_id is not null"), limit))
    first = nodes.join(stars.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("fp", F.coalesce("component", "doc_id").alias("component_id"))
    return prints.join(first, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketch(text: str | None, width: int, cut_every: int = 16, seed: int = 42, block: int = 1 << 15) -> tuple[int, list[int], np.ndarray, bytes]:
    """(fingerprint of the whole, distinct fingerprints of its segments, sorted distinct shingle hashes, hash of the words). A segment ends at a shingle whose hash
    is a multiple of cut_every, so an edit changes the one or two segments around it and no others."""
    words = utf8(text).lower().split()
    joined = b" ".join(words)
    if not words:
        return 0, [0], np.zeros(0, np.uint64), xxhash.xxh3_128_digest(joined)
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width))))) if len(words) >= width else [joined]
    raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), np.uint8).reshape(-1, 8)
    counts, segments = np.zeros(64, np.int64), set()
    for at in range(0, len(raw), block):
        part = raw[at : at + block]
        bits = np.unpackbits(part, axis=1)
        starts = np.flatnonzero(np.r_[True, part[:-1, 7] % cut_every == 0])
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        counts += sums.sum(axis=0)
        sizes = np.diff(np.r_[starts, len(part)])
        segments.update(np.packbits(sums * 2 > sizes[:, None], axis=1).view(">i8").ravel().tolist())
    whole = int.from_bytes(np.packbits(counts * 2 > len(raw)).tobytes(), "big")
    return whole, sorted(segments), np.unique(raw.view("<u8").ravel()), xxhash.xxh3_128_digest(joined)


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes(node, doc_id, words) whose texts' word shingles have a Jaccard similarity of at least `least`; docs(doc_id, text). A node's text is known by its words, as rows of one id may differ."""
    def shingles(batches):
        for b in in_blocks(batches):
            made = [sketch(x, width) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[3] for m in made], pa.binary()), pa.array([m[2].astype("<u8").tobytes() for m in made], pa.binary())], ["words", "shingles"])

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    some = nodes.select("node", "doc_id", "words").join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")
    made = docs.join(some.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(shingles, "words binary, shingles binary")
    sets = cut(made.groupBy("words").agg(F.first("shingles").alias("shingles")).join(some.select("node", "words"), "words").select("node", "shingles"), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def frequent(rows: DataFrame, width: int, part: float = 0.1, about: int = 4000, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles that stand in three or more of a sample of rows(doc_id, text): a part of them, `about` at least, so that a shingle frequent enough to be
    found is as frequent whatever the table's size. It only sets the order of shingles, which any choice leaves exact; a shingle it misses makes a larger group. At most `most` are sent to
    the driver and broadcast, those above the count that leaves so many."""
    def run(batches):
        for b in in_blocks(batches):
            made = [sketch(x, width)[2] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).astype(np.uint64).view(np.int64))], ["shingle"])

    cells = 1 << 20
    share = int(min(1.0, max(part, about / max(1, rows.count()))) * cells)
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(cells)) < share).mapInArrow(run, "shingle long")
    seen = cut(some.groupBy("shingle").count().where("count >= 3"), "frequent")
    least, total = 3, 0
    for r in sorted(seen.groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["count"]):  # one row a count
        total += r["n"]
        if total > most:
            least = r["count"] + 1
            break
    found = seen.where(F.col("count") >= least).toPandas()
    keys = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["count"].to_numpy(np.int64)[order]


def prefix(shingles: np.ndarray, least: float, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of the sorted shingles in one order for all texts, rarest first and then by hash: so many that two texts of similarity `least` share one of theirs."""
    n = len(shingles)
    if not n:
        return shingles
    often = np.zeros(n, np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        often = np.where(keys[at] == shingles, counts[at], 0)
    return shingles[np.argsort(often, kind="stable")[: n - math.ceil(least * n - 1e-9) + 1]]


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit by each shingle's low bits, in twice as many bits at least."""
    bits = np.zeros(1 << max(6, (2 * len(shingles) - 1).bit_length()), np.uint8)
    bits[shingles & np.uint64(len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def at_most(x: bytes, y: bytes, n: int, m: int) -> int:
    """A bound of the shingles that sets of n and m share: a bit that only one bitmap has is a shingle that the other lacks. The longer bitmap is folded."""
    a, b = sorted((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")), key=len)
    if len(x) > len(y):
        n, m = m, n
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def near_pairs(nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of different components that can have a similarity of `least`; nodes(node, n, prefix, bits, component). Exact: the texts share a shingle of their prefixes, and for the smaller set (or either of equal ones) a
    shorter prefix is enough, as a partner of its size or more must share 2 least / (1 + least) of it; so texts of one template that differ too much meet on what they don't share, not on the template. At the first shingle that they share enough must be
    left in both; then their bitmaps must allow it. A shingle in very many prefixes is split by the skew join."""
    each = nodes.select("node", "n", "component", F.posexplode("prefix").alias("at", "shingle"))
    each = each.select("shingle", "node", "n", "component", "at", (F.col("n") - F.col("at")).alias("left"))
    short = each.where(F.col("at") < F.col("n") - F.ceil(2 * least / (1 + least) * F.col("n") - 1e-9) + 1)
    other = short.select("shingle", *(F.col(c).alias(f"o_{c}") for c in each.columns[1:]))
    smaller = (F.col("o_n") < F.col("n")) | ((F.col("o_n") == F.col("n")) & (F.col("o_node") < F.col("node")))
    sizes = F.col("o_n") >= least * F.col("n") - 1e-6
    enough = (1 + least) * F.least("left", "o_left") >= least * (F.col("n") + F.col("o_n")) - 1e-6
    met = each.join(other, "shingle").where(smaller & (F.col("component") != F.col("o_component")) & sizes & enough)
    pairs = met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b")

    def run(batches):
        for b in batches:
            keep = [(1 + least) * at_most(x, y, n, m) >= least * (n + m) - 1e-6 for x, y, n, m in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y", "na", "nb").mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", far: int = 20) -> DataFrame:
    """(doc_id, words, component_id, first) of one row for each different sequence of words, by its hash: classes of texts whose word shingles are at least `least` similar, and of chains of those. doc_id is the smallest id with these
    words, component_id the smallest of the class, and first marks the one row of the class that has it (of two, the smaller hash). Rows without an id are left out; an id may stand in several rows, and each text is judged by itself. Null and empty texts are one
    sequence; copies are one row; an empty table gives none.

    At that similarity whole fingerprints differ in about ten bits, past what an index of 64 bits can search. A first round joins what is cheap to find, so that large groups
    of near copies are one component before pairs are made: pairs linked by the index over whole fingerprints, and texts that share a segment of equal fingerprint, each with
    its group's first and last id, and differ in at most `far` bits as a whole. A second round is exact: all pairs of different components that the prefix filter leaves
    (near_pairs). Every pair of both is checked on the shingle sets."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    often = rows.sparkSession.sparkContext.broadcast(frequent(rows, width))

    def run(batches):
        for b in in_blocks(batches):
            made = [sketch(x, width) for x in b.column(1).to_pylist()]
            fps = np.array([m[0] for m in made], np.uint64).view(np.int64)
            first = [prefix(m[2], least, *often.value).view(np.int64) for m in made]
            cols = [b.column(0), pa.array([m[3] for m in made], pa.binary()), pa.array(fps), pa.array([len(m[2]) for m in made], pa.int64())]
            cols += [pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64())), pa.array([bitmap(m[2]) for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "words", "fp", "n", "segments", "prefix", "bits"])

    made = rows.mapInArrow(run, "doc_id long, words binary, fp long, n long, segments array<long>, prefix array<long>, bits binary")
    nodes = made.groupBy("words").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("fp", "n", "segments", "prefix", "bits")))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "sketches")
    each = nodes.select(F.explode("segments").alias("segment"), "doc_id", "node", "fp", "n")
    me = F.struct("doc_id", "node", "fp", "n")
    groups = each.groupBy("segment").agg(F.min(me).alias("low"), F.max(me).alias("high")).where("low.node != high.node")
    shared = each.join(groups, "segment").select("node", "fp", "n", F.explode(F.array("low", "high")).alias("o")).where("o.node != node")
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("o.fp"))) <= far) & (F.least("n", "o.n") >= least * F.greatest("n", "o.n"))
    pairs = shared.where(near).select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"))
    prints = nodes.groupBy("fp").agg(F.min(F.struct("doc_id", "node")).alias("s")).select("fp", F.col("s.node").alias("node"))
    same = nodes.join(prints.withColumnRenamed("node", "first"), "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = index_links(prints.withColumnRenamed("node", "doc_id")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pairs = cut(pairs.union(same).union(found).distinct(), "pairs")
    stars = cut(connected_components(similar(pairs, nodes, rows, width, least), "a", "b"), "first")
    of = nodes.select("node", "n", "prefix", "bits").join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = similar(cut(near_pairs(of, least), "pairs"), nodes, rows, width, least)
    stars = connected_components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b")
    out = cut(nodes.select("node", "doc_id", "words").join(stars, "node", "left").select("doc_id", "words", F.coalesce("component", "node").alias("component")), "classes")
    least_of = out.groupBy("component").agg(F.min(F.struct("doc_id", "words")).alias("best"))
    return out.join(least_of, "component").select("doc_id", "words", F.col("best.doc_id").alias("component_id"), (F.struct("doc_id", "words") == F.col("best")).alias("first"))


def words_hash(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(utf8(text).lower().split()))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near-duplicates the rows with its smallest id and, among texts of that id, one sequence of words; rows without an id stay. Where an id stands in several rows, each is judged by its own words, so equal rows stand or fall together and others don't
    depend on the order of rows."""
    kept = cut(near_classes(docs).where("first").select(F.col("doc_id").alias("_kept"), F.col("words").alias("_words")), "kept")
    known = docs.where("doc_id is not null")
    again = cut(known.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "repeated-ids")
    # an id of one row is known by itself; of the rows of a repeated id the words decide
    whole = known.join(again, known["doc_id"] == again["_again"], "left_anti")
    whole = whole.join(kept.select("_kept"), whole["doc_id"] == kept["_kept"], "left_semi")
    part = known.join(again, known["doc_id"] == again["_again"], "left_semi")
    at = docs.columns.index("text")

    def hashed(batches):
        for b in in_blocks(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([words_hash(x) for x in b.column(at).to_pylist()], pa.binary())], [*b.schema.names, "_words_of_row"])

    named = part.mapInArrow(hashed, T.StructType([*docs.schema.fields, T.StructField("_words_of_row", T.BinaryType())]))
    part = named.join(kept, (named["doc_id"] == kept["_kept"]) & (named["_words_of_row"] == kept["_words"]), "left_semi").drop("_words_of_row")
    return whole.union(part).union(docs.where("doc_id is null")).select(*docs.columns)
