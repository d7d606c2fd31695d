"""SentencePiece encoding and decoding by sampling: Gumbel top-k without replacement over the segmentation lattice.

A piece's log probability follows its place in the public vocabulary (Zipf-Mandelbrot: p ~ 1 / (rank + shift), flattened by a temperature); a segmentation's is the
sum of its pieces', normalised by the forward-backward mass of the lattice. The search is a perturbed A*: a node is the set of all
segmentations that share a prefix, its bound the Gumbel-perturbed log mass of that set. Popping the best node draws its best leaf
(a descent by conditional probabilities, as the maximum's place is independent of its value) and splits the rest along the path into nodes
whose perturbed values are truncated at the popped one. Leaves so come out in order of perturbed log probability, distinct, which is sampling
without replacement. The inclusion score is 1 - exp(-exp(logp - kappa)), kappa being the best bound left; 1 if nothing is left.

All random numbers come from a 64-bit hash of the row key, so a row's result depends on its key and text alone: repeated rows have equal samples, rows that share only the id (null is
an id like any other) share random numbers, not samples. Null and empty texts have one segmentation, that of the bare mark. A text with fewer than k segmentations returns them all.
Texts are sampled whole, whatever their length. Decoding gives the text back exactly. An empty table gives an empty one. Only the columns named are read; the stage keeps all
columns, and one named like a result gives way to it.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_blocks, table, utf8
from .lattice import default_model, edge_weights, numbers, split, vocabulary

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles x in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x


STEP, STREAM = 0xD1B54A32D192ED03, 0x9E3779B97F4A7C15


def draw(h: np.ndarray) -> np.ndarray:
    """In (0, 1), from fresh 64-bit keys, which are used up."""
    u = (mix(h) >> U64(11)).astype(float)
    u += 0.5
    u *= 1.0 / (1 << 53)
    return u


def keys_of(seed: np.ndarray | int, stream: int, place: np.ndarray, step: int = STEP) -> np.ndarray:
    """Fresh keys from rows' seeds, a stream's number and places."""
    with np.errstate(over="ignore"):
        h = place.astype(U64)
        h *= U64(step)
        h += (seed if isinstance(seed, np.ndarray) else U64(seed)) + U64((stream + 1) * STREAM % (1 << 64))
        return h


def one(seed: int, stream: int) -> float:
    return float(draw(keys_of(seed, stream, np.zeros(1, np.int64)))[0])


def row_seed(key, seed: int) -> int:
    """64 bits of a row's key."""
    return xxhash.xxh3_64_intdigest(str(key).encode(), seed=seed)


class Words:
    """Transition tables of words: per node its edges with cumulative and own conditional probability, the edges of a word together. Keeps up to about `most` edges; past that the words
    that came in most blocks of late stay, with half as many."""

    EDGES = {"cum": np.float32, "own": np.int32, "next": np.int32, "piece": np.int32, "logq": np.float64, "rest": np.float32}

    def __init__(self, path: str, shift: float = 100.0, temperature: float = 5.0, most: int = 6_000_000):
        self.v, self.most = vocabulary(path), most
        rank = np.arange(self.v.size, dtype=float)
        weight = -np.log(rank + shift)
        weight -= np.log(np.exp(weight).sum())
        self.weight = weight / temperature
        self.index: dict[bytes, int] = {}
        self.n = 0
        self.first = np.zeros(1 << 16, np.int32)  # of a word: the first edge of its first node
        self.used = np.zeros(1 << 16, np.int32)  # of a word: in how many blocks it came
        # of an edge: cumulative probability within its node, the likeliest edge first, 1 at the last; the first edge of its node, and of the node it leads to (-1 at the end);
        # its own probability, and that of the other edges of its node, as logarithms
        for name, kind in self.EDGES.items():
            setattr(self, name, np.zeros(self.most * 5 // 4, kind))

    def room(self, name: str, n: int):
        """Makes an array hold n numbers; it grows by half, so that copies stay rare."""
        x = getattr(self, name)
        if len(x) < n:
            new = np.empty(max(n, len(x) * 3 // 2), x.dtype)
            new[: len(x)] = x
            setattr(self, name, new)

    def add(self, new: list[bytes]):
        lat = self.v.lattice([x.decode("utf-8", "surrogatepass") for x in new])
        w = edge_weights(self.v, self.weight, lat.piece)
        b = lat.backward(w)
        starts, dst, piece = lat.first, lat.dst, lat.piece
        width = np.diff(starts, append=len(dst))
        logq = b.take(dst)
        logq += w
        logq -= b.take(lat.src)
        logq[starts[width == 1]] = 0
        # the likeliest edge of a node comes first
        best = np.flatnonzero(logq == np.repeat(np.maximum.reduceat(logq, starts), width))
        if len(best) > len(starts):
            best = best[np.diff(lat.src[best], prepend=-1) != 0]
        for x in (logq, dst, piece):
            x[starts], x[best] = x[best], x[starts].copy()
        q = np.exp(logq)
        total = np.cumsum(q)
        base = total[starts] - q[starts]
        cum = total - np.repeat(base, width)
        cum /= np.repeat(total[starts + width - 1] - base, width)
        cum[starts + width - 1] = 1
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(1 - q, 0) * (q < 1 - 1e-12))
        # a node's edges go where those of the word's nodes before it end; the nodes with edges are those of characters
        start, many = np.full(lat.n_nodes, -1), np.zeros(lat.n_nodes, np.int64)
        many[lat.src[starts]] = width
        many = many[lat.nodes]
        start[lat.nodes] = np.cumsum(many) - many + self.n
        own = np.repeat(start[lat.src[starts]], width)
        at = own + np.arange(len(dst)) - np.repeat(starts, width)
        lo, hi = len(self.index), len(self.index) + len(new)
        self.room("first", hi)
        self.room("used", hi)
        self.first[lo:hi], self.used[lo:hi] = start[lat.starts], 0
        self.index.update(zip(new, range(lo, hi), strict=True))
        for name, x in {"cum": cum, "own": own, "next": start[dst], "piece": piece, "logq": logq, "rest": rest}.items():
            self.room(name, self.n + len(dst))
            getattr(self, name)[at] = x
        self.n += len(dst)

    def shrink(self):
        """Keeps the words that came in most blocks, of late ones first, up to half of `most` edges."""
        begin = self.first[: len(self.index)]
        width = np.diff(begin, append=self.n)
        order = np.argsort(-self.used[: len(begin)], kind="stable")
        keep = np.sort(order[np.cumsum(width[order], dtype=np.int64) <= self.most // 2])
        width = width[keep]
        to = np.cumsum(width) - width
        shift = np.repeat(to - begin[keep], width)
        self.n = len(shift)
        old = np.arange(self.n) - shift
        for name in self.EDGES:
            x = getattr(self, name)
            y = x[old]
            if name in ("own", "next"):
                y += np.where(y < 0, 0, shift).astype(y.dtype)
            if len(x) > 2 * self.most:  # a long text was there
                setattr(self, name, y)
            else:
                x[: self.n] = y
        words = list(self.index)
        self.index = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.used[: len(keep)] = self.used[keep] // 2
        self.first[: len(keep)] = to

    def rows(self, words: pa.Array) -> np.ndarray:
        """First edges of the words."""
        if self.n > self.most:
            self.shrink()
        coded = words.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        out = numbers(self.index, different)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [different[k] for k in missing.tolist()]  # their order has no effect on results
            out[missing] = np.arange(len(self.index), len(self.index) + len(new))
            for k in range(0, len(new), 5000):  # so few that their nodes are ranked by radix
                self.add(new[k : k + 5000])
        self.used[out] += 1
        return self.first[out].take(coded.indices.to_numpy())

    def walk(self, e: np.ndarray, seed: np.ndarray, stream: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path from each node, given by its first edge, to its word's end: (edges, number of edges of each path), paths one after the other."""
        taken, step, n = [], 0, len(e)
        keys = keys_of(seed, stream, key, 4099 * STEP % (1 << 64))
        active = np.flatnonzero(e >= 0)
        if len(active) < n:
            keys, e = keys.take(active), e.take(active)
        with np.errstate(over="ignore"):
            while len(active):
                if step % 2 == 0:  # the halves of a number serve two steps
                    h = mix(keys + U64(step * STEP % (1 << 64)))
                    u = (h >> U64(32)).astype(float)
                else:
                    u = (h & U64(0xFFFFFFFF)).astype(float)
                u += 0.5
                u *= 1.0 / (1 << 32)
                past = np.flatnonzero(self.cum.take(e) < u)
                if len(past):
                    e = e.copy()
                    low, v = e.take(past), u.take(past)
                    while len(past):
                        low += 1
                        go = self.cum.take(low) < v
                        e[past] = low
                        go = np.flatnonzero(go)
                        past, low, v = past.take(go), low.take(go), v.take(go)
                taken.append((active, e))
                e = self.next.take(e)
                keep = np.flatnonzero(e >= 0)
                step += 1
                active, e, keys = active.take(keep), e.take(keep), keys.take(keep)
                if step % 2:
                    h = h.take(keep)
        count = np.bincount(np.concatenate([a for a, _ in taken]), minlength=n) if taken else np.zeros(n, np.int64)
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for k, (a, e) in enumerate(taken):
            out[at.take(a) + k] = e
        return out, count

    def redraw(self, edge: int, banned: list[int], u: float) -> int:
        """Another edge of the same node, by the probabilities without the banned ones."""
        lo = int(self.own[edge])
        own = self.own[lo : min(self.n, lo + self.v.longest + 1)]
        hi = lo + int(np.searchsorted(own, lo, side="right"))
        p = np.exp(self.logq[lo:hi])
        p[[b - lo for b in banned]] = 0
        c = np.cumsum(p)
        return lo + min(int(np.searchsorted(c, u * c[-1], side="right")), int(np.flatnonzero(p)[-1]))


@lru_cache(maxsize=1)
def shared_words(path: str) -> Words:
    """One a worker process, whose tasks share the words."""
    return Words(path)


class Search:
    """One text's frontier: paths drawn so far and the perturbed bounds of what each left aside. firsts: first edges of the text's units."""

    def __init__(self, words: Words, firsts: np.ndarray, seed: int):
        self.w, self.firsts, self.seed = words, firsts, seed
        self.paths: list[dict] = []
        self.plan = {"edges": np.zeros(0, np.int32), "ends": np.zeros(0, np.int64), "g": float(-np.log(-np.log(one(seed, 1_000_003)))), "banned": [], "before": 0.0, "unit": 0, "nodes": firsts}

    def branch(self) -> bool:
        """Plans the next leaf: takes the frontier's best place and draws the edge that leaves it; false if nothing is left."""
        g, k = self.left()
        if g == -np.inf:
            return False
        p = self.paths[-k]
        at = p["best"]
        t = p["t"] + at
        p["r"][at] = np.inf
        self.rank(p)
        edge = int(p["edges"][t])
        banned = [*(p["banned"] if at == 0 else []), edge]
        new = self.w.redraw(edge, banned, one(self.seed, 500 + len(self.paths)))
        unit = int(np.searchsorted(p["ends"], t, side="right"))
        nodes = np.concatenate([self.w.next[new : new + 1], self.firsts[unit + 1 :]])
        edges = np.append(p["edges"][:t], np.int32(new))
        self.plan = {"edges": edges, "ends": p["ends"][:unit], "g": g, "banned": banned, "before": float(p["phi"][at] - p["logq"][at]), "unit": unit, "nodes": nodes}
        return True

    def keep(self, tail: np.ndarray, count: np.ndarray, logq: np.ndarray, rest: np.ndarray, r: np.ndarray):
        """Adds the planned leaf. Its path is new from the last planned edge on (logq, rest and r are of those edges), where `banned` were drawn before. Each place from there on leaves
        a set of other paths aside, whose bound is a Gumbel with its log mass mu, given that it is below g: -log(exp(-g) + exp(r)) with r = log(E) - mu, E exponential; the least r
        has the best bound."""
        x = self.plan
        t = max(0, len(x["edges"]) - 1)
        count[0] += len(x["edges"])
        ends = np.concatenate([x["ends"], np.cumsum(count)])
        phi = np.cumsum(logq)
        phi += x["before"]
        mass = phi - logq
        mass += rest
        if x["banned"]:
            q = float(np.exp(logq[0]) + np.exp(self.w.logq[x["banned"]]).sum())
            mass[0] = x["before"] + np.log(1 - q) if q < 1 - 1e-12 else -np.inf
        r -= mass
        path = {"edges": np.concatenate([x["edges"], tail]), "ends": ends, "t": t, "g": x["g"], "logp": float(phi[-1]), "r": r, "banned": x["banned"], "phi": phi, "logq": logq}
        self.paths.append(path)
        self.rank(path)

    @staticmethod
    def rank(path: dict):
        """The best place left of a path and its bound."""
        r = path["r"]
        path["best"] = int(r.argmin())
        path["bound"] = -float(np.logaddexp(-path["g"], r[path["best"]])) if r[path["best"]] < np.inf else -np.inf

    def left(self) -> tuple[float, int]:
        """The best bound of the frontier and its path."""
        return max((p["bound"], -k) for k, p in enumerate(self.paths))


SAMPLE = "array<struct<ids:array<int>,logp:double,perturbed:double,inclusion:double>>"


def samples(words: Words, keys: list, texts: list, k: int, seed: int) -> list[list[dict]]:
    """For each text up to k segmentations, best perturbed value first. The texts' next leaves are drawn together; each uses the random numbers of its own row alone."""
    each, sizes = split(texts)
    firsts = words.rows(each)
    cuts = [0, *np.cumsum(sizes).tolist()]
    found = [Search(words, firsts[a:b], row_seed(i, seed)) for i, a, b in zip(keys, cuts[:-1], cuts[1:], strict=True)]
    now, leaf = found, 0
    while now and leaf < k:
        sizes = [len(s.plan["nodes"]) for s in now]
        places = np.concatenate([np.arange(s.plan["unit"], s.plan["unit"] + n) for s, n in zip(now, sizes, strict=True)])
        seeds = np.array([s.seed for s in now], U64)
        tails, counts = words.walk(np.concatenate([s.plan["nodes"] for s in now]), np.repeat(seeds, sizes), leaf, places)
        stops = np.cumsum(counts)
        lows, highs = np.cumsum([0, *sizes[:-1]]), np.cumsum(sizes)
        parts = [(a, b, c, d) for a, b, c, d in zip(lows.tolist(), highs.tolist(), (stops[lows] - counts[lows]).tolist(), stops[highs - 1].tolist(), strict=True)]
        # of the new edges of all texts, the branching ones included
        lead = [s.plan["edges"][-1:] for s in now]
        edges = np.concatenate([x for y, (_, _, c, d) in zip(lead, parts, strict=True) for x in (y, tails[c:d])])
        width = np.array([len(y) + d - c for y, (_, _, c, d) in zip(lead, parts, strict=True)])
        total = np.cumsum(width)
        r = draw(keys_of(np.repeat(seeds, width), 2000 + leaf, np.arange(len(edges)) - np.repeat(total - width, width)))
        for f in (np.log, np.negative, np.log):
            f(r, out=r)
        logq, rest = words.logq.take(edges), words.rest.take(edges)
        for s, (a, b, c, d), hi, n in zip(now, parts, total.tolist(), width.tolist(), strict=True):
            s.keep(tails[c:d], counts[a:b], logq[hi - n : hi], rest[hi - n : hi], r[hi - n : hi])
        leaf += 1
        now = [s for s in now if leaf < k and s.branch()]
    paths = [p["edges"] for s in found for p in s.paths]
    ids = words.piece.take(np.concatenate(paths)) if paths else np.zeros(0, np.int32)
    stops = np.cumsum([0, *map(len, paths)])
    odd = np.flatnonzero(ids >= words.v.size)  # bytes of characters, mostly one
    short = odd[ids[odd] < words.v.size + 128]
    ids[short] = words.v.byte_ids[ids[short] - words.v.size]
    wide = np.zeros(len(paths), bool)
    wide[np.searchsorted(stops, odd[ids[odd] >= words.v.size], side="right") - 1] = True
    each = iter([words.v.plain(ids[a:b]) if x else ids[a:b] for a, b, x in zip(stops[:-1].tolist(), stops[1:].tolist(), wide.tolist(), strict=True)])
    out = []
    for s in found:
        kappa = s.left()[0]
        out.append([{"ids": next(each), "logp": p["logp"], "perturbed": p["g"], "inclusion": 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(50.0, p["logp"] - kappa))))} for p in s.paths])
    return out


def listed(found: list[list[dict]]) -> pa.Array:
    """Samples of each row as an Arrow column of type SAMPLE."""
    flat = [x for row in found for x in row]
    cuts = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    ids = pa.ListArray.from_arrays(cuts([len(x["ids"]) for x in flat]), pa.array(np.concatenate([np.zeros(0, np.int32), *(x["ids"] for x in flat)]).astype(np.int32)))
    inner = pa.StructArray.from_arrays([ids, *(pa.array([x[k] for x in flat], pa.float64()) for k in ("logp", "perturbed", "inclusion"))], ["ids", "logp", "perturbed", "inclusion"])
    return pa.ListArray.from_arrays(cuts(map(len, found)), inner)


def encode(docs: DataFrame, k: int = 2, seed: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(doc_id, samples, and the columns to keep): up to k distinct segmentations of each whole text, with ids, log probability, perturbed value and inclusion score. Texts come in
    blocks, so rows of ids stay bounded."""
    path = path or default_model()
    keep = [c for c in keep if c not in (id_col, "doc_id", "samples", text_col)]

    def run(batches):
        words = shared_words(path)
        for b in in_blocks(batches, 1 << 19):
            yield pa.RecordBatch.from_arrays([b.column(0), listed(samples(words, b.column(0).to_pylist(), b.column(1).to_pylist(), k, seed)), *b.columns[2:]], ["doc_id", "samples", *keep])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("samples", T._parse_datatype_string(SAMPLE)), *(rows.schema[c] for c in keep)])
    return rows.mapInArrow(run, schema)


def digest_of(found: list[dict], text: str | None, decode) -> tuple:
    same = all(decode(s["ids"]) == utf8(text) for s in found)
    return len(found), len(found[0]["ids"]), found[0]["logp"], [s["inclusion"] for s in found], [zlib.crc32(s["ids"].astype("<u4").tobytes()) for s in found], same, len({s["ids"].tobytes() for s in found}) == len(found)


def digest(docs: DataFrame, k: int = 2, seed: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes every sample and keeps per row: number of samples, pieces and log probability of the first, inclusion scores, a CRC-32 of each sample's ids,
    and whether all decode to the text and differ."""
    path = path or default_model()
    names = ["doc_id", "n_samples", "n_pieces", "logp", "inclusion", "ids_crc32", "round_trip", "distinct"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_(), pa.bool_()]

    def run(batches):
        words = shared_words(path)
        for b in in_blocks(batches, 1 << 19):
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = [(i, *digest_of(found, text, words.v.decode)) for i, text, found in zip(keys, texts, samples(words, keys, texts, k, seed), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_samples int, n_pieces long, logp double, inclusion array<double>, ids_crc32 array<long>, round_trip boolean, distinct boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: every row's samples with their ids, and all columns of the row but its text, which decoding gives back."""
    return encode(docs, keep=docs.columns)
