"""Segmentation lattices of words over a fixed public vocabulary, built for many words at once.

A text is one mark (U+2581) and its characters, each space being a mark too; it falls into units that begin at a run of marks or at a newline, so a
lattice path of the text is a path of each unit in turn. Pieces that have a mark after another character never match, all others do. A character without a piece of its
own is one edge of byte pieces; a literal U+2581 is one as well, so that decoding gives the text back.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK, STAND_IN = "▁", "\ud800"
BASE = np.uint64(0x9E3779B97F4A7C15)
SCALE = 7.0  # nats a character, about what words have: keeps products of probabilities in a float's range
RUN = re.compile(" +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def marked(text: str | None) -> str:
    """The marked text, its units apart by spaces."""
    s = " " + (text or "").replace(MARK, STAND_IN)
    s = RUN.sub(lambda m: " " + MARK * len(m[0]), s) if "  " in s else s.replace(" ", " " + MARK)
    return s.replace("\n", " \n ")


def units(text: str | None) -> list[str]:
    """The units of a text; their concatenation is the marked text. Null and empty texts have the bare mark."""
    return [u for u in marked(text).split(" ") if u]


def split(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The units of texts one after the other, in UTF-8, and how many each has."""
    lists = pc.split_pattern(pa.array([marked(x).encode("utf-8", "surrogatepass") for x in texts], pa.large_binary()), " ")
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy() > 0
    return flat.filter(pa.array(full)), np.add.reduceat(full, lists.offsets.to_numpy()[:-1], dtype=np.int64)


class Vocabulary:
    """Pieces by hash of their characters. ids from `size` on stand for a character's bytes (size + code point)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = np.zeros(256, np.int64)
        self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        usable = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and MARK not in p.lstrip(MARK):
                usable[p] = i
        prefixes: dict[str, int] = {}
        for p, i in usable.items():
            for n in range(1, len(p)):
                prefixes.setdefault(p[:n], -1)
            prefixes[p] = i
        self.longest = max(map(len, usable))
        keys = np.array([self.hash_of(p) for p in prefixes], np.uint64)
        assert len(np.unique(keys)) == len(keys)
        self.ids = np.fromiter(prefixes.values(), np.int64, len(prefixes))
        self.bits = (4 * len(keys)).bit_length()
        self.row = np.full(1 << self.bits, -1, np.int32)  # an open table of the rows of keys
        self.keys = keys
        for k, at in enumerate(self.place(keys).tolist()):
            while self.row[at] >= 0:
                at = at + 1 & (1 << self.bits) - 1
            self.row[at] = k
        self.texts = pa.array(self.raw, pa.large_binary())

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def place(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(31))) * BASE >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of hashes, -1 where no piece begins so."""
        at = self.place(h)
        out = self.row.take(at)
        wrong = np.flatnonzero((self.keys.take(out, mode="wrap") != h) & (out >= 0))
        while len(wrong):
            at[wrong] = at[wrong] + 1 & (1 << self.bits) - 1
            out[wrong] = self.row[at[wrong]]
            wrong = wrong[(self.keys[out[wrong]] != h[wrong]) & (out[wrong] >= 0)]
        return out

    def bytes_of(self, code: int) -> np.ndarray:
        """Byte pieces of a character."""
        c = MARK if code == 0xD800 else chr(code)
        return self.byte_ids[np.frombuffer(c.encode("utf-8", "surrogatepass"), np.uint8)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of piece ids (byte pieces included) in UTF-8."""
        found = self.texts.take(pa.array(ids))
        _, ends, data = found.buffers()
        return data[1 : np.frombuffer(ends, np.int64)[len(ids)]].to_pybytes()

    def plain(self, ids: np.ndarray) -> np.ndarray:
        """Byte edges replaced by their byte pieces."""
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids
        ids = ids.copy()
        short = odd[ids[odd] < self.size + 128]
        ids[short] = self.byte_ids[ids[short] - self.size]
        odd = odd[ids[odd] >= self.size]
        if not len(odd):
            return ids
        out, at = [], 0
        for k in odd.tolist():
            out += [ids[at:k], self.bytes_of(int(ids[k]) - self.size)]
            at = k + 1
        return np.concatenate([*out, ids[at:]])

    def lattice(self, words: list[str]) -> Lattice:
        return Lattice(self, words)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """Edges (src, dst, piece) of all words, by source. Nodes are numbered by their place in the word, then by word, longer words first; so each place is a stretch of nodes, and the
    edges from it are a stretch of edges. starts and ends are the words' first and last nodes, nodes those of all characters, word by word."""

    def __init__(self, v: Vocabulary, words: list[str]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        longest = np.argsort(-sizes, kind="stable")
        self.starts = np.empty(len(words), np.int64)
        self.starts[longest] = np.arange(len(words))
        per_place = np.searchsorted(-sizes[longest], -np.arange(sizes.max(initial=0) + 1), side="right")
        offset = np.r_[0, np.cumsum(per_place)]
        self.n_nodes, self.ends = int(offset[-1]), offset[sizes] + self.starts
        self.place = np.repeat(np.arange(len(per_place)), per_place)
        self.rank = np.arange(self.n_nodes) - offset[self.place]  # of a node's word
        self.size = sizes[longest]
        word = np.repeat(self.starts, sizes)
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        place = at - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left, codes = np.repeat(sizes, sizes) - place, chars + np.uint64(1)
        self.nodes = offset[place] + word
        src, dst, piece, single = [], [], [], np.zeros(len(chars), bool)
        for n in range(1, v.longest + 1):
            keep = np.flatnonzero(left.take(at) >= n)
            at, h = at.take(keep), h.take(keep)
            if not len(at):
                break
            h *= BASE
            h += codes.take(at + (n - 1))
            k = v.find(h)
            keep = np.flatnonzero(k >= 0)
            at, h, ids = at.take(keep), h.take(keep), v.ids.take(k.take(keep))
            hit = np.flatnonzero(ids >= 0)
            here = at.take(hit)
            src.append(self.nodes.take(here))
            dst.append(offset.take(place.take(here) + n) + word.take(here))
            piece.append(ids.take(hit))
            if n == 1:
                single[here] = True
        bare = np.flatnonzero(~single)
        src.append(self.nodes[bare])
        dst.append(offset[place[bare] + 1] + word[bare])
        piece.append(chars[bare].astype(np.int64) + v.size)
        src, dst, piece = map(np.concatenate, (src, dst, piece))
        order = ranked(src)
        self.src, self.dst, self.piece = src.take(order), dst.take(order), piece.take(order)
        cuts = np.searchsorted(self.src, offset).tolist()
        #: the edges from each place, so that each step reads finished nodes only
        self.steps = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
        self.first = np.flatnonzero(np.r_[True, self.src[1:] != self.src[:-1]]) if len(src) else np.zeros(0, np.int64)  # edge of each node that has any

    def scaled(self, weight: np.ndarray) -> np.ndarray:
        span = (self.place[self.dst] - self.place[self.src]) * SCALE
        return np.exp(weight + (span[:, None] if weight.ndim > 1 else span))

    def again(self, x: np.ndarray) -> np.ndarray:
        """Which edges belong to words whose sums left the range of floats."""
        bad = ~((x > 1e-250) & (x < 1e250))
        odd = np.zeros(len(self.size), bool)
        odd[self.rank[bad.any(axis=1) if x.ndim > 1 else bad]] = True
        return odd[self.rank[self.src]]

    def logs(self, x: np.ndarray, part: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(x) - SCALE * (part[:, None] if x.ndim > 1 else part)

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """log alpha of all nodes; weight has the log weight of each edge in one or more columns."""
        p, a = self.scaled(weight), np.zeros((self.n_nodes, *weight.shape[1:]))
        a[self.starts] = 1
        with np.errstate(over="ignore", invalid="ignore"):
            for e in self.steps:
                a[self.dst[e]] += a[self.src[e]] * p[e]
        out, odd = self.logs(a, self.place), self.again(a)
        if odd.any():
            out[self.dst[odd]] = -np.inf
            for e in self.steps:
                e = e.start + np.flatnonzero(odd[e])
                out[self.dst[e]] = np.logaddexp(out[self.dst[e]], out[self.src[e]] + weight[e])
        return out

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """log beta of all nodes."""
        p, b = self.scaled(weight), np.zeros((self.n_nodes, *weight.shape[1:]))
        b[self.ends] = 1
        at = np.searchsorted(self.first, [e.start for e in self.steps] + [len(self.src)]).tolist()
        with np.errstate(over="ignore", invalid="ignore"):
            for k in range(len(self.steps) - 1, -1, -1):
                e, cuts = self.steps[k], self.first[at[k] : at[k + 1]]
                b[self.src[cuts]] = np.add.reduceat(b[self.dst[e]] * p[e], cuts - e.start)
        out, odd = self.logs(b, self.size[self.rank] - self.place), self.again(b)
        if odd.any():
            for e in reversed(self.steps):
                e = e.start + np.flatnonzero(odd[e])
                if not len(e):
                    continue
                x = out[self.dst[e]] + weight[e]
                cuts = np.flatnonzero(np.r_[True, np.diff(self.src[e]) != 0])
                top = np.maximum.reduceat(x, cuts)
                width = np.diff(np.r_[cuts, len(e)])
                out[self.src[e[cuts]]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, width, axis=0)), cuts))
        return out


def numbers(index: dict, words: list) -> np.ndarray:
    """Of each word, -1 where it has none."""
    return np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))


def ranked(x: np.ndarray) -> np.ndarray:
    """Stable order; of small numbers by radix."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


def edge_weights(v: Vocabulary, table: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Log weights of edges from those of pieces; a character's bytes count one by one."""
    out = table.take(piece, axis=0, mode="clip")
    odd = np.flatnonzero(piece >= v.size)
    if len(odd):
        codes, back = np.unique(piece[odd] - v.size, return_inverse=True)
        out[odd] = np.array([table[v.bytes_of(int(c))].sum(axis=0) for c in codes])[back]
    return out
