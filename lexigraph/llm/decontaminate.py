"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Seeds are the word trigrams of the test items, with their document frequencies over all documents. A document is a candidate for an item if it has a
rare seed of the item (in at most `rare` of the documents) or at least three different seeds of any frequency. Besides, every document that can reach `threshold`
is one, by pairs of words: in an alignment of m matches, a step from match to match over (i, d) words of item and document costs max(i, d) - 1, so with a steps of cost 0 and b of
cost 1 the score is at most 2 + 2a + b. A document therefore is a candidate if its neighbouring words (of distance 1 or 2 in both) allow 2 + 2a + b from
the threshold on; items so short that one match is enough have single words as seeds. Nothing that reaches the threshold is missed, whatever its
frequency; scores below it are those of the candidates. The words around a candidate's hits are aligned with the item by Smith-Waterman (match 2, mismatch -1, gap -1); the score is the
best local alignment over twice the item's words, 1 for a whole verbatim copy. A document is contaminated from `threshold` on.

Test items are read in order of their ids and broadcast in blocks of at most `block_chars` characters and 2**21 - 1 words (an item over that stands alone; one of more than
2,097,151 different words raises an error). A block costs one pass over the documents for the frequencies and one for the scores, without a shuffle of texts; with several blocks the
scores so far are written between them, so that neither passes nor memory add up. A task judges about a megabyte of texts together, as arrays; a longer text stands alone. Words are runs of letters and digits after lower-casing. Null and empty texts, and items without words,
have no seeds: score 0. Ties go to the smallest item id. Repeated rows and ids get each its own result; a null id is like any other. An empty table gives an empty result, no items the
score 0. Hits are never capped, long texts are read whole. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_blocks, new_path, remove, table, utf8

SPLIT = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BORDER = b" \x01 \x01 "  # no word
N = 3
THRESHOLD = 0.4
BLOCK = 1 << 20  # bytes of texts that are judged together
FEW = 1 << 16  # words that Arrow looks up, as it hashes them for each block of texts


def words_of(text: str | None) -> list[bytes]:
    return utf8((text or "").lower()).translate(SPLIT).split()


def align_all(items: list[np.ndarray], windows: list[np.ndarray], match: int = 2, mismatch: int = 1, gap: int = 1, cells: int = 1 << 14) -> np.ndarray:
    """Best Smith-Waterman score of each item in its window; a row of the matrices of many at a time, of at most so many cells where one isn't longer. Windows are filled up with what matches nothing, which raises no score."""
    best = np.zeros(len(items), np.int64)
    lengths, widths = (np.array([len(w) for w in x], np.int64) for x in (items, windows))
    order = np.argsort(-widths, kind="stable")
    while len(order):
        width = int(widths[order[0]])
        part, order = np.split(order, [max(1, min(cells // (width + 1), 64 * cells // max(1, int(lengths.max()))))])
        part = part[np.argsort(-lengths[part], kind="stable")]
        words, columns = np.full((int(lengths[part[0]]), len(part), 1), -1, np.int64), np.full((len(part), width), -2, np.int64)
        for n, k in enumerate(part.tolist()):
            words[: lengths[k], n, 0], columns[n, : widths[k]] = items[k], windows[k]
        steps = gap * np.arange(width + 1, dtype=np.int32)
        above, row, whole = np.zeros((3, len(part), width + 1), np.int32)
        most = whole
        for w, left in zip(words, np.searchsorted(-lengths[part], -np.arange(len(words))).tolist(), strict=True):
            above, row, most = above[:left], row[:left], most[:left]  # the items that go on
            row[:, 1:] = above[:, :-1] + np.where(columns[:left] == w[:left], np.int32(match), np.int32(-mismatch))
            np.maximum(row, above - gap, out=row)
            np.maximum(row, 0, out=row)
            row += steps
            np.maximum.accumulate(row, axis=1, out=row)
            row -= steps
            np.maximum(most, row, out=most)
            above, row = row, above
        best[part] = whole.max(axis=1)
    return best


def align(item: np.ndarray, window: np.ndarray, match: int = 2, mismatch: int = 1, gap: int = 1) -> int:
    """Best Smith-Waterman score."""
    return int(align_all([item], [window], match, mismatch, gap)[0])


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def ends_of(starts: np.ndarray, n: int) -> np.ndarray:
    """Where runs that begin there end, of n in all."""
    return np.r_[starts[1:], n][: len(starts)]


def numbers_of(starts: np.ndarray, n: int) -> np.ndarray:
    """The run of each of n."""
    return np.repeat(np.arange(len(starts)), ends_of(starts, n) - starts)


class Seeds:
    """Trigrams and pairs of words of a block of items over their own word numbers."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.reaches = 2 if threshold > 1 / 3 else 3  # times an item's words: no alignment that reaches the threshold goes further without a cheap step
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.items = []
        for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0)):
            words = [number(w, len(self.vocabulary)) for w in words_of(text)]
            if words:
                self.items.append((i, np.array(words)))
        if len(self.vocabulary) >= 1 << 21:
            raise ValueError("a test item has over two million different words")
        self.known = pa.array([w + b" " for w in self.vocabulary], pa.large_binary()) if len(self.vocabulary) <= FEW else None
        self.sizes = np.array([len(words) for _, words in self.items], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *(words for _, words in self.items)])
        self.item_of = np.repeat(np.arange(len(self.sizes)), self.sizes)  # of each place in flat
        self.need = 2 * threshold * self.sizes - 2 - 1e-9  # of 2a + b
        at = np.flatnonzero(self.item_of[: 1 - N] == self.item_of[N - 1 :])
        self.key, *self.owners = self.postings(self.trigrams(flat, at), self.item_of[at])
        pairs = []  # places twofold, and one for neighbours
        for d in (1, 2):
            at = np.flatnonzero(self.item_of[:-d] == self.item_of[d:])
            pairs.append((flat[at] << 21 | flat[at + d], at << 1 | (d == 1)))
        self.by_pair = self.postings(*map(np.concatenate, zip(*pairs, strict=True)))
        short = np.flatnonzero(self.need[self.item_of] <= 0)
        self.by_word = self.postings(flat[short], short)
        self.shift = 64 - min(24, max(12, 4 + len(self.by_pair[0]).bit_length()))
        self.sieve = np.zeros(1 << (64 - self.shift), bool)
        self.sieve[self.slots(self.by_pair[0])] = True

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).view(np.int64)

    @staticmethod
    def trigrams(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return words[at] << 42 | words[at + 1] << 21 | words[at + 2]

    @staticmethod
    def postings(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, starts, values by key, each once)."""
        order = np.lexsort((values, keys))
        order = order[starts_of(keys[order], values[order])]
        starts = starts_of(keys[order])
        return keys[order][starts], np.r_[starts, len(order)], values[order]

    @staticmethod
    def look_up(known: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, rows in the sorted keys that are known) of those that are."""
        if not len(known):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        same = known[k] == keys
        return at[same], k[same]

    @staticmethod
    def spread(starts: np.ndarray, values: np.ndarray, k: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of rows k of postings, places) of all that agree."""
        n = starts[k + 1] - starts[k]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return values[np.repeat(starts[k], n) + inner], np.repeat(at, n)

    def number(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, -1 if unknown, where each text starts, where it ends); between texts stands -1 twice, so that neither pairs nor trigrams go over."""
        raw = np.frombuffer(b" %b " % BORDER.join(utf8((t or "").lower()).translate(SPLIT) for t in texts), np.uint8)
        space = raw == 32
        raw = raw[np.r_[True, ~(space[1:] & space[:-1])]]
        at = np.flatnonzero(raw == 32) + 1
        if self.known is None:
            numbers = np.fromiter(map(self.vocabulary.get, raw.tobytes().split(), repeat(-1)), np.int64, len(at) - 1)
        else:
            words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])
            numbers = pa.compute.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        border = np.flatnonzero(raw[at[:-1]] == 1)
        return numbers, np.r_[0, border[1::2] + 1], np.r_[border[::2], len(numbers)]

    def pairs(self, words: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, rows of by_pair) of the pairs of words so far apart that an item has."""
        keys = words[:-distance] << 21 | words[distance:]
        at = np.flatnonzero(self.sieve[self.slots(keys)])
        return self.look_up(self.by_pair[0], keys[at], at)

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, seed numbers) of all seeds; at: places of the neighbours that an item has."""
        at = at[:-1][at[1:] == at[:-1] + 1]
        return self.look_up(self.key, self.trigrams(words, at), at)

    def occurring(self, texts: list[str | None]) -> np.ndarray:
        """Seed numbers of all texts, each once a text."""
        words, _, ends = self.number(texts)
        at, seeds = self.hits(words, self.pairs(words, 1)[0])
        return np.unique(np.searchsorted(ends, at, side="right") * len(self.key) + seeds) % max(1, len(self.key))

    def stretches(self, code: np.ndarray, p: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Starts of the runs of sorted places of one code without a gap over the item's reach."""
        new = np.zeros(len(p), bool)
        new[:1] = True
        new[1:] = (code[1:] != code[:-1]) | (p[1:] - p[:-1] > self.reaches * self.sizes[item[1:]])
        return np.flatnonzero(new)

    def seeded(self, text: np.ndarray, p: np.ndarray, seeds: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
        """(texts, items, first, last places) of the stretches of seeds of an item, where a text has three of them or a rare one."""
        n = self.owners[0][seeds + 1] - self.owners[0][seeds]
        item, at = self.spread(*self.owners, seeds, np.arange(len(seeds)))
        order = np.lexsort((at, item, np.repeat(text, n)))
        item, at = item[order], at[order]
        text, p, seeds = text[at], p[at], seeds[at]
        code = text * len(self.items) + item
        groups = starts_of(code)
        of = numbers_of(groups, len(code))
        by_seed = np.lexsort((seeds, of))
        different = np.bincount(of[by_seed[starts_of(of[by_seed], seeds[by_seed])]], minlength=len(groups))
        keep = ((different >= 3) | (np.bincount(of, ~common[seeds], minlength=len(groups)) > 0))[of]
        text, item, p, code = text[keep], item[keep], p[keep], code[keep]
        first = self.stretches(code, p, item)
        return text[first], item[first], p[first], p[ends_of(first, len(p)) - 1]

    def near(self, text: np.ndarray, g: np.ndarray, p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """(texts, items, first, last places) of the stretches of hits that by themselves allow the threshold; g: the places of hits in the items, v: what they add to 2a + b."""
        bits = len(self.item_of).bit_length()
        total, most = self.most(text << bits | g, v)
        item = self.item_of[total & (1 << bits) - 1]
        code = (total >> bits) * len(self.items) + item
        groups = starts_of(code)
        some = np.add.reduceat(most, groups) >= self.need[item[groups]] if len(groups) else np.zeros(0, bool)
        hit, _ = self.look_up(code[groups[some]], text * len(self.items) + self.item_of[g], np.arange(len(g)))
        hit = hit[np.lexsort((p[hit], self.item_of[g[hit]], text[hit]))]
        text, g, p, v = text[hit], g[hit], p[hit], v[hit]
        item = self.item_of[g]
        first = self.stretches(text * len(self.items) + item, p, item)
        if not len(first):
            return text, item, p, p
        of = numbers_of(first, len(p))
        total, most = self.most(of << bits | g, v)
        enough = np.bincount(total >> bits, most, minlength=len(first)) >= self.need[item[first]]
        return text[first][enough], item[first][enough], p[first][enough], p[ends_of(first, len(p)) - 1][enough]

    @staticmethod
    def most(keys: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, the most of v at each)."""
        both = np.sort(keys << 2 | v)
        both = both[np.r_[both[1:] >> 2 != both[:-1] >> 2, np.ones(min(1, len(both)), bool)]]
        return both >> 2, both & 3

    def candidates(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, common: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, ...]:
        """(texts, items, first, last places) of all that is to be aligned. Texts are taken together up to that many hits."""
        rows = [(*self.pairs(words, d), self.by_pair) for d in (1, 2)]
        if len(self.by_word[0]):
            rows.append((*self.look_up(self.by_word[0], words, np.arange(len(words))), self.by_word))
        text_of = lambda at: np.searchsorted(ends, at, side="right")
        at, seeds = self.hits(words, rows[0][0])
        out = [self.seeded(text_of(at), at, seeds, common)]
        load = np.zeros(len(ends) + 1)
        for at, k, postings in rows:
            load[1:] += np.bincount(text_of(at), np.diff(postings[1])[k], minlength=len(ends))
        load, a = np.cumsum(load), 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(load, load[a] + most, side="right")) - 1)
            found = []
            for d, (at, k, postings) in enumerate(rows, 1):
                i, j = np.searchsorted(at, (starts[a], ends[b - 1]))
                g, p = self.spread(*postings[1:], k[i:j], at[i:j])
                found.append((g >> 1, p, 1 + (g & 1) if d == 1 else np.ones_like(g)) if d < 3 else (g, p, np.zeros_like(g)))
            g, p, v = map(np.concatenate, zip(*found, strict=True))
            out.append(self.near(text_of(p), g, p, v))
            a = b
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def best(self, texts: list[str | None], common: np.ndarray) -> tuple[list[int | None], list[float]]:
        """Items of the best alignments and their scores; common: which seeds are too frequent to count alone."""
        words, starts, ends = self.number(texts)
        which, best = [None] * len(texts), [0.0] * len(texts)
        if not self.items:
            return which, best
        text, item, first, last = self.candidates(words, starts, ends, common)
        reach = self.reaches * self.sizes[item]
        first, last = np.maximum(starts[text], first - reach), np.minimum(ends[text], last + N + reach)
        order = np.lexsort((-last, first, item, text))
        text, item, first, last = text[order], item[order], first[order], last[order]
        groups = starts_of(text, item)  # a window inside another of the same item gives no more
        far = last + numbers_of(groups, len(text)) * (len(words) + 1)
        widest = np.ones(len(far), bool)
        widest[1:] = far[1:] > np.maximum.accumulate(far)[:-1]
        text, item, first, last = text[widest], item[widest], first[widest], last[widest]
        score = align_all([self.items[k][1] for k in item.tolist()], [words[i:j] for i, j in zip(first.tolist(), last.tolist(), strict=True)]) / (2 * self.sizes[item])
        for k in np.lexsort((item, -score, text))[::-1].tolist():  # the best of a text comes last, of equal ones the first item
            if score[k] > 0:
                which[text[k]], best[text[k]] = self.items[item[k]][0], float(score[k])
        return which, best


def frequencies(docs: DataFrame, shared) -> tuple[np.ndarray, int]:
    """Document frequency of every seed and the number of documents; the driver gets a number a seed at most."""
    def run(batches):
        df, n = np.zeros(len(shared.value.key), np.int64), 0
        for b in in_blocks(batches, BLOCK):
            df += np.bincount(shared.value.occurring(b.column(0).to_pylist()), minlength=len(df))
            n += len(b)
        if n:
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_pydict({"seed": np.r_[-1, some], "n": np.r_[n, df[some]]})

    rows = docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(len(shared.value.key), np.int64), 0
    for r in rows:
        if r["seed"] < 0:
            total = r["n"]
        else:
            out[r["seed"]] = r["n"]
    return out, total


def blocks(benchmark: DataFrame, block_chars: int):
    """Lists of (item id, text); only one is held at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("t is not null")
    held, chars, words = [], 0, 0
    for r in items.orderBy(F.asc_nulls_last("i"), "t").toLocalIterator():
        n = len(words_of(r["t"]))
        if held and (chars + len(r["t"]) > block_chars or words + n >= 1 << 21):
            yield held
            held, chars, words = [], 0, 0
        held.append((r["i"], r["t"]))
        chars, words = chars + len(r["t"]), words + n
    if held:
        yield held


def prepared(docs: DataFrame, items: list[tuple[int, str]], rare: float, threshold: float):
    """Broadcasts of a block's seeds and of which are common in docs(text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Seeds(items, threshold))
    df, n = frequencies(docs, shared)
    return shared, spark.sparkContext.broadcast(df > max(1.0, rare * n))


def score_block(docs: DataFrame, shared, common) -> DataFrame:
    """docs(doc_id, text, item_id, score): the better of what stands there and this block's best."""
    def run(batches):
        for b in in_blocks(batches, BLOCK):
            which, score = b.column(2).to_pylist(), b.column(3).to_pylist()
            for k, (i, s) in enumerate(zip(*shared.value.best(b.column(1).to_pylist(), common.value), strict=True)):
                if s > score[k] or (s == score[k] and i is not None and (which[k] is None or i < which[k])):
                    which[k], score[k] = i, s
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(which, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "text", "item_id", "score"])

    return docs.mapInArrow(run, "doc_id long, text string, item_id long, score double")


def contamination(docs: DataFrame, benchmark: DataFrame, rare: float = 0.001, block_chars: int = 16 << 20, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, contaminated) per row of docs; item_id is null where nothing aligns, and where the best item has no id (score and contaminated are then its). Items without a text are none; equal items count as one, equal scores give the smaller id."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out, path = source.select("doc_id", "text", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("score")), None
    for k, items in enumerate(blocks(benchmark, block_chars)):
        if k:
            last, path = path, new_path(docs.sparkSession, "scores")
            out = cut(out, "scores", path)
            if last:
                remove(docs.sparkSession, last)
        out = score_block(out, *prepared(source.select("text"), items, rare, threshold))
    return out.select("doc_id", "item_id", "score", (F.col("score") >= threshold).alias("contaminated"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, rare: float = 0.001, block_chars: int = 16 << 20, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose text is not contaminated, with their columns as they are; ids play no part."""
    out, path, at = docs, None, docs.columns.index(text_col)
    for k, items in enumerate(blocks(benchmark, block_chars)):
        if k:
            last, path = path, new_path(docs.sparkSession, "clean")
            out = cut(out, "clean", path)
            if last:
                remove(docs.sparkSession, last)
        shared, common = prepared(docs.select(F.col(text_col).alias("text")), items, rare, threshold)

        def run(batches, shared=shared, common=common):
            for b in in_blocks(batches, BLOCK, text=text_col):
                keep = [s < threshold for s in shared.value.best(b.column(at).to_pylist(), common.value)[1]]
                yield b.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated rows; all others stay as they are, also those without an id or with the id of a dropped one."""
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))
