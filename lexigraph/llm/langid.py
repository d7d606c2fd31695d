"""Language identification by segmentation-marginalised unigrams.

Each language has a unigram distribution over the pieces of a fixed public vocabulary, fitted by expectation maximisation on a bounded sample
of labelled training rows. A word's probability sums those of all its segmentations (forward algorithm); a text's is the product over
its words, whole text. The prediction is the language of highest posterior, the score that posterior.

Training rows are cut into stretches of `longest` characters, so that a long row is learned from like any other; about `per_lang` stretches of each language are fitted on, chosen by
hash. Every language of the training rows is learned; more than `languages` of them raise an error, as the model has a number for each piece and language.

`und` with score 0 where the text is null or has no letter (Unicode category L), or no training row exists, as in an empty table. Ties go to the language that sorts
first. Repeated rows give repeated results. Long texts are scored whole. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_col, in_blocks, table
from .lattice import default_model, edge_weights, numbers, units, vocabulary

LETTER = regex.compile(r"\p{L}")
HELD: dict = {}  # the scores that the tasks of a worker process share, by model


class WordScores:
    """log probability of words by language; keeps up to `most` numbers, 20,000 words at least."""

    def __init__(self, path: str, table: np.ndarray, most: int = 1 << 21):
        self.v, self.table, self.most = vocabulary(path), table, max(20_000, most // max(1, table.shape[1]))
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, table.shape[1]))

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.most:
            self.index = {}
        out = numbers(self.index, words)
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            new = list({words[k] for k in missing})  # their order has no effect on results
            base = len(self.index)
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
            if base + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores[:base], np.zeros((base + 2 * len(new), self.scores.shape[1]))])
            for at in range(0, len(new), 5000):  # so few that their nodes are ranked by radix
                lat = self.v.lattice(new[at : at + 5000])
                self.scores[base + at : base + at + len(lat.ends)] = lat.forward(edge_weights(self.v, self.table, lat.piece))[lat.ends]
            out[missing] = numbers(self.index, [words[k] for k in missing])
        return out


def fit(counts: dict[str, Counter], path: str, rounds: int = 3, smooth: float = 200.0) -> tuple[list[str], np.ndarray]:
    """Languages and the log probabilities of pieces, by EM from word counts."""
    v = vocabulary(path)
    langs = sorted(counts)
    words = sorted(set().union(*counts.values()))
    n = np.array([[counts[g][w] for g in langs] for w in words], float)
    blocks = []
    for at in range(0, len(words), 5000):
        lat = v.lattice(words[at : at + 5000])
        blocks.append((lat, np.argsort(lat.starts)[lat.rank[lat.src]] + at))
    table = np.full((v.size, len(langs)), -np.log(v.size))
    for _ in range(rounds):
        seen = np.zeros_like(table)
        for lat, word in blocks:
            weight = edge_weights(v, table, lat.piece)
            a, b = lat.forward(weight), lat.backward(weight)
            post = np.exp(a[lat.src] + weight + b[lat.dst] - b[lat.rank[lat.src]]) * n[word]  # a word's first node has its rank
            regular = lat.piece < v.size
            for g in range(len(langs)):
                seen[:, g] += np.bincount(lat.piece[regular], post[regular, g], v.size)
            for k in np.flatnonzero(~regular).tolist():
                np.add.at(seen, v.bytes_of(int(lat.piece[k]) - v.size), post[k])
        shared = seen.sum(axis=1) + 0.5
        shared /= shared.sum()
        p = seen + smooth * shared[:, None]
        table = np.log(p / p.sum(axis=0))
    return langs, table


def training_words(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, longest: int, languages: int) -> dict[str, Counter]:
    """Word counts of about per_lang stretches of each language, those of smallest hash of id and place."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("g")).where("t is not null and g is not null")
    rows = rows.withColumn("n", F.ceil(F.greatest(F.length("t"), F.lit(1)) / longest).cast("int"))
    sizes = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.sum("n").alias("n")).limit(languages + 1).collect()}
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages; pass a larger bound if they are meant")
    if not sizes:
        return {}
    cells = 1 << 20
    share = F.element_at(F.create_map(*(F.lit(x) for g, n in sizes.items() for x in (g, int(min(1.0, per_lang / n) * cells)))), F.col("g"))
    each = rows.select("i", "t", "g", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).where(F.pmod(F.xxhash64("i", "k", F.lit(7)), F.lit(cells)) < share)
    # ids that repeat without end could pass the hash together; the limit is far above what else comes
    some = each.select(F.substring("t", F.col("k") * longest + 1, F.lit(longest)).alias("t"), "g").limit(2 * per_lang * len(sizes) + 1000)
    counts: dict[str, Counter] = {}
    for r in some.toLocalIterator():
        counts.setdefault(r["g"], Counter()).update(units(r["t"]))
    return counts


def predict(docs: DataFrame, langs: list[str], weights: np.ndarray, prior: np.ndarray, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score). The model has pieces x languages numbers; both are bounded by parameters."""
    model = docs.sparkSession.sparkContext.broadcast((langs, weights, prior))
    name = uuid.uuid4().hex

    def run(batches):
        langs, weights, prior = model.value
        if langs and name not in HELD:
            HELD.clear()
            HELD[name] = WordScores(path, weights)
        scores = HELD.get(name)
        for b in in_blocks(batches, 2 << 20):
            texts = b.column(1).to_pylist()
            known = [len(langs) > 0 and x is not None and LETTER.search(x) is not None for x in texts]
            words, ends = [], []
            for x, k in zip(texts, known, strict=True):
                if k:
                    words += units(x)
                    ends.append(len(words))
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if ends:
                rows = scores.rows(words)
                total = np.add.reduceat(scores.scores[rows], np.array([0, *ends[:-1]])) + prior
                best = total.argmax(axis=1)
                top = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                at = np.flatnonzero(known)
                score[at] = top
                for i, g in zip(at.tolist(), best.tolist(), strict=True):
                    lang[i] = langs[g]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(train: DataFrame, docs: DataFrame, path: str | None = None, per_lang: int = 300, longest: int = 20_000, languages: int = 1000) -> DataFrame:
    """Fits on train(doc_id, text, lang) and predicts docs(doc_id, text)."""
    path = path or default_model()
    counts = training_words(train, "doc_id", "text", "lang", per_lang, longest, languages)
    if not counts:
        return predict(docs, [], np.zeros((1, 0)), np.zeros(0), path)
    langs, weights = fit(counts, path)
    return predict(docs, langs, weights, np.zeros(len(langs)), path)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.where(fold_col(F.col("doc_id"), 3) != 1), docs)
    return out.withColumn("held_out", fold_col(F.col("doc_id"), 3) == 1)
