"""Toxicity by weak supervision.

Voters: fixed insult words, learned word beginnings, and surface patterns, which fire by themselves. A toxic learned voter is a word beginning whose documents in the training rows are
toxic far more often than not, a clean one a beginning whose documents are hardly ever; texts that share their least word hashes (copies and most near copies) count once there. Votes are
fires or abstentions on a row. A generative label model estimates by EM, from the votes alone, how often each voter fires in either class (its accuracy, which is taken to be on the side
that the voter stands for) and, from what is left of the joint firing within a class, the correlation of each pair; a voter's evidence is divided by the correlation it has with all
voters, itself included, so that beginnings of one word do not count several times. The labels of the training rows choose the learned voters, give the classes' shares and set the cut; they
do not vote. The posterior labels train a linear classifier (logistic regression on which voters fire and how densely), which scores every text whole, however long.

Training takes a bounded sample of labelled rows (`most` rows, parameter) with both classes in the table's proportion; without a toxic row or without a clean one, as in empty tables, the
fixed words alone decide. Null and empty texts fire no lexicon voter and get the model's score for that. Repeated rows get repeated scores, whatever their ids; an id with several labels
counts as toxic if one is. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_col, in_blocks, table

#: Common insults in English.
INSULTS = ["clown", "disgusting", "dumb", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "worthless"]
WORD = re.compile(r"[^\W\d_]+")
CAPITALS = re.compile(r"\b[A-Z]{4,}\b")
#: Words that address somebody.
SECOND = frozenset("you your du dein vous votre usted tu".split())


def stretched(text: str) -> bool:
    """A letter of a-z three times in a row."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) | 32
    return bool(((b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (b[2:] >= 97) & (b[2:] <= 122)).any())


#: Patterns of a text and its words, each with the class that it votes for.
PATTERNS = [
    (lambda text, words: "!!" in text or CAPITALS.search(text) is not None, 1),
    (lambda text, words: not SECOND.isdisjoint(words), 1),
    (lambda text, words: stretched(text), 1),
    (lambda text, words: "!" not in text, 0),
]
LENGTHS = (3, 4, 5, 6, 7)
THRESHOLD = 0.3


def beginnings(text: str | None) -> set[str]:
    """Distinct words (marked at the end) and word beginnings."""
    out = set()
    for w in set(WORD.findall((text or "").lower())):
        out.add(w + "$")
        for n in LENGTHS:
            if len(w) >= n:
                out.add(w[:n])
    return out


class Voters:
    """Which voters fire on a text, as indices. 0 .. len(INSULTS) - 1: fixed words; then learned beginnings, toxic and clean; then the patterns. side: the class each votes for."""

    def __init__(self, learned: list[str], clean: list[str] = ()):
        self.words = {w: i for i, w in enumerate(INSULTS)}
        self.learned = {w: len(INSULTS) + i for i, w in enumerate([*learned, *clean])}
        self.n_toxic = len(INSULTS) + len(learned)
        self.size = len(INSULTS) + len(self.learned) + len(PATTERNS)
        self.side = np.array([1] * self.n_toxic + [0] * len(clean) + [c for _, c in PATTERNS])
        self.lengths = sorted({len(w) for w in self.learned if not w.endswith("$")})

    def fires(self, text: str | None) -> tuple[list[int], int]:
        """Voters that fire, and the number of words any toxic lexicon voter fires on."""
        text = text or ""
        on, hits = set(), 0
        words = Counter(WORD.findall(text.lower()))
        for w, n in words.items():
            here = [self.words[w]] if w in self.words else []
            if (k := self.learned.get(w + "$")) is not None:
                here.append(k)
            for m in self.lengths:
                if (k := self.learned.get(w[:m])) is not None and len(w) >= m:
                    here.append(k)
            if here:
                on.update(here)
                hits += n * (min(here) < self.n_toxic)
        on.update(self.size - len(PATTERNS) + k for k, (f, _) in enumerate(PATTERNS) if f(text, words))
        return sorted(on), hits


def group_of(text: str | None) -> tuple:
    """What copies and most near copies share: the least hashes of a text's words."""
    return tuple(sorted(zlib.crc32(w.encode()) for w in set(WORD.findall((text or "").lower())))[:3])


def learn_lexicon(rows: list[tuple[str, int]], least: int = 5, odds: float = 2.5, most: int = 400) -> tuple[list[str], list[str]]:
    """Toxic and clean word beginnings. Toxic: the smoothed log odds between toxic and clean rows are at least `odds`, supported by `least` toxic rows
    and too many to be chance among all beginnings seen. A longer one is kept only if its shorter forms are not as clear. Clean: in hardly any toxic row, and that is no chance either."""
    one = {(group_of(text), label): text for text, label in rows}
    toxic, clean, n = Counter(), Counter(), [0, 0]
    for (_, label), text in one.items():
        n[label] += 1
        (toxic if label else clean).update(beginnings(text))
    least = max(2, min(least, n[1] // 20))
    share = n[1] / max(1, n[0] + n[1])
    chance = np.log(20 * max(1, len(toxic)))  # about one in twenty lexicons then has a word by chance

    def evidence(a: int, b: int) -> float:
        rate = a / (a + b)
        return (a * np.log(rate / share) if a else 0) + (b * np.log((1 - rate) / (1 - share)) if b else 0)

    score = {}
    for w, a in toxic.items():
        s = np.log((a + 0.1) / (n[1] + 1)) - np.log((clean[w] + 0.5) / (n[0] + 1))
        if a >= least and s >= odds and clean[w] <= 0.3 * a and evidence(a, clean[w]) >= chance:
            score[w] = (a, s)
    kept = [w for w in score if not any(w[:m] in score and score[w[:m]][1] >= score[w][1] - 0.5 for m in LENGTHS if m < len(w.rstrip("$")) or (w.endswith("$") and m == len(w) - 1))]
    calm = [w for w, b in clean.items() if toxic[w] <= 0.2 * share * b and evidence(toxic[w], b) >= chance and w not in INSULTS]
    return sorted(kept, key=lambda w: (-score[w][0], w))[:most], sorted(calm, key=lambda w: (-clean[w], w))[: most // 8]


def label_model(votes: np.ndarray, side: np.ndarray, share: float, rounds: int = 20, floor: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, fire rates by class, correlations of the voters), by EM from votes (rows x voters, bool). It starts from the side that more and rarer voters fire for; share is
    class 1's. At first only voters that nearly always fire together share their evidence, as the others seem correlated until the classes have come apart. Weak correlations
    count as none: at `floor` or below."""
    v, toxic = votes.astype(float), side == 1
    lead = v @ (-np.log((v.sum(axis=0) + 1) / (len(v) + 1)) * np.where(toxic, 1, -1))
    post = np.full(len(v), share / 4)
    post[np.argsort(-lead, kind="stable")[: max(1, round(share * len(v)))]] = 0.9
    sign = np.where(toxic, 1, -1)
    for k in range(rounds):
        weight = np.stack([1 - post, post])
        rates = np.clip((weight @ v + 0.05) / (weight.sum(axis=1, keepdims=True) + 1), 1e-6, 1 - 1e-6)
        rest = [(v - rates[c]) * np.sqrt(weight[c])[:, None] for c in (0, 1)]
        cov = sum(r.T @ r for r in rest)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        correlation = cov / scale / scale[:, None]
        correlation[np.abs(correlation) <= (floor if k >= rounds // 2 else 0.9)] = 0
        np.fill_diagonal(correlation, 1)
        mass = np.abs(correlation).sum(axis=1)
        on = sign * np.maximum(0, sign * (np.log(rates[1]) - np.log(rates[0]))) / mass
        off = sign * np.minimum(0, sign * (np.log1p(-rates[1]) - np.log1p(-rates[0]))) / mass
        logit = np.log(share / (1 - share)) + v @ on + (1 - v) @ off
        post = np.clip(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 1e-3, 1 - 1e-3)
    return post, rates, correlation


def features(voters: Voters, text: str | None) -> tuple[list[int], float]:
    on, hits = voters.fires(text)
    return on, np.log1p(hits)


def fit_linear(x: np.ndarray, post: np.ndarray, l2: float = 3e-4, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Nesterov steps; deterministic."""
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    rate = 4 / max(1.0, (x**2).sum(axis=1).mean() + 1)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30)))
        g = (p - post) / len(x)
        nw, nb = vw - rate * (x.T @ g + l2 * vw), vb - rate * g.sum()
        m = k / (k + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def best_shift(logit: np.ndarray, labels: np.ndarray) -> float:
    """What to add to the logits so that THRESHOLD cuts the labelled rows with the best F1; the cut lies midway between neighbouring rows."""
    order = np.argsort(-logit, kind="stable")
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + labels.sum())
    f1[:-1][logit[order][:-1] == logit[order][1:]] = -1  # equal scores are not cut apart
    k = int(f1.argmax())
    low = logit[order[k + 1]] if k + 1 < len(order) else logit[order[k]] - 2
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (logit[order[k]] + low) / 2)


class Model:
    def __init__(self, rows: list[tuple[str, int]]):
        labels = np.array([y for _, y in rows], int)
        self.plain = not len(labels) or labels.min() == labels.max()
        self.voters = Voters(*(([], []) if self.plain else learn_lexicon(rows)))
        n = self.voters.size
        if self.plain:
            self.w, self.b = np.r_[np.full(len(INSULTS), 2.0), np.zeros(len(PATTERNS)), 1.0], -3.0
            return
        votes, dense = np.zeros((len(rows), n), bool), np.zeros(len(rows))
        for i, (text, _) in enumerate(rows):
            on, dense[i] = features(self.voters, text)
            votes[i, on] = True
        self.post, self.rates, self.correlation = label_model(votes, self.voters.side, labels.mean())
        mass = np.maximum(1, np.abs(self.correlation).sum(axis=1))
        x = np.c_[votes / np.sqrt(mass), dense]
        self.w, self.b = fit_linear(x, self.post)
        self.b += best_shift(x @ self.w + self.b, labels)
        self.w[:n] /= np.sqrt(mass)

    def score(self, text: str | None) -> float:
        on, dense = features(self.voters, text)
        return float(1 / (1 + np.exp(-np.clip(self.w[on].sum() + self.w[-1] * dense + self.b, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, longest: int = 20_000) -> Model:
    """Fits on at most `most` labelled rows outside the held-out fold, those of smallest id hash, at one rate for both classes, so that lexicon, prior and cut see the share of toxic rows that
    the table has; rows over `longest` characters are not fitted on."""
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("y")).where("i is not null and y in (0, 1)").where(fold_col(F.col("i"), 4) != 2)
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    cells = 1 << 20
    share = int(min(1.0, most / max(1, known.count())) * cells)
    some = known.where(F.pmod(F.xxhash64("i", F.lit(11)), F.lit(cells)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= longest))
    rows = texts.join(F.broadcast(some), "i").limit(2 * most)  # some has about `most` rows of two integers
    return Model(sorted((r["t"], r["y"]) for r in rows.toLocalIterator()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in in_blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score(x) for x in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold_col(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject, with their columns as they are."""
    model = spark.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            keep = [model.value.score(x) < THRESHOLD for x in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
