"""Decontamination judges the texts of a batch together."""

import cProfile
import pstats
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lexigraph.llm import decontaminate


def corpus(seed: int, n: int):
    r = random.Random(seed)
    word = lambda: f"c{r.randrange(40)}" if r.random() < 0.7 else f"w{r.randrange(500)}"
    items = [(k, " ".join(word() for _ in range(r.choice([1, 2, 3, 8, 20, 40])))) for k in range(60)]
    texts = [None, "", " \x01 ", "a"]
    while len(texts) < n:
        middle = r.choice(items)[1].split() if r.random() < 0.3 else []
        texts.append(" ".join([word() for _ in range(r.randrange(60))] + [w if r.random() < 0.9 else word() for w in middle] + [word() for _ in range(r.randrange(60))]))
    return items, texts


def scored(items, texts, common=None):
    """What a task makes of one batch, without Spark."""
    seeds = decontaminate.Seeds(items)
    common = np.zeros(len(seeds.key), bool) if common is None else common
    run = decontaminate.score_block(SimpleNamespace(mapInArrow=lambda run, schema: run), SimpleNamespace(value=seeds), SimpleNamespace(value=common))
    empty = [pa.array([None] * len(texts), pa.int64()), pa.array([0.0] * len(texts))]
    out = list(run([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), *empty], ["doc_id", "text", "item_id", "score"])]))
    return [x for b in out for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]


def test_calls_do_not_grow_with_the_texts():
    items, texts = corpus(1, 1200)
    scored(items, texts[:9])  # imports are not counted
    calls = []
    for part in (texts[:600], texts):
        profile = cProfile.Profile()
        profile.runcall(scored, items, part)
        calls.append(pstats.Stats(profile).total_calls)
    assert (calls[1] - calls[0]) / 600 < 60


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_texts_together_give_what_each_gives_alone(monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW", few, raising=False)
    items, texts = corpus(2, 150)
    for common in (None, np.random.default_rng(0).random(len(decontaminate.Seeds(items).key)) < 0.8):
        got = scored(items, texts, common)
        assert got == [scored(items, [t], common)[0] for t in texts]
        assert sum(s >= decontaminate.THRESHOLD for _, s in got) > 20 and {s for _, s in got[:3]} == {0.0}


def test_nothing_goes_over_the_border_of_two_texts():
    item = "alpha beta gamma delta epsilon zeta eta theta"
    words = item.split()
    for k in range(1, 8):
        texts = [" ".join(words[:k]), " ".join(words[k:])]
        assert [s for _, s in scored([(1, item)], texts)] == [scored([(1, item)], [t])[0][1] for t in texts]
    assert scored([(1, "one two")], ["one", "two", "one", None, "two"]) == [(1, 0.5), (1, 0.5), (1, 0.5), (None, 0.0), (1, 0.5)]


def test_hits_taken_in_small_portions_give_the_same():
    items, texts = corpus(3, 120)
    seeds = decontaminate.Seeds(items)
    common = np.ones(len(seeds.key), bool)
    words, starts, ends = seeds.number(texts)
    want = sorted(zip(*map(np.ndarray.tolist, seeds.candidates(words, starts, ends, common)), strict=True))
    for most in (1, 40):
        assert want and sorted(zip(*map(np.ndarray.tolist, seeds.candidates(words, starts, ends, common, most=most)), strict=True)) == want


def test_alignments_together_match_single_ones():
    r = np.random.default_rng(5)
    items = [r.integers(0, 5, r.integers(1, 30)) for _ in range(80)]
    windows = [r.integers(-1, 6, r.integers(0, 90)) for _ in range(80)]
    for cells in (1, 300, 1 << 14):
        assert decontaminate.align_all(items, windows, cells=cells).tolist() == [decontaminate.align(i, w) for i, w in zip(items, windows, strict=True)]
    assert decontaminate.align(items[0][:0], windows[0]) == 0
