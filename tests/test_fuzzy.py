"""Matching blocks against the standard library on all pairs; search against edit distances to every stretch."""

import difflib
import random

import pyarrow as pa
import pytest

from lexigraph.functions import text as T
from lexigraph.operators import fuzzy


def word(r, n, letters="abcde "):
    return "".join(r.choice(letters) for _ in range(n))


def test_ratio_is_the_librarys():
    r = random.Random(1)
    for _ in range(3000):
        a, b = word(r, r.randrange(0, 14), "abc"), word(r, r.randrange(0, 14), "abc")
        assert fuzzy.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
    for n in (150, 199, 200, 260, 420):
        for _ in range(12):
            b = word(r, n, "abcdefghijklmnopqrstuvwxyz" * 3 + "".join(map(chr, range(200, 400))))
            a = b[: n // 3] + word(r, 40) + b[n // 2 :]
            assert fuzzy.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.55, 0.8])
def test_best_matches_equal_all_pairs(spark, least, monkeypatch):
    monkeypatch.setattr(fuzzy, "ROWS", 16)
    r = random.Random(2)
    base = [word(r, r.choice((3, 5, 8, 13, 30, 60))) for _ in range(60)]
    near = ["".join(c if r.random() > 0.25 else r.choice("abcdeX") for c in b) for b in base]
    left = [(i, t) for i, t in enumerate([*near, "", "abcde", None, base[4]])] + [(None, "abc")]
    right = [(1000 + i, t) for i, t in enumerate([*base, "", "aXcYe", base[7], None])]
    frame = lambda rows: spark.createDataFrame([(i, -i if i is not None else 0, t, "x") for i, t in rows], "id long, order long, text string, more string")
    got = {x["id"]: (x["match"], x["score"]) for x in fuzzy.best_matches(frame(left), frame(right), least).collect()}
    want = {}
    for i, a in left:
        if i is None or a is None:
            continue
        scored = sorted((-difflib.SequenceMatcher(None, a, b).ratio(), -j, j) for j, b in right if b is not None)
        if -scored[0][0] >= least:
            want[i] = (scored[0][2], -scored[0][0])
    assert got == want and len(want) > 30
    assert fuzzy.best_matches(frame(left).where("false"), frame(right), least).count() == 0


def edits(pattern, text):
    """The least edit distance to any stretch, by the usual table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, c in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != c))
    return min(row)


def test_errors_by_the_table():
    r = random.Random(3)
    texts = [word(r, r.randrange(0, 40), "abcé𝒳") for _ in range(300)] + ["", None, "abc" * 500]
    for pattern in ("a", "abc", "abcabcé", "𝒳a" * 9):
        for most in (0, 1, 3):
            got = fuzzy.errors(pa.array(texts), pattern, most)
            assert got.tolist() == [min(most + 1, edits(pattern, t or "")) for t in texts]


def test_search_over_fields(spark):
    rows = [(1, "casino night", "x", None), (2, "", "the cas ino", "nothing here"), (3, None, None, None), (4, "CASNIO", "casnio", "casnio"), (5, "cat", "sin", "no")]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    got = {r["id"]: r["score"] for r in fuzzy.search(df, "casnio", {"a": 2.0, "b": 1.0, "c": 1.0}).collect()}
    want = {}
    for i, *fields in rows:
        score, hit = 1.0, False
        for text, weight in zip(fields, (2.0, 1.0, 1.0), strict=True):
            e = edits("casnio", (text or "").lower())
            if text and e <= 2:
                score, hit = score * max(0.001, e / 6) ** (weight / 4 * round(1 / len(text.split()) ** 0.5, 3)), True
        if hit:
            want[i] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and min(got, key=got.get) == 4
    with pytest.raises(ValueError):
        fuzzy.search(df, "", {"a": 1.0})


def test_language_rules(spark):
    rows = ["the sky", "the la la la", "the la", "qué", "cómo está", "よる", "x", "", None, "12 34", "ñandú", "je ne sais pas", "brrr zzz"]
    want = ["OTHER", "MIXED", "OTHER", "ES", "ES", "JA", "OTHER", "OTHER", "OTHER", "OTHER", "OTHER", "FR", "OTHER"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, t string")
    got = {r["id"]: (r["d"]["lang"], r["d"]["confidence"], r["f"]) for r in df.select("id", T.detect(df.t).alias("d"), T.detect_first(df.t).alias("f")).collect()}
    assert [got[i][0] for i in range(len(rows))] == want
    assert [got[i][1] for i in (0, 1, 3, 5)] == [0.0, 0.7, 0.85, 1.0]
    assert [got[i][2] for i in (0, 1, 5, 6, 11, 12)] == ["EN", "MIXED", "JA", "OTHER", "FR", "OTHER"]
