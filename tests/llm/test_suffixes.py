import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import suffixes


def brute(rows, length):
    """(n_bytes, n_removed, n_spans, kept) by row of rows sorted in order."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        n_spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß ") for _ in range(r.randint(2, 9))) for _ in range(80)]
    make = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [make(30) for _ in range(4)]
    out = [None, "", "a" * 99, "a" * 100, "a" * 350, "ab" * 200]
    for _ in range(n):
        x = make(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, 40)
            x += p[cut : len(p) - r.randint(0, 40)] + make(r.randint(0, 6))
        out.append(x)
    out += out[8:14]
    out.append(out[10][:150] + "!" + out[10][150:])
    return out


@pytest.mark.parametrize("most", [20_000, 3])
def test_matches_brute_force(spark, most):
    rows = texts(5)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, seq string").repartition(3)
    out = suffixes.remove_repeats(docs, most=most)
    got = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect()}
    want = dict(enumerate(brute(rows, 100)))
    assert got == want
    assert sum(w[1] for w in want.values()) > 1000


def test_repeated_and_null_ids(spark):
    x, y = "".join(map(chr, range(65, 90))) * 5, "q" * 40
    docs = spark.createDataFrame([(2, x), (2, y + x), (None, x), (1, y), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"])) for r in suffixes.remove_repeats(docs).collect()))
    # in order: 1, 2 (x), 2 (y + x), null (null text), null (x); x itself repeats with period 25
    assert got == [(False, 1, 40, 0), (False, 2, 125, 100), (False, 2, 165, 125), (True, 0, 0, 0), (True, 0, 125, 125)]


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_orders_suffixes():
    r = random.Random(1)
    for _ in range(100):
        s = [r.randint(1, r.choice((2, 3, 90))) for _ in range(r.randint(0, 50))] + [0]
        assert suffixes.suffix_array(s, 258).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_permuted_common_prefixes():
    r = random.Random(4)
    for k in range(120):
        s = [r.randint(1, r.choice((1, 2, 3, 90))) for _ in range(r.choice((0, 1, 30, 400)))] + [0]
        if k % 3 == 0:
            s = s[:-1] * 3 + [0]
        sa = suffixes.suffix_array(s, 258)
        want = [0] * len(s)
        for a, b in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            while s[a + want[a]] == s[b + want[a]]:
                want[a] += 1
        assert suffixes.common_prefixes(np.array(s, np.int32), sa).tolist() == want


def test_query(spark):
    out = suffixes.op8_suffix_dedup(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows], 100), strict=True))
    got = {r["doc_id"]: tuple(r)[1:] for r in out.where(F.col("n_bytes") >= 0).collect()}
    assert got == want
