"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; brute-force versions and round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexigraph.llm import decontaminate, langid, lattice, licenses, mpegts, segsample, simhash, toxicity, warc, wavelet

LONG = " ".join(f"word{i % 977}x" for i in range(30_000))
TEXTS = [None, "", " ", "a", "the mit license\nand the Apache License", "né ñandú ▁ \t\r\n x", LONG, LONG + " end", "日本語 𝒳 <|endoftext|>", "dup text here", "dup text here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "src", len(t or ""), i, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id at all", None, None, None, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, seq string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_media(docs, empty):
    rows = mpegts.media_features(mpegts.to_media(docs)).collect()
    assert len(rows) == len(TEXTS) + 2
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        for r in by_id(rows)[i]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            assert "jumps=0;lost=0;tables=ok" in r["feature"] and r["media_bytes"] % 188 == 0
            units = -(-len(padded) // mpegts.UNIT)
            assert r["pts"] == [k * mpegts.TICK for k in range(units)] and r["access_points"] == list(range(0, units, mpegts.GOP))
    assert mpegts.media_features(mpegts.to_media(empty)).count() == 0


def test_demux_finds_faults():
    media = bytearray(mpegts.mux(bytes(range(256)) * 200))
    gone = bytes(media[: 188 * 5] + media[188 * 6 :])
    assert mpegts.demux(gone)["jumps"] == 1
    media[188 * 2] = 0
    assert mpegts.demux(bytes(media))["lost"] >= 1
    x = mpegts.demux(mpegts.mux(b"z" * (5 * mpegts.UNIT)))
    assert x["pts"] == [k * mpegts.TICK for k in range(5)] and x["points"] == [0, 4] and x["pcr"] == [0, 4 * mpegts.TICK]


def test_demux_survives_damage():
    r = random.Random(3)
    whole = mpegts.mux(bytes(range(256)) * 300)
    for _ in range(3000):
        media = bytearray(whole[: r.choice([len(whole), 188 * r.randrange(8), r.randrange(len(whole))])])
        for _ in range(r.randrange(8)):
            if media:
                media[r.randrange(min(len(media), r.choice([188 * 4, len(media)])))] = r.randrange(256)
        x = mpegts.demux(bytes(media))
        assert len(x["pts"]) <= x["packets"]
    assert mpegts.demux(b"")["payload"] == b"" and mpegts.demux(b"\x47" * 1000)["pid"] == 0
    cut = mpegts.demux(whole[: 188 * 20])
    assert cut["lost"] == 1 and cut["payload"] == (bytes(range(256)) * 300)[: len(cut["payload"])]


def test_sections_may_span_packets():
    m = np.frombuffer(mpegts.mux(b"q" * 640), np.uint8).reshape(-1, 188)
    programs = b"".join(k.to_bytes(2, "big") + (0xE000 | mpegts.PMT_PID).to_bytes(2, "big") for k in range(1, 61))
    raw = b"\0" + mpegts.section(0, 1, programs)
    parts = [raw[:184], raw[184:].ljust(184, b"\xff")]
    pat = b"".join(bytes([0x47, 0x40 if not k else 0, 0, 0x10 | k]) + x for k, x in enumerate(parts))
    x = mpegts.demux(pat + m[1:].tobytes())
    assert x["crc_ok"] and x["payload"] == b"q" * 640
    assert not mpegts.demux(pat[:188] + m[1:].tobytes())["crc_ok"]


def brute_print(t, width=3):
    w = bytes(t or "", "utf8").lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """prints: (id, fingerprint) -> smallest id reachable by links of 2 bits or fewer."""
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, x in prints:
            for j, y in prints:
                if (x ^ y).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash_classes(spark, docs, empty):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice((2, 4, 5)))), 0) for i in range(150)]
    base = " ".join(words * 6)
    rows += [(1000 + i, base.replace(f"w{i} ", "zz ", 1), 0) for i in range(40)] + [(2000, rows[3][1], 0), (2001, None, 0), (2002, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {x["doc_id"]: x["component_id"] for x in simhash.classes(df).collect()}
    assert got == brute_classes([(i, brute_print(t)) for i, t, _ in rows])
    assert len(simhash.classes(docs).collect()) == len(TEXTS) + 2
    assert simhash.classes(empty).count() == 0


@pytest.mark.parametrize("most", [8192, 4])
def test_index_finds_all_links(spark, most):
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    x = {int(b) ^ 1 << int(i) ^ 1 << int(j) for b in base for i, j in r.integers(0, 64, (15, 2))}
    x = [v - (1 << 64) if v >> 63 else v for v in x]
    nodes = spark.createDataFrame([(v, k) for k, v in enumerate(x)], "fp long, doc_id long")
    from lexigraph.operators.components import connected_components

    got = {k: k for k in range(len(x))} | {n["node"]: n["component"] for n in connected_components(simhash.index_links(nodes, most=most)).collect()}
    assert got == brute_classes([(k, v & (1 << 64) - 1) for k, v in enumerate(x)])


def test_near_duplicates_are_found_and_others_kept(spark):
    r = random.Random(5)
    fresh = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = fresh(60)
    rows, group = [], {}
    for g in range(12):
        base = fresh(150).split()
        for c in range(6):
            w = list(base)
            for _ in range(c % 3):
                w[r.randrange(len(w))] = fresh(1)
            rows.append((100 * g + c, " ".join(w)))
            group[100 * g + c] = g
    rows += [(5000 + k, fresh(100) + " " + passage + " " + fresh(100)) for k in range(20)]  # share a passage only
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(x["doc_id"] for x in simhash.near_dedup_stage(spark, df, "").collect())
    assert kept == sorted({100 * g for g in range(12)} | {5000 + k for k in range(20)})


def brute_near(texts, width=5, least=0.8):
    """Classes of {id: text}, as id -> smallest id, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)}
    root = {i: i for i in texts}
    ids = sorted(texts)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and root[x] != root[y] and both >= least * (len(sets[x]) + len(sets[y]) - both):
                lo, hi = sorted((root[x], root[y]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    return root


def near_of(spark, texts):
    return {r["doc_id"]: r["component_id"] for r in simhash.near_classes(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}


def test_near_duplicates_of_short_texts_and_around_a_passage(spark):
    r = random.Random(8)
    fresh = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage, texts = fresh(60), {}
    for n in range(10, 61, 5):
        for _ in range(8):
            w = fresh(n)
            texts[len(texts)] = " ".join(w)
            texts[len(texts)] = " ".join(w + fresh(1))
            texts[len(texts)] = " ".join(w[:-1] + fresh(1))
    for k in range(60):  # unlike texts around one passage, and edited copies of some
        w = fresh(4 + k % 9) + passage + fresh(4 + k % 7)
        texts[len(texts)] = " ".join(w)
        if k % 3 == 0:
            texts[len(texts)] = " ".join(w[:-1] + fresh(1))
    assert near_of(spark, texts) == brute_near(texts)


def test_near_duplicates_of_one_fingerprint(spark):
    r = random.Random(9)
    fresh = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    texts = {}
    for _ in range(20):  # the repeated words set the fingerprint; the first and last text are unlike the two between
        base, tail = fresh(11) * 40, fresh(12)
        for end in (fresh(12), tail, tail[:-1] + fresh(1), fresh(12)):
            texts[len(texts)] = " ".join(base + end)
    prints = {i: simhash.fingerprint(t, 5) for i, t in texts.items()}
    assert sum(prints[4 * g] == prints[4 * g + 1] == prints[4 * g + 2] for g in range(20)) >= 5
    got = near_of(spark, texts)
    assert got == brute_near(texts) and all(got[4 * g + 2] == 4 * g + 1 for g in range(20))


def test_licenses(docs, empty):
    rows = licenses.scan(docs).collect()
    r = by_id(rows)[4][0]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (7, 2, 1, 5, "apache,mit")
    assert by_id(rows)[0][0]["n_words"] == 0 and by_id(rows)[0][0]["first_word"] is None
    assert licenses.scan(empty).count() == 0


def test_license_notices(spark):
    notices = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "the license of mine": ""}
    rows = [(i, f"some text {i} " * 30 + "\n" + n) for i, n in enumerate(notices)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(notices.values())


def test_licence_texts(spark):
    rows = [(k, "head " * 9 + text.replace(" the ", " THE\n").replace(",", ";") + " tail" * 9) for k, (_, text, _) in enumerate(licenses.TEMPLATES)]
    rows.append((100, "Redistribution and use in source and binary forms, with or without modification, are permitted"))
    rows.append((101, "redistribution and use in binary forms"))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1.0
    assert got[100]["labels"] == "bsd" and got[101]["labels"] == ""


def test_license_scan_matches_brute_force(spark):
    r = random.Random(7)
    bits = ["MIT", "License", "license", "cc", "by", "CC-BY", "apache", "Gnu", "general", "public", "mit license", ",", "é", "the", "_", "under", "4", "0", "\n"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(400)]
    for _, text, _ in licenses.TEMPLATES * 4:
        w = ("so it is " + text).split()
        for _ in range(r.randrange(1 + len(w) // 5)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = [r.choice(bits)] * r.randrange(3)
        texts.append(" ".join(w))
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    df = {}
    for t in texts:
        for w in set(licenses.words_of(t)):
            df[w] = df.get(w, 0) + 1
    index = licenses.Index(df, len(texts))
    for g in got:
        w = licenses.words_of(texts[g["doc_id"]])
        at = [i for i in range(len(w)) for p in licenses.BASE if w[i : i + len(p.split())] == p.encode().split()]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        best = {}
        for k, (label, words, _) in enumerate(index.templates):
            top = sorted(set(words), key=lambda x: (-index.idf[x], x))[: 4 if len(words) < 30 else 8]
            slack = index.slack[k]
            for o in range(-len(words), len(w) + 1):
                near = {x for x in top for p, y in enumerate(words) if x == y and x in w[max(0, o + p - slack) : max(0, o + p + slack + 1)]}
                if 2 * len(near) > len(top):
                    score = index.score(k, w[max(0, o - slack) : max(0, o + len(words) + slack)])
                    if score >= 0.7:
                        best[label] = max(best.get(label, 0), score)
        base = {label for p, label in licenses.BASE.items() if f" {p} ".encode() in b" " + b" ".join(w) + b" "}
        assert g["base_labels"] == ",".join(sorted(base)) and g["labels"] == ",".join(sorted(base | set(best))) and g["score"] == max(best.values(), default=0.0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."), (2, "one two"), (3, None), (None, "x y z")], "item_id long, text string")


def test_decontamination(spark, benchmark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(0, f"x y {item.upper()}! z"), (1, "alpha beta GAMMA delta epsilon changed eta theta iota kappa"), (2, "alpha beta gamma only"), (3, None), (4, ""), (5, "k " * 40_000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, benchmark, block_chars=20).collect()}
    assert [got[i]["contaminated"] for i in range(6)] == [True, True, False, False, False, True]
    assert got[0]["score"] == 1.0 and got[0]["item_id"] == 1 and got[3]["item_id"] is None
    assert abs(got[1]["score"] - (9 * 2 - 1) / 20) < 1e-9
    assert decontaminate.contamination(docs.where("false"), benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.where("false")).where("contaminated").count() == 0


def test_decontamination_by_rows_and_in_blocks(spark, benchmark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(None, item, 1), (None, "clean", 2), (7, item, 3), (7, "clean too", 4), (7, "clean too", 4), (8, None, 5), (9, "", 6), (10, "x " * 20_000 + item + " y" * 20_000, 7)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, item_id int, score string")
    items = spark.createDataFrame([(9, item), (1, item), (4, "lambda mu nu xi omicron pi rho sigma tau upsilon"), (5, "one more item " * 9)], "item_id long, text string")
    assert [len(x) for x in decontaminate.blocks(items, 60)] == [1, 1, 1, 1] and [len(x) for x in decontaminate.blocks(items, 1 << 20)] == [4]
    want = [(None, "clean", 2, "z"), (7, "clean too", 4, "z"), (7, "clean too", 4, "z"), (8, None, 5, "z"), (9, "", 6, "z")]
    for size in (60, 1 << 20):
        got = decontaminate.clean_rows(docs, items, block_chars=size)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        scored = decontaminate.contamination(docs, items, block_chars=size).collect()
        assert len(scored) == len(rows) and sum(r["contaminated"] for r in scored) == 3 and {r["item_id"] for r in scored if r["contaminated"]} == {1}
    assert decontaminate.clean_rows(docs.where("false"), items).count() == 0
    assert decontaminate.clean_rows(docs, items.where("false")).count() == len(rows)


def test_contamination_matches_smith_waterman_on_all_pairs(spark):
    r = random.Random(4)
    common = [f"c{k}" for k in range(30)]
    items = [(k, " ".join(r.choice(common) if r.random() < 0.5 else f"w{r.randrange(2000)}" for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 7, 10, 15, 15, 30, 40])]
    texts = []
    for _, t in items * 12:
        w, every = t.split(), r.choice([2, 3, 4, 9])
        w = [x if (k + 1) % every else r.choice([f"z{k}", "", f"{x} y{k}"]) for k, x in enumerate(w)]
        texts.append(" ".join(["a"] * 5 + w + [r.choice(common) for _ in range(r.randrange(80))]))
    texts += [t for _, t in items for _ in range(3)]  # verbatim copies make all seeds common
    words = items[7][1].split()
    texts.append(" ".join(f"q{k}" if k in (2, 5, 8, 11) else w for k, w in enumerate(words)))
    got = decontaminate.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    number = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in decontaminate.words_of(t)])
    for g in got:
        want = max(decontaminate.align(coded(t), coded(texts[g["doc_id"]])) / (2 * len(t.split())) for _, t in items)
        assert g["contaminated"] == (want >= decontaminate.THRESHOLD), (g, want, texts[g["doc_id"]])
        assert g["score"] == want or want < decontaminate.THRESHOLD


def test_alignment_matches_plain_smith_waterman():
    r = random.Random(1)
    for _ in range(60):
        a, b = [r.randrange(4) for _ in range(r.randrange(1, 9))], [r.randrange(4) for _ in range(r.randrange(1, 12))]
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(np.array(a), np.array(b)) == h.max()


def test_segmentation_samples(docs, empty):
    rows = segsample.digest(docs, k=3).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r["round_trip"] and r["distinct"] for r in rows)
    assert by_id(rows)[4][0]["ids_crc32"] == by_id(rows)[4][1]["ids_crc32"]  # a row's key and text alone decide
    assert segsample.digest(empty).count() == 0


def test_samples_are_without_replacement_and_in_proportion():
    w = segsample.Words(segsample.default_model())
    found = segsample.samples(w, list(range(3000)), ["of it"] * 3000, 2, 0)
    p = {}
    for s in segsample.samples(w, [0], ["of it"], 10_000, 0)[0]:
        p[s["ids"].tobytes()] = np.exp(s["logp"])
    assert abs(sum(p.values()) - 1) < 1e-6
    first = [f[0]["ids"].tobytes() for f in found]
    for ids, q in p.items():
        assert abs(first.count(ids) / 3000 - q) < 4 * np.sqrt(q * (1 - q) / 3000) + 1e-3
    assert all(f[0]["perturbed"] >= f[1]["perturbed"] and f[0]["ids"].tobytes() != f[1]["ids"].tobytes() for f in found)


def test_token_shards(spark, docs, empty):
    from tokenizers import Tokenizer

    files = wavelet.write_shards(docs, wavelet.new_path(spark, "t"), shard=50_000)
    got = wavelet.read_documents(spark, files).orderBy("start").collect()
    tok = Tokenizer.from_file(wavelet.default_tokenizer())
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for (i, t), g in zip(rows, got, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (g["first_id"], g["n_end_ids"]) == (ids[0], ids.count(0))
        start += len(ids)
    assert wavelet.read_documents(spark, wavelet.write_shards(empty, wavelet.new_path(spark, "t"))).count() == 0


def test_encoder_gives_the_librarys_ids(monkeypatch):
    coder = wavelet.Encoder(wavelet.default_tokenizer(), most=3000)  # so few that they are dropped again and again
    r = random.Random(6)
    bits = ["a", "B", "é", "ß", "ñ", "1", "²", "½", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "'", "'s", "'re", "'ll", "'S", "!", "…", "_", "日", "한", "Ж", "α", "ש", "𝒳", "😀", "\u0301", "\u200d", "<|endoftext|>", "-", "x" * 250]
    weights = [9] * 32 + [1, 9, 1]
    texts = ["".join(r.choices(bits, weights, k=r.randrange(14))) for _ in range(20_000)]
    for at in range(0, len(texts), 500):
        for x, got in zip(texts[at : at + 500], coder.encode(texts[at : at + 500]), strict=True):
            assert got.tolist() == [*coder.tokenizer.encode(x, add_special_tokens=False).ids, 0], x
    monkeypatch.setattr(coder, "hashes", lambda codes, at, ends: np.full(len(at), 7, np.uint64))  # all pieces share a hash
    assert [x.tolist() for x in coder.encode(["one two", "three"])] == [[*coder.tokenizer.encode(x).ids, 0] for x in ("one two", "three")]


@pytest.mark.parametrize("n, block", [(3000, 1 << 18), (3000, 512), (1024, 512), (1, 512), (0, 512)])
def test_wavelet_access_rank_select(n, block):
    r = np.random.default_rng(1)
    x = (r.pareto(1, n) * 10).astype(int) % 50_000
    raw = wavelet.WaveletMatrix.pack(x, 16, block)
    asked = []
    m = wavelet.WaveletMatrix(lambda at, size: asked.append(size) or raw[at : at + size], most=20)
    assert (m.all() == x).all() and (m.access(np.arange(0, n, 37)) == x[::37]).all()
    for v in {*x[:40].tolist(), 65_000}:
        at = np.flatnonzero(x == v)
        lo, hi = np.array([0, n // 30, n // 2]), np.array([n, n // 3, n])
        assert m.count(v)[0] == len(at) and m.count(v, lo, hi).tolist() == [((at >= a) & (at < b)).sum() for a, b in zip(lo, hi, strict=True)]
        assert [m.occurrence(v, k) for k in range(len(at) + 1)] == [*at.tolist(), -1]
    if (n, block) == (3000, 512):
        m.held.clear()
        asked.clear()
        m.access(1500)
        assert len(asked) == 16 and sum(asked) < len(raw) / 4  # a block a plane


def test_damaged_shards_are_refused():
    raw = wavelet.shard_bytes([5, None], [2, 1], np.array([7, 0, 0]), 16)
    ids, sizes, m = wavelet.read_shard(lambda at, n: raw[at : at + n])
    assert ids == [5, None] and sizes.tolist() == [2, 1] and m.all().tolist() == [7, 0, 0]
    for at in (0, 20, len(raw) - 3):
        bad = raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]
        with pytest.raises(Exception):  # noqa: B017, PT011
            wavelet.read_shard(lambda at, n, bad=bad: bad[at : at + n])[2].all()


def test_warc_round_trip(spark):
    rows = [(3, "u", "same"), (1, "u\r\nX: y", "same"), (2, None, None), (5, "v", ""), (7, "w", "é" * 5000), (7, "w", "é" * 5000), (9, "z", "".join(random.Random(0).choice("abc\r\n<>é") for _ in range(300_000)))]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, body string")
    files = warc.write_warc(pages, warc.new_path(spark, "w"), file_bytes=2000)
    for split in (100, 1777, 8 << 20):
        got = warc.read_warc(spark, files, split_bytes=split).collect()
        assert len(got) == len(rows) and all(r["sound"] for r in got)
        one = {int(r["record_id"]): r for r in got}
        for i, _, html in rows:
            raw = (html or "").encode()
            assert (one[i]["payload_bytes"], one[i]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert {i: (r["record_type"], r["refers_to"]) for i, r in one.items()} == {1: ("response", None), 3: ("revisit", "1"), 2: ("response", None), 5: ("revisit", "2"), 7: ("response", None), 9: ("response", None)}
        assert one[9]["payload"] == rows[-1][2].encode()
    none = warc.write_warc(pages.where("false"), warc.new_path(spark, "w"))
    assert warc.read_warc(spark, none).count() == 0


def test_language(docs, empty, spark):
    rows = langid.identify(docs.where("lang is not null"), docs).collect()
    assert by_id(rows)[0][0]["lang_pred"] == "und" and by_id(rows)[2][0]["score"] == 0.0
    assert {r["lang_pred"] for r in rows} == {"und", "en"}
    assert all(r["lang_pred"] == "und" for r in langid.identify(empty, docs).collect())
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = langid.op5_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(held, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert p > 0.97


def test_language_of_one_text_a_block_and_of_long_rows(spark):
    r = random.Random(1)
    text = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    en, de = "the house and then some water flows by our street".split(), "das haus und dann noch wasser fliesst durch unsere strasse".split()
    long = text(en, 600_000)  # over 3 MB: a block of its own
    rows = [(0, text(en, 50), "en", "x"), (1, long, "en", "x"), (2, text(de, 300_000), "de", "x")]  # the only row of a language is a long one
    rows += [(3, "½ ² 12 _ !", None, "x"), (4, long + " end", None, "x"), (5, "wasser", None, "x"), (5, "wasser", None, "x"), (None, "water", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(len(rows))
    got = langid.identify(docs, docs, longest=2000).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["lang_pred"]) for x in got) == [(False, 0, "en"), (False, 1, "en"), (False, 2, "de"), (False, 3, "und"), (False, 4, "en"), (False, 5, "de"), (False, 5, "de"), (True, 0, "en")]
    assert len({x["score"] for x in got if x["doc_id"] == 5}) == 1
    many = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.col("id").cast("string").alias("lang"))
    assert len(langid.training_words(many, "doc_id", "text", "lang", 5, 100, 30)) == 30
    with pytest.raises(ValueError, match="languages"):
        langid.training_words(many, "doc_id", "text", "lang", 5, 100, 29)


def test_word_probability_sums_all_segmentations():
    v = langid.vocabulary(langid.default_model())
    table = -np.arange(v.size, dtype=float)[:, None] / 5000 - 3

    def brute(word):
        total = [0.0] + [-np.inf] * len(word)
        pieces = {p: i for i, p in enumerate(v.pieces) if len(p) <= len(word) and i > 258}
        for e in range(1, len(word) + 1):
            for s in range(e):
                if word[s:e] in pieces:
                    total[e] = np.logaddexp(total[e], total[s] + table[pieces[word[s:e]], 0])
        return total[-1]

    words = ["▁then", "▁hello", "other", "▁a"]
    lat = v.lattice(words)
    got = lat.forward(langid.edge_weights(v, table, lat.piece))[lat.ends, 0]
    assert np.allclose(got, [brute(w) for w in words])
    back = lat.backward(langid.edge_weights(v, table, lat.piece))[lat.starts, 0]
    assert np.allclose(got, back)
    long = ["ab" * 400, "𝒳" * 90, "▁x", "▁" * 70]  # past the range of floats, and not
    lat = v.lattice(long)
    weight = langid.edge_weights(v, table, lat.piece)
    a, b = lat.forward(weight)[lat.ends, 0], lat.backward(weight)[lat.starts, 0]
    assert np.allclose(a, b) and np.isfinite(a).all() and np.allclose(a[:1], brute(long[0])) and np.allclose(a[3], brute(long[3]))


def test_frequent_words_stay_when_others_go():
    small, roomy, made = segsample.Words(segsample.default_model(), most=3000), segsample.Words(segsample.default_model()), []
    add = small.add
    small.add = lambda new: (made.extend(new), add(new))
    r = random.Random(7)
    for block in range(30):
        texts = [" ".join(["the water", "".join(r.choice("abcdefgh") for _ in range(9)), "½▁\n"]) for _ in range(12)]
        keys = list(range(block, block + 12))
        got, want = segsample.samples(small, keys, texts, 3, 0), segsample.samples(roomy, keys, texts, 3, 0)
        assert [[(x["ids"].tolist(), x["logp"], x["perturbed"], x["inclusion"]) for x in one] for one in got] == [[(x["ids"].tolist(), x["logp"], x["perturbed"], x["inclusion"]) for x in one] for one in want]
        assert all(small.v.decode(x["ids"]).decode() == text for one, text in zip(got, texts, strict=True) for x in one)
    assert len(made) > 200 and len(small.index) < 200 and small.n < 9000
    assert sum(w in ("▁water", "▁water".encode()) for w in made) == 1


def test_texts_split_together_have_their_units():
    texts = [None, "", " a  b\n c", "x▁y", "\n\n", "½ 𝒳", "   "]
    flat, sizes = lattice.split(texts)
    assert [x.decode("utf-8", "surrogatepass") for x in flat.to_pylist()] == [u for t in texts for u in langid.units(t)]
    assert sizes.tolist() == [len(langid.units(t)) for t in texts]


def test_units_keep_runs_of_spaces():
    v = langid.vocabulary(langid.default_model())
    assert langid.units(" a  b\n c") == ["▁▁a", "▁▁b", "\n", "▁c"] and langid.units("") == ["▁"] and langid.units("a b") == ["▁a", "▁b"]
    lat = v.lattice(["▁▁b"])
    assert any(v.pieces[p] == "▁▁" for p in lat.piece.tolist() if p < v.size) and any(v.pieces[p] == "▁b" for p in lat.piece.tolist() if p < v.size)


def test_toxicity(docs, empty, spark):
    labels = spark.createDataFrame([(i, int(i in (1, 5))) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    rows = toxicity.score(docs, m).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    made = []
    for i in range(400):
        w = [word() for _ in range(60)]
        if i % 5 == 0:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["zorkle", "zorklish", "quaxen"]) + r.choice(["", "t", "r"])
        made.append((i, " ".join(w), int(i % 5 == 0)))
    d = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    m = toxicity.train(d, d.select("doc_id", "toxic"))
    held = [(y, m.score(t) >= toxicity.THRESHOLD) for i, t, y in made if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(y == p for y, p in held) / len(held) > 0.95


def test_label_model_recovers_rates_and_correlations_from_votes_alone():
    r = np.random.default_rng(5)
    n, share = 6000, 0.2
    truth = r.random(n) < share
    rates = np.array([[0.02, 0.03, 0.01, 0.05, 0.6, 0.7], [0.6, 0.5, 0.4, 0.5, 0.1, 0.2]])
    votes = r.random((n, 6)) < np.where(truth[:, None], rates[1], rates[0])
    votes = np.c_[votes, votes[:, 0]]  # a copy of the first voter
    side = np.array([1, 1, 1, 1, 0, 0, 1])
    post, found, correlation = toxicity.label_model(votes, side, share)
    assert np.abs(found[:, :6] - rates).max() < 0.04
    logit = np.log(share / (1 - share)) + np.where(votes[:, :6], np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))).sum(axis=1)
    assert np.abs(post - 1 / (1 + np.exp(-logit))).mean() < 0.02  # the posterior under the true rates, as if the copy were not there
    assert correlation[0, 6] > 0.99 and np.abs(correlation[:6, :6] - np.eye(6)).max() == 0
    assert ((post > 0.5) == truth).mean() > 0.95


def test_patterns_fire_by_themselves():
    v = toxicity.Voters(["zork"], ["calm"])
    assert v.size == len(toxicity.INSULTS) + 2 + len(toxicity.PATTERNS) and v.side.tolist() == [1] * 13 + [0] + [1, 1, 1, 0]
    on, hits = v.fires("YOU ARE SOOO!!!! WRONG you you")
    assert on == [14, 15, 16] and hits == 0
    assert v.fires("calmly zorkish, idiot zork") == ([toxicity.INSULTS.index("idiot"), 12, 13, 17], 3) and v.fires(None) == ([17], 0)


def test_toxicity_of_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op1_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic is not null").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert 2 * hit / (sum(r["predicted"] for r in rows) + sum(r["toxic"] for r in rows)) > 0.88


def test_toxicity_is_fitted_on_the_share_of_toxic_rows(spark, monkeypatch):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "Model", lambda rows: [y for _, y in rows])
    fitted = toxicity.train(docs, docs.select("doc_id", "toxic"), most=1500)
    assert 1200 < len(fitted) < 1800 and 0.08 < sum(fitted) / len(fitted) < 0.12


@pytest.mark.parametrize("length", ["many", "-5", "1e3", "9" * 30, "²"])
def test_a_record_of_no_length_is_not_sound(length):
    raw = warc.record("response", "1", "http://a/", warc.digest32(b"x"), 1, b"x", None)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = [line if not line.startswith(b"Content-Length:") else f"Content-Length: {length}".encode() for line in head.split(b"\r\n")]
    found = warc.parse(b"\r\n".join(lines) + b"\r\n\r\n" + rest)
    assert not found["sound"] and found["payload"] == b"" and found["record_id"] == "1" and warc.parse(raw)["sound"]


def test_tables_of_files_with_clashing_columns(spark, docs, empty):
    """Columns that the writers use themselves, in op7 and op10."""
    clash = docs.select("doc_id", "text", F.lit("x").alias("ids"), F.lit(1).alias("shard"), F.lit("y").alias("path"))
    assert wavelet.read_documents(spark, wavelet.write_shards(clash, wavelet.new_path(spark, "t"))).count() == docs.count()
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.col("text").alias("html"), F.lit("z").alias("body"), F.lit("s").alias("sha"), F.lit(1).alias("first_id"))
    from lexigraph.llm.common import new_path

    files = warc.write_warc(pages, new_path(spark, "clash"))
    assert warc.read_warc(spark, files).count() == docs.count()
    assert warc.read_warc(spark, warc.write_warc(pages.where("false"), new_path(spark, "none"))).count() == 0
