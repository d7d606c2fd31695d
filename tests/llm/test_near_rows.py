"""Near-duplicates of rows whose ids repeat, of texts from one template, and test items without an id."""

import itertools
import random

import pytest

from lexigraph.llm import decontaminate, simhash

SCHEMA = "doc_id long, text string, more int"


def words(r, n):
    return ["".join(r.choice("bcdfghjklm") for _ in range(6)) for _ in range(n)]


def similar(a, b, width=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)})
    return len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def kept(rows):
    """Row numbers that stay, by all pairs of rows."""
    texts = sorted({" ".join((t or "").lower().split()) for i, t, _ in rows if i is not None})
    label = {t: k for k, t in enumerate(texts)}
    for a, b in itertools.combinations(texts, 2):
        if similar(a, b) and label[a] != label[b]:
            old, new = label[a], label[b]
            label = {t: new if v == old else v for t, v in label.items()}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            t = " ".join((t or "").lower().split())
            best = (i, simhash.words_hash(t))
            first[label[t]] = min(first.get(label[t], best), best)
    return {k for i, t, k in rows if i is None or first[label[" ".join((t or "").lower().split())]] == (i, simhash.words_hash(t))}


@pytest.mark.parametrize("turn", [False, True])
def test_an_id_of_two_texts_loses_no_link(spark, turn):
    r = random.Random(1)
    x, y = " ".join(words(r, 40)), " ".join(words(r, 40))
    rows = [(5, x, 0), (5, y, 1), (9, y + " end", 2), (9, x, 3), (7, y, 4), (None, y, 5)]
    df = spark.createDataFrame(rows[::-1] if turn else rows, SCHEMA).coalesce(1)
    assert {q["more"] for q in simhash.near_dedup_stage(spark, df, "").collect()} == kept(rows) == {0, 1, 5}
    classes = {(q["doc_id"], q["component_id"], q["first"]) for q in simhash.near_classes(df).collect()}
    assert classes == {(5, 5, True), (9, 5, False)} and simhash.near_classes(df).count() == 3


def test_repeated_ids_against_all_pairs(spark):
    r = random.Random(2)
    rows = []
    for k in range(120):
        base = random.Random(k // 5).choice([30, 60, 90])
        text = words(random.Random(k // 5), base)
        for _ in range(r.choice((0, 0, 1, 2))):
            text[r.randrange(base)] = "other"
        rows.append((r.randrange(40) if r.random() > 0.05 else None, " ".join(text), k))
    rows += [(3, None, 120), (4, "", 121), (4, " \t", 122), (50, "one two", 123), (51, "One  two", 124)]
    got = {q["more"] for q in simhash.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == kept(rows)


def test_texts_of_one_template_meet_on_what_differs(spark):
    """One changed word of 30 leaves a similarity of 0.68; none of the pairs is even compared."""
    r = random.Random(3)
    base = words(r, 30)
    rows = [(i, " ".join([*base[:15], f"w{i}", *base[16:]]), i) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert simhash.near_dedup_stage(spark, df, "").count() == 300
    import numpy as np
    from pyspark.sql import functions as F

    often = simhash.frequent(df.select("doc_id", "text"), 5)
    sets = [simhash.sketch(t, 5)[2] for _, t, _ in rows]
    nodes = spark.createDataFrame([(k, len(s), simhash.prefix(s, 0.8, *often).view(np.int64).tolist(), simhash.bitmap(s), k) for k, s in enumerate(sets)], "node long, n long, prefix array<long>, bits binary, component long")
    assert simhash.near_pairs(nodes, 0.8).count() == 0
    short = nodes.select("node", "n", F.posexplode("prefix").alias("at", "s")).where("at < n - ceil(1.6 / 1.8 * n) + 1")
    assert short.groupBy("s").count().agg(F.max("count")).first()[0] == 1


def test_items_without_an_id_are_items(spark, tmp_path):
    r = random.Random(4)
    item, other = " ".join(words(r, 30)), " ".join(words(r, 30))
    spark.createDataFrame([(None, item), (7, other), (None, None), (8, "")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, " ".join(words(r, 50)) + " " + item, 0), (2, " ".join(words(r, 60)), 1), (3, other, 2), (None, None, 3)], SCHEMA)
    assert {q["more"] for q in decontaminate.decontaminate_stage(spark, docs, f"file://{tmp_path}").collect()} == {1, 3}
    got = {q["doc_id"]: (q["item_id"], q["contaminated"]) for q in decontaminate.contamination(docs, spark.read.parquet(f"file://{tmp_path}/benchmark.parquet")).collect()}
    assert got[1] == (None, True) and got[2] == (None, False) and got[3] == (7, True) and got[None] == (None, False)
