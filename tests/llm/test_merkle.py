"""The manifest against a plain tree, its SQL, and proofs that are tampered with."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import merkle, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, leaf string, pos int, key string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def climb(tree, p):
    for level in tree[:-1]:
        yield level[p // 3 * 3 : p // 3 * 3 + 3], p % 3
        p //= 3


def brute(rows):
    """The query's rows, by the definition."""
    made = sorted(((r[3], r[0], sha(line(r[0], r[3], r[2], r[4], r[1])), r) for r in rows), key=lambda x: ((x[0] is not None, (x[0] or "").encode()), (x[1] is not None, x[1] or 0), x[2]))
    keys = list(dict.fromkeys(x[0] for x in made))
    trees = {k: levels([x[2] for x in made if x[0] == k]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys])
    out, seen = [], {}
    for key, i, leaf, r in made:
        p = seen[key] = seen.get(key, -1) + 1
        path = [*climb(trees[key], p), *climb(top, keys.index(key))]
        now = leaf
        if i is not None and zlib.crc32(str(i).encode()) % 2 == 0:
            now = sha(line(i, key, r[2], r[4], None if r[1] is None else r[1].replace("\n", "")))
        for run, at in path:
            now = sha("".join(now if k == at else h for k, h in enumerate(run)))
        proof = sha("".join(h for run, at in path for k, h in enumerate(run) if k != at))
        out.append((i, leaf, trees[key][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


def rows(n, sources):
    more = ("p", "l", 1, "k")
    out = [(i * 7 % 1009, f"text {i}\nend" if i % 3 else ("" if i % 2 else None), None if i % 5 else "en", sources[i * i % len(sources)], i if i % 4 else None, *more) for i in range(n)]
    return [*out, (3, "same id\n", "de", sources[0], 1, *more), (None, "no\nid", None, sources[0], None, *more), (None, None, None, None, None, *more), (9, "x" * 300_000 + "\n", "en", sources[-1], 1, *more), (5, "twice\n", "en", sources[0], 1, *more), (5, "twice\n", "en", sources[0], 1, *more)]


def result(spark, tmp_path, data):
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    return merkle.op13_merkle(spark, f"file://{tmp_path}")


@pytest.mark.parametrize(("n", "sources"), [(0, ["a"]), (20, ["b", "a", None, "", "é", "z" * 90]), (400, ["hot"] * 9 + ["x", None]), (90, [f"s{i}" for i in range(90)])])
def test_against_plain_tree_and_sql(spark, tmp_path, n, sources):
    data = rows(n, sources)
    got = result(spark, tmp_path, data)
    want = sorted(map(repr, brute(data)))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(registry.oracle_sql()["op13_merkle"])
    assert [c[0] for c in cur.description] == got.columns and sorted(map(repr, cur.fetchall())) == want


@pytest.mark.parametrize("n", [1, 3, 81, 82, 243, 244])
def test_sizes_around_full_groups(spark, tmp_path, n):
    data = [(i, f"t{i}\n", None, "one", i, "p", "l", 1, "k") for i in range(n)]
    assert sorted(repr(tuple(r)) for r in result(spark, tmp_path, data).collect()) == sorted(map(repr, brute(data)))


def test_empty_table(spark, tmp_path):
    assert result(spark, tmp_path, []).count() == 0


def test_a_path_proves_its_leaf_alone(spark):
    data = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("s"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit("kept").alias("more"))
    m = merkle.manifest(data, "s")
    assert m.columns == ["s", "id", "leaf", "more", "path", "subroot", "root"]
    own = m.select("id", (merkle.folded(F.col("path"), F.col("leaf")) == F.col("root")).alias("a"), (merkle.folded(F.col("path"), F.sha2(F.lit("other"), 256)) == F.col("root")).alias("b"), F.length(merkle.siblings(F.col("path"))).alias("n"))
    assert all(r["a"] and not r["b"] and r["n"] % 64 == 0 for r in own.collect()) and own.count() == 100
