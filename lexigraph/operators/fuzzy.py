"""Approximate matching of strings: best partners by matching blocks, and search by bit-parallel edit distance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.shared import cut

#: Strings of a block; buckets of a character histogram.
ROWS, BUCKETS = 256, 64
#: Rows whose states are stepped together, and bits of a pattern at most.
STEP, WORD = 2048, 62


def matched(a: str, b: str) -> int:
    """Characters in matching blocks: the longest common stretch (earliest in a, then in b), and so on to its left and right. In a b of 200 characters or more, characters that make up over 1 % of it can't begin a stretch, but can extend one."""
    at = {}
    for j, c in enumerate(b):
        at.setdefault(c, []).append(j)
    if len(b) >= 200:
        at = {c: js for c, js in at.items() if len(js) <= len(b) // 100 + 1}
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i0, j0, size, before = alo, blo, 0, {}
        for i in range(alo, ahi):
            now = {}
            for j in at.get(a[i], ()):
                if j >= bhi:
                    break
                if j >= blo:
                    k = now[j] = before.get(j - 1, 0) + 1
                    if k > size:
                        i0, j0, size = i - k + 1, j - k + 1, k
            before = now
        while i0 > alo and j0 > blo and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < ahi and j0 + size < bhi and a[i0 + size] == b[j0 + size]:
            size += 1
        if size:
            total += size
            todo += [(alo, i0, blo, j0), (i0 + size, ahi, j0 + size, bhi)]
    return total


def ratio(a: str, b: str) -> float:
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def histogram(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.int64)
    for k, t in enumerate(texts):
        out[k] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % BUCKETS, minlength=BUCKETS)
    return out


def blocks(df: DataFrame, prefix: str) -> DataFrame:
    """df(id, order, text) as blocks of rows of about one length, one row each."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("id", "order")}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("_n", F.length("text"))
    rows = df.repartitionByRange(max(1, min(parts, df.count() // (4 * ROWS))), "_n", "id").sortWithinPartitions("_n", "id")

    def run(batches):
        held = []
        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= ROWS:
                t = pa.Table.from_batches(held)
                yield pack(t.slice(0, ROWS))
                held = t.slice(ROWS).to_batches()
        if sum(map(len, held)):
            yield pack(pa.Table.from_batches(held))

    def pack(t):
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), pa.concat_arrays(t[c].chunks))
        n = t["_n"].to_pylist()
        return pa.RecordBatch.from_arrays([one("id"), one("order"), one("text"), pa.array([min(n)]), pa.array([max(n)])], [f"{prefix}{c}" for c in ("id", "order", "text", "lo", "hi")])

    out = rows.mapInArrow(run, f"{prefix}id array<{kinds['id']}>, {prefix}order array<{kinds['order']}>, {prefix}text array<string>, {prefix}lo long, {prefix}hi long")
    return cut(out, "strings")


def best_matches(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(id, match, score): for each row of left(id, order, text) the row of right, by another id, of the greatest ratio of matching blocks, if it is at least `least` (above 0); ties by right's order, then id. Rows of null id or text have none.

    Complete: only what can't reach `least` is left out. The shorter string makes a ratio of at most 2 short / (short + long), so only lengths within a factor can match, and blocks of rows sorted by length meet where their lengths' logarithms are in neighbouring
    buckets. In a pair of blocks the characters that two strings share, whatever their order, bound the ratio; rows are aligned from the best bound down until no bound is left above what was found."""
    if not 0 < least <= 1:
        raise ValueError("a least ratio above 0 is needed")
    short = least / (2 - least)
    step = -math.log(min(short, 0.999))
    whole = lambda df: df.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "order", "text")
    bucket = lambda n: F.floor(F.log(F.greatest(F.col(n), F.lit(1)).cast("double")) / step).cast("int")
    a = blocks(whole(left), "l_").withColumn("key", F.explode(F.sequence(bucket("l_lo"), bucket("l_hi"))))
    b = blocks(whole(right), "r_").withColumn("key", F.explode(F.sequence(bucket("r_lo") - 1, bucket("r_hi") + 1)))
    met = a.join(b, "key").where((F.col("r_hi") >= short * F.col("l_lo") - 1e-9) & (F.col("l_hi") >= short * F.col("r_lo") - 1e-9))
    # blocks that meet in several buckets are compared in the first of them alone
    met = met.where(F.col("key") == F.greatest(bucket("l_lo"), bucket("r_lo") - 1)).select("l_id", "l_text", "r_id", "r_order", "r_text")
    kind, order = left.schema["id"].dataType.simpleString(), right.schema["order"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for ids, texts, others, orders, partners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rank = sorted(range(len(others)), key=lambda k: (orders[k], others[k]))
                others, orders, partners = ([v[k] for k in rank] for v in (others, orders, partners))
                x, y = histogram(texts), histogram(partners)
                size = x.sum(1)[:, None] + y.sum(1)
                shared = np.zeros(size.shape, np.int64)
                for c in range(BUCKETS):
                    shared += np.minimum(x[:, c, None], y[:, c])
                bound = np.where(size > 0, 2.0 * shared / np.maximum(size, 1), 1.0)
                rows = []
                for i, text in enumerate(texts):
                    top, found = least, None
                    for k in np.argsort(-bound[i], kind="stable").tolist():
                        if bound[i, k] < top:
                            break
                        if others[k] == ids[i]:
                            continue
                        r = ratio(text, partners[k])
                        if r > top or r == top and (found is None or k < found):
                            top, found = r, k
                    if found is not None:
                        rows.append({"id": ids[i], "match": others[found], "order": orders[found], "score": top})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("id", arrow(left, "id")), ("match", arrow(right, "id")), ("order", arrow(right, "order")), ("score", pa.float64())])
    found = met.mapInArrow(run, f"id {kind}, match {right.schema['id'].dataType.simpleString()}, order {order}, score double")
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("m"), "order", "match", "score")).alias("b"))
    return best.select("id", "b.match", "b.score")


def arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def errors(texts: pa.Array, pattern: str, most: int) -> np.ndarray:
    """The least edit distance of the pattern to any stretch of each text, most + 1 where it is greater. All texts are stepped together, a code point at a time: a word of bits per number of errors."""
    m = len(pattern)
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts.to_pylist()]
    letters = {c: sum(1 << k for k, p in enumerate(pattern) if p == c) for c in set(pattern)}
    keys = np.array(sorted(map(ord, letters)), np.uint32)
    masks = np.array([letters[chr(k)] for k in keys.tolist()] + [0], np.uint64)
    out = np.full(len(codes), min(m, most + 1), np.int64)  # an empty stretch costs the whole pattern
    one, goal = np.uint64(1), np.uint64(1 << (m - 1))
    order = sorted(range(len(codes)), key=lambda k: -len(codes[k]))
    for lo in range(0, len(order), STEP):
        rows = order[lo : lo + STEP]
        sizes = np.array([len(codes[k]) for k in rows])
        flat = np.concatenate([codes[k] for k in rows])
        at = np.searchsorted(keys, flat)
        at = np.where(keys[np.minimum(at, len(keys) - 1)] == flat, np.minimum(at, len(keys) - 1), len(keys))
        word, starts = masks[at], np.cumsum(sizes) - sizes
        state = np.array([[(1 << d) - 1 for d in range(most + 1)]] * len(rows), np.uint64)
        best = np.minimum(out[rows], most + 1)
        live = len(rows)
        for p in range(int(sizes[0]) if len(sizes) else 0):
            while live and sizes[live - 1] <= p:
                live -= 1
            mask, old = word[starts[:live] + p], state[:live].copy()
            new = ((old[:, 0] << one) | one) & mask
            state[:live, 0] = new
            for d in range(1, most + 1):
                step = (((old[:, d] << one) | one) & mask) | old[:, d - 1] | (old[:, d - 1] << one) | (new << one) | np.uint64((1 << d) - 1)
                state[:live, d] = new = step
            for d in range(most, -1, -1):
                best[:live][(state[:live, d] & goal) != 0] = np.minimum(best[:live][(state[:live, d] & goal) != 0], d)
        out[rows] = best
    return out


def search(df: DataFrame, term: str, fields: dict[str, float], threshold: float = 0.4, folded: bool = True) -> DataFrame:
    """df with its score, 0 to 1, the best first at 0; rows where no field has the term are left out. A field has it where a stretch of it, anywhere, is within threshold x length edits; it scores errors / length, 0.001 at least. The row's score is
    the product of the fields' that have it, each to the power of its share of the weights over the square root of its words. Null and empty fields have no term. Terms of up to 62 characters."""
    term = term.lower() if folded else term
    if not 0 < len(term) <= WORD:
        raise ValueError(f"a term of 1 to {WORD} characters is needed")
    most, total = math.floor(threshold * len(term) + 1e-9), sum(fields.values())

    @F.pandas_udf("int")
    def near(texts):
        import pandas as pd

        return pd.Series(errors(pa.array(texts, pa.string()), term, most)).astype("int32")

    score = F.lit(1.0)
    hit: Column = F.lit(False)
    for f, weight in fields.items():
        text = F.coalesce(F.col(f), F.lit(""))
        df = df.withColumn(f"_{f}", near(F.lower(text) if folded else text))
        has = (F.col(f"_{f}") <= most) & (text != "")
        words = F.greatest(F.size(F.split(F.trim(text), " +")), F.lit(1))
        own = F.pow(F.greatest(F.lit(0.001), F.col(f"_{f}") / len(term)), (weight / total) * F.round(1 / F.sqrt(words), 3))
        score, hit = score * F.when(has, own).otherwise(1.0), hit | has
    return df.where(hit).withColumn("score", score).drop(*(f"_{f}" for f in fields))
