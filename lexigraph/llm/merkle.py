"""A Merkle manifest of a table by parent preimages.

Every row is a leaf: the sha256 of its fields, each "-" if null, else its length in UTF-8 bytes, ":" and its value. The leaves of a key (a source) stand in the order of their ids, null first; rows of one
id in that of their leaves, so repeated rows change places with themselves alone. Every three nodes in a row have a parent, the sha256 of their concatenated hashes; what remains of a key is its subroot
(a lone leaf itself), and the subroots, by key, null first and bytewise, have the root in the same way.

What is stored for a parent is its preimage: the hashes of its children, 64 characters each. A leaf joins the preimages of its ancestors; without the leaf's own 64 characters a preimage is the list of its
siblings there, and with other characters in their place it hashes to what the parent would be. Four generations are made by one grouping, as 81 nodes are the most that share a
great-great-grandparent, so 10^10 leaves of one key take six groupings and as many joins down again. Places are counted by ranges of (key, id, leaf), so a key with any share of the rows is spread over tasks.

A table without rows has no manifest (no rows); empty and very long texts are values like others; a row of null fields has a leaf; a null id comes first in its key. Fields are named by the caller, and other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

FAN, DEEP = 3, 4
SPAN = FAN**DEEP
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    texts = (c.cast("string") for c in fields)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in texts)), 256)


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes with each row's place in its key from 0 (pos) and the rows of its key (n). Rows are dealt by ranges; a range counts its own, and adds what earlier ranges hold of the key, a row a range and key.
    Equal rows are told apart by where they were read, so they can be dealt to several ranges."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = nodes.withColumn("_row", F.monotonically_increasing_id())
    dealt = apart.repartitionByRange(parts, "key", *order, "_row").sortWithinPartitions("key", *order, "_row").drop("_row")
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "merkle-ranges", codec="snappy")
    counts = dealt.groupBy("key", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("key", "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(W.partitionBy("key")).alias("n"))
    return dealt.join(counts, ["key", "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def in_threes(hashes: Column) -> Column:
    parents = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FAN).cast("int"))
    return F.transform(parents, lambda i: F.array_join(F.slice(hashes, i * FAN + 1, F.lit(FAN)), ""))


def grown(nodes: DataFrame) -> list[DataFrame]:
    """For each four generations above nodes (key, pos, n, h), a table (key, place, n, preimages: of a generation in order, null where the key is done, h: the hash at the top). The last has one row a key."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out, now = [], nodes
    while not out or most > 1:
        g = now.groupBy("key", F.floor(F.col("pos") / SPAN).alias("place")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("c"))
        g = g.withColumn("h0", F.col("c")["h"])
        for k in range(1, DEEP + 1):
            below = F.col(f"h{k - 1}")
            g = g.withColumn(f"p{k}", F.when(F.col("n") > FAN ** (k - 1), in_threes(below)))
            g = g.withColumn(f"h{k}", F.when(F.col(f"p{k}").isNull(), below).otherwise(F.transform(f"p{k}", lambda p: F.sha2(p, 256))))
        made = g.select("key", "place", "n", F.array(*(f"p{k}" for k in range(1, DEEP + 1))).alias("preimages"), F.col(f"h{DEEP}")[0].alias("h"))
        out.append(cut(made, "merkle-preimages", codec="snappy"))
        now = out[-1].select("key", F.col("place").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), "h")
        most = -(-most // SPAN)
    return out


def steps(slot: Column) -> Column:
    """What a node at this slot of a group of 81 finds in its preimages, upwards: each parent's preimage and the node's own place in it."""
    each = [F.struct(F.col("preimages")[k - 1][F.floor(slot / FAN**k).cast("int")].alias("preimage"), (F.floor(slot / FAN ** (k - 1)) % FAN).cast("int").alias("slot")) for k in range(1, DEEP + 1)]
    return F.filter(F.array(*each), lambda s: s["preimage"].isNotNull())


def joined(nodes: DataFrame, stage: DataFrame, carried: list[str]) -> DataFrame:
    """nodes (key, pos, ...) with their path: the steps in their group and the group's own path; and the columns that the group carries for its key."""
    groups = stage.select("key", F.col("place").alias("_group"), "preimages", "path", *carried)
    met = nodes.withColumn("_group", F.floor(F.col("pos") / SPAN)).join(groups, ["key", "_group"])
    return met.withColumn("path", F.concat(steps(F.col("pos") % SPAN), "path")).drop("_group", "preimages")


def climbed(nodes: DataFrame, stages: list[DataFrame], top: DataFrame, carried: list[str]) -> DataFrame:
    """nodes with their path up to where top (key, path, carried) leaves off; groups get theirs from the last stage downwards."""
    above = stages[-1].join(top, "key")
    for stage in reversed(stages[:-1]):
        own = stage.select("key", "place", F.col("place").alias("pos"), F.col("preimages").alias("_own"))
        above = joined(own, above, carried).withColumnRenamed("_own", "preimages").drop("pos")
    return joined(nodes, above, carried)


def siblings(path: Column) -> Column:
    """Hashes that a proof needs, bottom up: the preimages without the node's own place."""
    return F.array_join(F.transform(path, lambda s: F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * HEX), F.substr(s["preimage"], s["slot"] * HEX + HEX + 1))), "")


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf's hash gives with the siblings of a path."""
    put = lambda h, s: F.sha2(F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * HEX), h, F.substr(s["preimage"], s["slot"] * HEX + HEX + 1)), 256)
    return F.aggregate(path, start, put)


def manifest(leaves: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """leaves (a key column, an id column, leaf, and more, all kept) with path: array of (preimage, slot) from the leaf to the root, subroot and root."""
    more = [c for c in leaves.columns if c != key]
    # keys as texts that join and sort: null first, then bytewise
    nodes = placed(leaves.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))).select("key", F.col(key).alias("_source"), *more), id_col, "leaf")
    nodes = cut(nodes, "merkle-places", codec="snappy")
    stages = grown(nodes.select("key", "pos", "n", F.col("leaf").alias("h")))
    sources = placed(stages[-1].select(F.lit("").alias("key"), F.col("key").alias("of"), "h"), "of")
    sources = cut(sources, "merkle-sources", codec="snappy")
    over = grown(sources)
    path = F.array().cast("array<struct<preimage:string,slot:int>>")
    root = over[-1].select("key", path.alias("path"), F.col("h").alias("root"))
    top = climbed(sources, over, root, ["root"]).select(F.col("of").alias("key"), "path", F.col("h").alias("subroot"), "root")
    out = climbed(nodes.drop("n"), stages, top, ["subroot", "root"])
    return out.select(F.col("_source").alias(key), *more, "path", "subroot", "root")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("string")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = [F.translate(text, "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", leaf([F.col(c) for c in FIELDS]).alias("leaf"), F.when(even, leaf(changed)).alias("changed"))
    m = manifest(cut(rows, "merkle-leaves", codec="snappy"), "source", "doc_id")
    again = folded(F.col("path"), F.coalesce("changed", "leaf"))
    out = m.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
