"""N-gram Jaccard join: exact similarity links between documents' shingle sets, found by signature trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import components, join_heads, mixed, released, shingle_set, table, written
from lexigrid.llm.signature_tree import linked

#: The share of the hash range in which a larger set's shingles are counted, as a multiple of the share of shingles that a prefix has.
LOW_SHARE = 1.6
#: Of sets of fewer shingles, and of those that may link with one, all shingles are counted.
SMALL = 64
#: Sets a tree holds at most; larger clusters are dealt to blocks, and every two blocks that sizes allow meet in a task.
BLOCK = 1500
#: Ids up to which a semi-join's right side is broadcast; counted shingles that a partition gets on average.
BROADCAST_IDS, PER_PART = 1 << 19, 1 << 21
#: The rank, after all counts, of shingles that aren't counted.
UNCOUNTED = 1 << 40


def _node(s: np.ndarray) -> int | None:
    """A 64-bit name of a set; None for the empty one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _low(num: int, den: int) -> int:
    return int(min(0.49, LOW_SHARE * (1 - num / den)) * 2.0**64)


def _need(n, num: int, den: int):
    """Of two linked sets each shares one of so many of its first shingles, in any one order of all shingles."""
    return n - (num * n + den - 1) // den + 1


_SMALL_BIT, _CLASS = np.uint64(1), np.uint64(0xA5A5A5A55A5A5A5A)


def _prefix_rows(n_words: int, num: int, den: int):
    """Texts -> their sets' sizes, names, and shingles (h) to be counted, or (more) taken uncounted, by hash, where a prefix needs them.

    The last bit of a shingle tells the class: 1 of small sets, where all are counted; 0 of larger ones, where only those in the low part of the
    range are. Two linked sets are both in the class of the smaller one: a set that may link with a small one is in both.
    """
    low = np.uint64(_low(num, den))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, n_words)
                n, n_low, parts, more = len(s), int(np.searchsorted(s, low)), [], s[:0]
                if n * num < SMALL * den:
                    parts.append(mixed(s ^ _CLASS) | _SMALL_BIT)
                if n >= SMALL:
                    parts.append(s[:n_low] & ~_SMALL_BIT)
                    more = s[n_low : max(n_low, _need(n, num, den))] & ~_SMALL_BIT
                h = np.concatenate(parts) if parts else s
                for column, value in zip(out, (n, _node(s), n_low, h.view(np.int64), more.view(np.int64)), strict=True):
                    column.append(value)
            lists = []
            for some in out[3:]:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
                flat = np.concatenate(some) if some else np.zeros(0, np.int64)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), *lists],
                names=["doc_id", "n_shingles", "node", "n_low", "h", "more"],
            )

    return rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, node) in order, the distinct ones whose h has more than one node. Holds a batch and a row at a time."""
    last: tuple | None = None  # the last distinct row, and whether its h had a row before it
    for batch in batches:
        h, node = np.asarray(batch.column("h")), np.asarray(batch.column("node"))
        if not len(h):
            continue
        if last is not None:
            h, node = np.concatenate([[last[0]], h]), np.concatenate([[last[1]], node])
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
        h, node = h[new], node[new]
        same = h[1:] == h[:-1]
        before = np.concatenate([[last is not None and last[2]], same])
        keep = before[:-1] | same
        yield pa.record_batch({"h": h[:-1][keep], "node": node[:-1][keep]})
        last = (h[-1], node[-1], bool(before[-1]))
    if last is not None and last[2]:
        yield pa.record_batch({"h": np.array([last[0]]), "node": np.array([last[1]])})


def _sets(n_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n_words) for t in batch.column("text").to_pylist()]
            own = pa.array([_node(s) == k for s, k in zip(sets, batch.column("node").to_pylist(), strict=True)], pa.bool_())
            out = pa.record_batch([batch.column("node"), batch.column("cluster"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "cluster", "set"])
            yield out.filter(own)

    return rows


def _links(num: int, den: int):
    def meet(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        ids, side = np.asarray(part["node"]), np.asarray(part["side"])
        place = np.concatenate([np.flatnonzero(side == 0), np.flatnonzero(side == 1)])
        sets = [np.frombuffer(part["set"][int(k)].as_buffer(), np.uint64) for k in place]
        n, ids = int((side == 0).sum()), ids[place]
        same = part["p"][0].as_py() == part["q"][0].as_py()
        found = linked(sets[:n], None if same else sets[n:], num, den, np.asarray(part["group"])[place])
        # what the links connect, as stars: fewer steps to the whole's components
        head = list(range(len(ids)))
        for x, y in found:
            while head[x] != x:
                x = head[x]
            while head[y] != y:
                y = head[y]
            head[max(x, y)] = min(x, y)
        ends = []
        for x in sorted({z for link in found for z in link}):
            top = x
            while head[top] != top:
                top = head[top]
            if top != x:
                ends.append((ids[top], ids[x]))
        return pa.table({"a": pa.array([x for x, _ in ends], pa.int64()), "b": pa.array([y for _, y in ends], pa.int64())})

    return meet


def join_components(docs: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id under the links den * intersection >= num * union.

    A text's set holds its distinct n_words-word shingles (63-bit hashes in the candidate search, 64-bit ones in the decision); a shorter text is
    one shingle; null, empty and blank texts have no set, no links, and are their own component. Repeated rows, also of one doc_id with other
    texts, are documents each; a component is named by the smallest doc_id in it (null only if all are). An empty table gives no
    rows; other columns, whatever their names, play no part. Exact, in these steps:
    1. Rows of one set are one node.
    2. In one order of all shingles, linked sets share one of the first n - ceil(n * num / den) + 1. The order is by the number of nodes that
       have a shingle, rare ones first: all shingles of small sets are counted, of larger ones those in the lowest part of the range (see
       LOW_SHARE), and the others follow by hash. A node whose prefix holds shingles of its own alone links with nothing and
       goes no further.
    3. Nodes that share a prefix shingle form clusters; only they are read again. Each cluster's sets meet in signature trees, in blocks
       of some BLOCK sets, cut by size. First every block meets itself and the next one; then all others whose sizes are near enough, but
       for blocks that are one component by then: a large group of near copies takes as many tasks as it has blocks.
    4. Links join to components, and rows take over their node's.
    """
    read, spark = docs.select("doc_id", "text"), docs.sparkSession
    schema = "doc_id long, n_shingles long, node long, n_low int, h array<long>, more array<long>"
    rows = written(read.mapInArrow(released(_prefix_rows(n_words, num, den)), schema), "jaccard-sets")
    counted = rows.agg(F.sum(F.size("h"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted // PER_PART))
    tokens = rows.where("node is not null").select(F.explode("h").alias("h"), "node").repartition(parts, "h").sortWithinPartitions("h", "node")
    shared = written(tokens.mapInArrow(released(_shared), "h long, node long"), "jaccard-shared")
    times = shared.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("head"))
    shared = join_heads(shared, times, "h").select("node", F.struct(F.col("c").alias("rank"), "h").alias("x"))
    more = rows.where("size(more) > 0").select("node", F.explode("more").alias("h")).distinct()
    shared = shared.unionByName(more.select("node", F.struct(F.lit(UNCOUNTED).alias("rank"), "h").alias("x")))
    small = F.col("x.h").bitwiseAND(F.lit(1)) == 1
    lists = shared.groupBy("node", small.alias("small")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("n_low").alias("n_low"))
    need = F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1")
    alone = F.when(F.col("small"), F.col("n")).otherwise(F.col("n_low")) - F.size(F.filter("x", lambda x: x["rank"] < UNCOUNTED))
    first = F.slice("x", F.lit(1), F.greatest(F.lit(0), need - alone).cast("int"))
    prefix = written(lists.join(nodes, "node").select("node", F.explode(F.transform(first, lambda x: x["h"])).alias("h")), "jaccard-prefix")
    heads = prefix.groupBy("h").agg(F.min("node").alias("head"), F.count("*").alias("c")).where("c > 1")
    star = join_heads(prefix, heads, "h").select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b").distinct()
    cluster = components(star, "jaccard-clusters").select(F.col("id").alias("node"), F.col("component").alias("cluster"))
    cluster = written(cluster.join(nodes.select("node", "doc_id"), "node"), "jaccard-cluster")
    few = cluster.count() <= BROADCAST_IDS
    again = read.join(F.broadcast(cluster) if few else cluster, read["doc_id"].eqNullSafe(cluster["doc_id"])).select("node", "cluster", "text")
    sets = again.mapInArrow(released(_sets(n_words)), "node long, cluster long, set binary").dropDuplicates(["node"])
    sets = written(sets.withColumn("n", F.floor(F.length("set") / 8).cast("long")), "jaccard-cluster-sets")
    placed, pairs = _blocks(sets, num, den)
    near = pairs.where("q - p <= 1")
    found = written(_met(placed.withColumn("group", F.lit(-1).cast("long")), near, num, den), "jaccard-links")
    far = pairs.where("q - p > 1")
    if not far.isEmpty():  # blocks that the first links make one component have nothing to find
        group = components(found, "jaccard-near").select(F.col("id").alias("node"), F.col("component").alias("group"))
        known = written(placed.join(group, "node", "left").withColumn("group", F.coalesce("group", "node")), "jaccard-known")
        ends = known.groupBy("cluster", "block").agg(F.min("group").alias("low"), F.max("group").alias("high"))
        x, y = (ends.select("cluster", F.col("block").alias(b), F.col("low").alias(f"low_{b}"), F.col("high").alias(f"high_{b}")) for b in "pq")
        far = far.join(x, ["cluster", "p"]).join(y, ["cluster", "q"]).where("not (low_p = high_p and low_q = high_q and low_p = low_q)")
        found = found.unionByName(_met(known, far.select("cluster", "p", "q"), num, den))
    group = components(found, "jaccard-links").select(F.col("id").alias("node"), F.col("component").alias("group"))
    named = nodes.select("node", "doc_id").join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    named = named.join(named.groupBy("group").agg(F.min("doc_id").alias("component_id")), "group").select("node", "component_id")
    return rows.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _met(placed: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between the sets of pairs (cluster, p <= q) of blocks; each pair in a task."""
    own = [F.col("cluster"), F.col("node"), F.col("set"), F.col("group")]
    left = placed.join(pairs.select("cluster", F.col("p").alias("block"), "q"), ["cluster", "block"]).select(F.col("block").alias("p"), "q", F.lit(0).alias("side"), *own)
    right = pairs.where("p <> q").select("cluster", "p", F.col("q").alias("block"))
    right = placed.join(right, ["cluster", "block"]).select("p", F.col("block").alias("q"), F.lit(1).alias("side"), *own)
    return left.unionByName(right).groupBy("cluster", "p", "q").applyInArrow(_links(num, den), "a long, b long")


def _blocks(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """sets with a block each, some BLOCK sets of neighbouring sizes, and the pairs (cluster, p <= q) of blocks whose sizes may link."""
    upto = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sets.groupBy("cluster", "n").agg(F.count("*").alias("c"))
    sizes = sizes.withColumn("first", F.floor(F.coalesce(F.sum("c").over(upto), F.lit(0)) / BLOCK).cast("long"))
    sizes = sizes.withColumn("span", F.ceil(F.col("c") / F.lit(float(BLOCK))).cast("long")).drop("c")
    placed = sets.join(sizes, ["cluster", "n"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), F.col("span"))).drop("first", "span")
    placed = written(placed, "jaccard-placed")
    ends = placed.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = (ends.select("cluster", F.col("block").alias(b), F.col("least").alias(f"least_{b}"), F.col("most").alias(f"most_{b}")) for b in "pq")
    fit = (F.col("p") <= F.col("q")) & (F.least("most_p", "most_q") * den >= F.greatest("least_p", "least_q") * num)
    return placed, written(x.join(y, "cluster").where(fit).select("cluster", "p", "q"), "jaccard-pairs")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents; 4-word shingles, similarity 0.85 or more."""
    return join_components(table(spark, sf_dir, "documents"), 4, 85, 100)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
