"""Document vectors, exact cosine search, and cluster-pruned search over leaders and followers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.maths import idf
from lexigrid.functions.text import Analyzer
from lexigrid.operators import terms
from lexigrid.storage import written


def hashed(seed: str, *cols: str):
    """A portable 32-bit hash of ids: the first digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), *[F.col(c).cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def doc_vectors(docs: DataFrame, analyzer: Analyzer, field: str, words: DataFrame, stats: DataFrame, n_docs: DataFrame, dim: int, kind: str = "log") -> DataFrame:
    """(doc_id, vec): the idf-weighted mean of the word vectors (term, vec) of a document's tokens; unknown words don't count. docs (doc_id,
    field), a row each (see terms.single()); stats: (term, df).

    Frequent words are looked up and summed within a document's row; only rarer ones are joined.
    """
    weighed = words.join(stats, "term").crossJoin(F.broadcast(n_docs)).select("term", "df", idf(F.col("df"), F.col("n"), kind).alias("w"), "vec")
    weighed = written(weighed.select("term", "df", F.transform("vec", lambda x: x * F.col("w")).alias("v")), "weighed")
    listed = terms.top(weighed, "v")
    table = np.asarray(listed["v"].combine_chunks().flatten(), np.float64).reshape(-1, dim)
    names = ["len", *[f"v{i}" for i in range(dim)]]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("len", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names[1:]]])

    def f(c):
        c.groups()
        place = terms.looked_up(c, listed)
        at = np.flatnonzero(place >= 0)
        row, tf, n = c.row[at], c.tf[at], len(c.n)
        length = np.bincount(row, tf, n).astype(np.int64)
        some = np.flatnonzero(length)
        sums = [np.bincount(row, tf * table[place[at], i], n)[some] for i in range(dim)]
        return pa.RecordBatch.from_arrays([c.batch.column("doc_id").take(pa.array(some)), *map(pa.array, [length[some], *sums])], ["doc_id", *names])

    frequent = terms.rows(docs, analyzer, field, ("doc_id",), f, schema)
    rest = terms.rare(docs, analyzer, field, listed).join(weighed, "term").select("doc_id", F.col("tf").alias("len"), *[(F.col("tf") * F.col("v")[i]).alias(f"v{i}") for i in range(dim)])
    sums = frequent.unionByName(rest).groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in names])
    return sums.select("doc_id", F.array(*[F.col(n) / F.col("len") for n in names[1:]]).alias("vec"))


def query_vectors(queries: DataFrame, words: DataFrame, df: DataFrame) -> DataFrame:
    """(qid, qvec): the mean of the word vectors (term, vec) of a query's known terms (qid, term), each weighted by 1 / df (term, df)."""
    rows = queries.join(words, "term").join(df, "term").select("qid", F.posexplode(F.transform("vec", lambda x: x / F.col("df"))).alias("i", "x"))
    means = rows.groupBy("qid", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("qid", F.transform("v", lambda p: p["x"]).alias("qvec"))


def initialised(words: DataFrame, known: DataFrame) -> DataFrame:
    """Word vectors (term, vec), those of `known` where it has the term."""
    return words.join(known.withColumnRenamed("vec", "__known"), "term", "left").withColumn("vec", F.coalesce("__known", "vec")).drop("__known")


def _tiles(k: int):
    """A block of queries (side 0) and a shard of vectors (side 1) -> each query's k best of the shard, ties at the end included."""

    def tiles(part: pa.Table) -> pa.Table:
        side = np.asarray(part["side"])
        at = [part.filter(pa.array(side == s)) for s in (0, 1)]
        ids = [np.asarray(t["id"]) for t in at]
        a, b = (np.asarray(t["vec"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1)) for t in at)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        length = [np.sqrt((x * x).sum(axis=1)) for x in (a, b)]
        step = max(1, (1 << 22) // max(1, len(b)))
        for i in range(0, len(a) if len(b) else 0, step):
            norms = length[0][i : i + step, None] * length[1][None, :]
            sims = np.where(norms > 0, (a[i : i + step] @ b.T) / np.where(norms > 0, norms, 1), -1.0)
            rough = np.round(sims, 6)
            rough[ids[0][i : i + step, None] == ids[1][None, :]] = -np.inf
            least = np.partition(rough, len(b) - k, axis=1)[:, len(b) - k, None] if len(b) > k else -2.0
            row, col = np.nonzero((rough >= least) & (rough > -2))
            out.append((ids[0][i + row], ids[1][col], sims[row, col]))
        return pa.table({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("qid", "vec_id", "sim"))})

    return tiles


def nearest(vectors: DataFrame, queries: DataFrame, k: int, query_block: int = 4096, shard: int = 16384) -> DataFrame:
    """(qid, rank, vec_id, sim): of each query (qid, qvec) the k rows of vectors (vec_id, vec) with the largest cosine (6 places), ties to the
    smaller id; a row of the query's own id is none. Vectors of one length.

    Queries are dealt to blocks and vectors to shards; a task multiplies one block with one shard and keeps its best. Where vectors are few
    (leaders), blocks grow with them, so that copies stay fewer than the queries.
    """
    n_v = vectors.count()
    blocks = max(1, -(-queries.count() // max(query_block, 64 * min(n_v, shard))))
    shards = max(1, -(-n_v // shard))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select(F.col("qid").alias("id"), F.col("qvec").alias("vec"), deal("qid", blocks).alias("block"), every(shards).alias("shard"), F.lit(0).alias("side"))
    v = vectors.select(F.col("vec_id").alias("id"), "vec", every(blocks).alias("block"), deal("vec_id", shards).alias("shard"), F.lit(1).alias("side"))
    best = q.unionByName(v).groupBy("block", "shard").applyInArrow(_tiles(k), "qid long, vec_id long, sim double")
    best = best.withColumn("sim", F.round("sim", 6))
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "sim")


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, vec_id, sim): exact search."""
    return nearest(vectors, queries, k)


def leaders(vectors: DataFrame, seed: str = "leader") -> DataFrame:
    """floor(sqrt(n)) rows with the smallest hash of their id."""
    n = int(vectors.count() ** 0.5)
    return vectors.orderBy(hashed(seed, "vec_id"), "vec_id").limit(n)


def followers(vectors: DataFrame, lead: DataFrame, k: int = 3) -> DataFrame:
    """(follower_id, leader_id, sim): each non-leader's k nearest leaders."""
    rest = vectors.join(lead.select("vec_id"), "vec_id", "left_anti").select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec"))
    return nearest(lead, rest, k).select(F.col("qid").alias("follower_id"), F.col("vec_id").alias("leader_id"), "sim")


def pruned_search(vectors: DataFrame, lead: DataFrame, clusters: DataFrame, queries: DataFrame, k: int, probes: int = 3, query_block: int = 4096, shard: int = 16384) -> DataFrame:
    """search() over the followers of the `probes` leaders nearest to a query, and all these leaders.

    A vector goes to its leaders and a query to its probes, once each; candidates are no rows, a tile keeps each query's best.
    """
    near = search(lead, queries, probes).select("qid", F.col("vec_id").alias("leader_id")).join(queries, "qid")
    own = lead.select(F.col("vec_id").alias("leader_id"), "vec_id", "vec")
    members = own.unionByName(clusters.select("leader_id", F.col("follower_id").alias("vec_id")).join(vectors, "vec_id").select("leader_id", "vec_id", "vec"))
    members, near = written(members, "members"), written(near, "near")
    # a leader's queries and members meet in tiles: a leader of many is cut
    sizes = members.groupBy("leader_id").agg(F.ceil(F.count("*") / shard).alias("shards")).join(near.groupBy("leader_id").agg(F.ceil(F.count("*") / query_block).alias("blocks")), "leader_id")
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    q = near.join(sizes, "leader_id").select("leader_id", F.col("qid").alias("id"), F.col("qvec").alias("vec"), deal("qid", F.col("blocks")).alias("block"), every("shards").alias("shard"), F.lit(0).alias("side"))
    v = members.join(sizes, "leader_id").select("leader_id", F.col("vec_id").alias("id"), "vec", every("blocks").alias("block"), deal("vec_id", F.col("shards")).alias("shard"), F.lit(1).alias("side"))
    best = q.unionByName(v).groupBy("leader_id", "block", "shard").applyInArrow(_tiles(k), "qid long, vec_id long, sim double")
    best = best.withColumn("sim", F.round("sim", 6)).dropDuplicates(["qid", "vec_id"])
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "sim")


def mean_cluster_size(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("leader_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_size"))
