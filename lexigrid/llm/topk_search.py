"""Exact top-k search by inner product: tiled matrix products, a partial selection per tile, and a tree of merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.llm.common import table

FAN_IN = 16


def top_pairs(scores: np.ndarray, ids: np.ndarray, out: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's k highest scores, ties to smaller ids; what out marks is no candidate. ids must ascend."""
    scores = np.where(out, -np.inf, scores)
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]  # partial selection: the k-th highest
        row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    else:
        row, col = np.nonzero(np.isfinite(scores))
    value = scores[row, col]
    order = np.lexsort((ids[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    return row[keep], col[keep], value[keep]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, query_block: int = 2048, shard: int = 16384, tile: int = 4096) -> DataFrame:
    """For each row of queries (vec_id, v array<double>) the k rows of vectors (vec_id, v) with the highest inner products.

    Returns query_id, rank (from 1), vec_id, score (double). Ties go to the smaller vec_id; the query's own row, one of its id and its vector, is
    no candidate; fewer candidates give fewer rows. Null vectors and vectors with null or non-finite components take no part, nor do vectors of
    another length than the query's; an empty table gives no rows; other columns, whatever their names, play no part. Queries are dealt to
    blocks and vectors to shards by a hash, so that a task holds one block and one shard at most; blocks and shards grow in number with the
    data, never in size. Repeated vec_ids are rows of their own: only where there are some, rows of one id and one vector are made one, with
    their number, and candidates and results repeat as often.
    """
    fit = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"

    def usable(df: DataFrame) -> tuple[DataFrame, bool]:
        rows = df.where(fit).select("vec_id", "v", F.xxhash64("vec_id", "v").alias("own"))
        once = rows.groupBy("vec_id").count().where("count > 1").isEmpty()
        whole = rows.groupBy("own").agg(F.first("vec_id").alias("vec_id"), F.first("v").alias("v"), F.count("*").alias("times"))
        return (rows.withColumn("times", F.lit(1).cast("long")) if once else whole), once

    (asked, once), (c, simple) = usable(queries), usable(vectors)
    n_q, n_c = asked.count(), c.count()
    blocks, shards = max(1, -(-n_q // query_block)), max(1, -(-n_c // shard))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod("own", F.lit(n)).cast("int")
    held = ["vec_id", "v", "own", "times", F.size("v").alias("dim")]
    q = asked.select(*held, deal(blocks).alias("block"), every(shards).alias("shard"), F.lit(True).alias("asks"))
    c = c.select(*held, every(blocks).alias("block"), deal(shards).alias("shard"), F.lit(False).alias("asks"))

    def tiles(part: pa.Table) -> pa.Table:
        out = []
        asks = np.asarray(part["asks"])
        part_q, part_c = part.filter(pa.array(asks)), part.filter(pa.array(~asks)).sort_by("vec_id")
        if part_q.num_rows and part_c.num_rows:
            a, b = (_matrix(t["v"].combine_chunks(), t.num_rows) for t in (part_q, part_c))
            (asked, own_q), (ids, own_c) = ((np.asarray(t["vec_id"]), np.asarray(t["own"])) for t in (part_q, part_c))
            times = np.asarray(part_c["times"])
            step = max(1, (1 << 21) // max(1, min(tile, len(b))))
            for i in range(0, len(a), step):
                for j in range(0, len(b), tile):
                    mine = own_q[i : i + step, None] == own_c[None, j : j + tile]
                    row, col, score = top_pairs(a[i : i + step] @ b[j : j + tile].T, ids[j : j + tile], mine & (times[None, j : j + tile] == 1), k)
                    out.append((own_q[i + row], asked[i + row], ids[j + col], score, times[j + col] - mine[row, col]))
        kinds = (np.int64, np.int64, np.int64, np.float64, np.int64)
        cols = [np.concatenate([x[n] for x in out]) if out else np.zeros(0, t) for n, t in enumerate(kinds)]
        shard_no = part["shard"][0].as_py() if part.num_rows else 0
        return pa.table([*cols, np.full(len(cols[0]), shard_no, np.int32)], names=["own", "query_id", "vec_id", "score", "times", "node"])

    both = q.unionByName(c)
    lists = both.groupBy("dim", "block", "shard").applyInArrow(tiles, "own long, query_id long, vec_id long, score double, times long, node int")
    width, entry = shards, F.struct((-F.col("score")).alias("cost"), "vec_id", "times")
    while True:  # each step merges the lists of FAN_IN neighbouring nodes
        width = -(-width // FAN_IN)
        best = F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best")
        lists = lists.groupBy("own", "query_id", (F.col("node") / FAN_IN).cast("int").alias("node")).agg(best)
        if width <= 1:
            break
        lists = lists.select("own", "query_id", "node", F.explode("best").alias("x"))
        lists = lists.select("own", "query_id", F.col("x.vec_id"), (-F.col("x.cost")).alias("score"), F.col("x.times"), "node")
    if not simple:
        several = F.flatten(F.transform("best", lambda x: F.array_repeat(x, F.least(x["times"], F.lit(k)).cast("int"))))
        lists = lists.withColumn("best", F.slice(several, 1, k))
    if not once:
        lists = lists.join(asked.select("own", F.col("times").alias("copies")), "own")
        lists = lists.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return lists.select("query_id", F.posexplode("best").alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.cost")).alias("score")
    )


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings whose vec_id is divisible by 50 against all others, components floor(256 x), the 5 best."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double")).alias("v"), F.col("embedding").alias("raw"))
    rows = rows.where("forall(raw, x -> x is not null and not isnan(x) and abs(x) < float('inf'))").select("vec_id", "v")
    found = top_k(rows, rows.where("vec_id % 50 = 0"), 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
