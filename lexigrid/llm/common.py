"""Helpers that several operators share: shared storage, word splitting, connected components."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.storage import written


def discard(df: DataFrame) -> None:
    """Delete the files under a table that written() made and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(conf).delete(path, True)


def released(rows):
    """A function over Arrow batches that, when a task is done, gives freed memory back: workers are reused, and would keep it."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_order(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with a long column `name`: their places, from 1, in an order; rows that tie in it in any one.

    Range partitions are counted, then numbered within. Ties are parted by where rows stand, so that a key of many rows fills no partition.
    """
    spark = rows.sparkSession
    rows = written(rows.withColumn("__salt", F.monotonically_increasing_id()), "unordered")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() >> 20)
    dealt = rows.repartitionByRange(parts, *order, "__salt").withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ordered")
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order, "__salt"))
    out = dealt.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + nth).cast("long"))
    return written(out.drop("__part", "__before", "__salt"), "numbered")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column `name` that tells rows apart and ascends with doc_id: doc_id itself, where it does so.

    Only if doc_ids repeat or are null are rows numbered, by doc_id (null first) and a digest of the text.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return in_order(docs, [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")], name)


def words(text: str | None) -> list[bytes]:
    """`[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case, as UTF-8: bytes.split() parts at exactly these characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the input reaches every bit of the output."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Roller:
    """Polynomial hashes modulo 2**64 of any slices of a byte string, from prefix sums."""

    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)

    def __init__(self) -> None:
        self._up = self._down = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            n = max(n, 2 * len(self._up), 1 << 16)
            self._up, self._down = _powers(self.base, n), _powers(self.inverse, n)

    def slices(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of data[start:end] for each pair; equal slices have equal hashes wherever they stand."""
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._down[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * self._up[start]
        return mixed(h + (end - start).astype(np.uint64) * _ODD)


ROLLER = Roller()
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of words(text), in order."""
    if not text:
        return np.zeros(0, np.uint64)
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return ROLLER.slices(data, start, end)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the text's n-word shingles; a text of fewer words is one shingle, one without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = mixed(h * _ODD + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def join_heads(rows: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """rows joined by key with heads, which have one row a key: written first, so that the planner knows their size, and broadcasts them where
    they are few, or else splits a hot key's rows as it runs (a join that reads two plain exchanges can be dealt anew)."""
    return rows.join(written(heads, "heads"), key)


def components(edges: DataFrame, what: str, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): (id, component), component the smallest id that links reach.

    Alternating large-star and small-star steps; each keeps connectivity, and their number grows with the logarithm of the graph's size. A
    node's smallest neighbour is found with a partial aggregation and joined to its edges as join_heads() does, so that a node of many edges is no
    hot key; the steps' tables are written to the shared folder. Rows with a null or equal ends are no edges. Ids without edges have no row.
    """
    first = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, after = _noted(first, f"{what}-edges")
    for _ in range(rounds):
        before, known = now, after
        # large star: every larger neighbour of a node links to the smallest of the node and its neighbours
        both = before.unionByName(before.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_heads(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(large.distinct(), f"{what}-large")
        # small star: every smaller neighbour of a node, and the node, link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_heads(large, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now, after = _noted(small.where("a <> b").distinct(), f"{what}-edges")
        discard(before)
        discard(large)
        if after == known:
            break
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _noted(edges: DataFrame, what: str) -> tuple[DataFrame, tuple]:
    """edges written, and a digest of them. (An Observation would save the second job, but leaves the session with a member that MLlib's closures
    can't take along.)"""
    out = written(edges, what)
    return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("b", "a"))).first())
