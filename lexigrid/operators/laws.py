"""Text laws: Zipf, Benford, Heaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.text import Analyzer, first_digit
from lexigrid.operators import terms


def word_count(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term").agg(F.count("*").alias("freq"))


def zipf(counts: DataFrame, k: int) -> DataFrame:
    """(rank, term, freq, ln_rank, ln_freq) of the k most frequent terms. The limit precedes the numbering, so that no task sorts all terms."""
    top = counts.orderBy(F.desc("freq"), "term").limit(k)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "term")))
    return top.select("rank", "term", "freq", F.ln("rank").alias("ln_rank"), F.ln("freq").alias("ln_freq"))


def benford(counts: DataFrame, least: int = 10) -> DataFrame:
    """How many frequencies of `least` or more start with each digit."""
    return counts.where(F.col("freq") >= least).groupBy(first_digit(F.col("freq")).alias("digit")).agg(F.count("*").alias("n"))


def heaps(tokens: DataFrame, step: int) -> DataFrame:
    """(n, distinct_terms, fitted 14 n^0.5) at every step-th token in the order of (doc_id, pos).

    Nothing runs over all tokens in one task: documents are summed first, prefix sums go over blocks of documents and then
    within them, and only sampled tokens meet the first occurrences of their own document.
    """
    first = tokens.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("f"))
    return _heaps(first, tokens.groupBy("doc_id").agg(F.count("*").alias("len")), step)


def heaps_of(docs: DataFrame, analyzer: Analyzer, field: str, step: int) -> DataFrame:
    """heaps() of docs (doc_id, field), without a row a token."""
    first = terms.totals(docs, analyzer, field, first=True).groupBy("term").agg(F.min("f").alias("f"))
    return _heaps(first, terms.lengths(docs, analyzer, field).groupBy("doc_id").agg(F.sum("len").alias("len")).where("len > 0"), step)


def _heaps(first: DataFrame, sizes: DataFrame, step: int) -> DataFrame:
    first = first.select(F.col("f.doc_id").alias("doc_id"), F.col("f.pos").alias("pos"))
    new = first.groupBy("doc_id").agg(F.count("*").alias("new"), F.collect_list("pos").alias("at"))
    docs = sizes.join(new, "doc_id", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    docs = docs.withColumn("block", F.floor(F.col("doc_id") / 1000))
    blocks = docs.groupBy("block").agg(F.sum("len").alias("len"), F.sum("new").alias("new"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("len").over(upto), F.lit(0)).alias("len0"), F.coalesce(F.sum("new").over(upto), F.lit(0)).alias("new0"))
    inside = Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.join(blocks, "block").select("doc_id", "len", "at", (F.col("len0") + F.coalesce(F.sum("len").over(inside), F.lit(0))).alias("before"), (F.col("new0") + F.coalesce(F.sum("new").over(inside), F.lit(0))).alias("known"))
    start = F.floor(F.col("before") / step) + 1
    stop = F.floor((F.col("before") + F.col("len")) / step)
    points = docs.where(stop >= start).select("before", "known", "at", F.explode(F.sequence(start, stop)).alias("k")).withColumn("n", F.col("k") * step)
    seen = F.size(F.filter(F.coalesce("at", F.array().cast("array<int>")), lambda p: p < F.col("n") - F.col("before")))
    return points.select("n", (F.col("known") + seen).alias("distinct_terms"), (14 * F.sqrt("n")).alias("fitted"))
