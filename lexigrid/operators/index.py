"""Positional and frequency indexes as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def postings(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, term) -> (term, doc_id, tf, positions), positions ascending."""
    return tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def merge(*parts: DataFrame) -> DataFrame:
    """Partial postings (of each term and document one row) of any documents as one index; a (term, doc_id) in several parts unites its
    positions. Only documents that several parts have are shuffled."""
    every, held = (reduce(DataFrame.unionByName, x) for x in ([p.select("term", "doc_id", "tf", "positions") for p in parts], [p.select("doc_id").distinct() for p in parts]))
    shared = held.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"))
    if shared.isEmpty():
        return every
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    joined = every.join(shared, same, "left_semi").groupBy("term", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    return every.join(shared, same, "left_anti").unionByName(joined.select("term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions"))


def frequencies(tokens: DataFrame) -> DataFrame:
    """(corpus, doc_id, term) -> (term, corpus, doc_id, tf)."""
    return tokens.groupBy("term", "corpus", "doc_id").agg(F.count("*").alias("tf"))


def term_stats(rows: DataFrame) -> DataFrame:
    """Document and collection frequency of each term, from counted() rows; one partial aggregation."""
    return rows.groupBy("term").agg(F.sum("df").cast("long").alias("df"), F.sum("cf").cast("long").alias("cf"))


def frequent(tokens: DataFrame, least: int) -> DataFrame:
    """Tokens of terms with a collection frequency of `least` or more."""
    keep = tokens.groupBy("term").agg(F.count("*").alias("cf")).where(F.col("cf") >= least).select("term")
    return tokens.join(keep, "term", "left_semi")


def dump_lines(index: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """The text form of an index: a line `term:df` per term, then one `\\t<doc>: p1, p2` per document; ordered by (term, doc_id) with the head first (doc_id null). stats: (term, df) where they are known."""
    heads = (index.groupBy("term").agg(F.count("*").alias("df")) if stats is None else stats).select("term", F.lit(None).cast("long").alias("doc_id"), F.concat_ws(":", "term", "df").alias("line"))
    rows = index.select("term", "doc_id", F.concat(F.lit("\t"), F.col("doc_id").cast("string"), F.lit(": "), F.array_join(F.transform("positions", lambda p: p.cast("string")), ", ")).alias("line"))
    return heads.unionByName(rows)
