"""Ranked retrieval and pseudo-relevance feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.maths import tfidf
from lexigrid.functions.text import Analyzer
from lexigrid.storage import written


def top_k(df: DataFrame, by: list[str], score: str, k: int, tie: str = "doc_id") -> DataFrame:
    """The k rows of each group with the highest score, ties to the smaller `tie`, with their rank from 1."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(tokens: DataFrame, queries: list[tuple[int, list[str]]], n_docs: DataFrame, k: int = 150, log_tf: bool = True) -> DataFrame:
    """(qid, rank, doc_id, score), score rounded to 4 places before ties break. A repeated query term counts as often. n_docs: one row (n)."""
    spark = tokens.sparkSession
    asked = spark.createDataFrame([(q, t) for q, terms in queries for t in terms], "qid int, term string")
    tf = written(tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf")), "ranked")  # the texts are read once
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(n_docs)).select("term", "doc_id", tfidf(F.col("tf"), F.col("df"), F.col("n"), log_tf).alias("w"))
    scores = weights.join(F.broadcast(asked), "term").groupBy("qid", "doc_id").agg(F.round(F.sum("w"), 4).alias("score"))
    return top_k(scores, ["qid"], "score", k).select("qid", "rank", "doc_id", "score")


def feedback(docs: DataFrame, analyzer: Analyzer, field: str, query: list[str], n_docs: DataFrame, n_top: int = 5, n_terms: int = 10) -> DataFrame:
    """(term, score): the terms of the best documents by sum of tf times log10(N / df). The best documents' terms, few, are intersected with
    each document's before rows are made. The analyzer has no stemmer."""
    best = ranked(analyzer.explode(docs, field, only=query), [(0, query)], n_docs, n_top, log_tf=False).select("doc_id")
    inside = analyzer.explode(docs.join(F.broadcast(best), "doc_id", "left_semi"), field).groupBy("term").agg(F.count("*").alias("tf"))
    listed = inside.agg(F.collect_list("term").alias("__asked"))
    hits = docs.crossJoin(F.broadcast(listed)).select(F.explode(F.array_intersect(analyzer.tokens(F.col(field)), "__asked")).alias("term"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scores = inside.join(df, "term").crossJoin(F.broadcast(n_docs)).select("term", F.round(tfidf(F.col("tf"), F.col("df"), F.col("n"), False), 6).alias("score"))
    return scores.orderBy(F.desc("score"), "term").limit(n_terms)
