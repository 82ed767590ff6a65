"""Comparison of corpora: contingency tables, mutual information, chi-square, filters, topic models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.maths import chi_square, mutual_information
from lexigrid.functions.text import Analyzer
from lexigrid.operators import terms
from lexigrid.storage import written


def corpus_sizes(docs: DataFrame) -> DataFrame:
    """Documents of each corpus, empty ones too."""
    return docs.groupBy("corpus").agg(F.count("*").alias("n_docs"))


def sizes_from_index(freq: DataFrame) -> DataFrame:
    """Documents of each corpus that the index still has."""
    return freq.groupBy("corpus", "doc_id").agg(F.lit(1).alias("x")).groupBy("corpus").agg(F.count("*").alias("n_docs"))


def contingency(freq: DataFrame, sizes: DataFrame) -> DataFrame:
    """(term, corpus, n11, n10, n01, n00) over the full grid of terms and corpora; freq (term, corpus), a row for each document that has the term,
    or with df, to be summed."""
    df = freq.groupBy("term", "corpus").agg((F.sum("df") if "df" in freq.columns else F.count("*")).cast("long").alias("n"))
    per_term = df.groupBy("term").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("corpus", "n"))).alias("by"))
    total = sizes.agg(F.sum("n_docs").alias("total"))
    cells = per_term.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(total)).withColumn("n11", F.coalesce(F.try_element_at("by", F.col("corpus")), F.lit(0)))
    cells = cells.withColumn("n10", F.col("all") - F.col("n11")).withColumn("n01", F.col("n_docs") - F.col("n11"))
    return cells.select("term", "corpus", "n11", "n10", "n01", (F.col("total") - F.col("n_docs") - F.col("n10")).alias("n00"))


def scored(cells: DataFrame) -> DataFrame:
    n = [F.col(c) for c in ("n11", "n10", "n01", "n00")]
    return cells.select("term", "corpus", mutual_information(*n).alias("mi"), chi_square(*n).alias("chisq"))


def top_terms(rows: DataFrame, score: str, places: int, k: int = 10) -> DataFrame:
    """(corpus, rank, term, score), by the rounded score, ties by term."""
    rows = rows.select("corpus", "term", F.round(score, places).alias(score))
    w = Window.partitionBy("corpus").orderBy(F.desc_nulls_last(score), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("corpus", "rank", "term", score)


def critical_filter(tokens: DataFrame, rows: DataFrame, least: float = 2.71, use_label: bool = False) -> DataFrame:
    """Tokens whose chi-square reaches `least`: in any corpus, or (use_label) in the token's own, which leaks labels on test data."""
    good = rows.where(F.col("chisq") >= least)
    return tokens.join(good.select("term", "corpus"), ["term", "corpus"], "left_semi") if use_label else tokens.join(good.select("term").distinct(), "term", "left_semi")


def critical_counts(docs: DataFrame, analyzer: Analyzer, field: str, least: float = 2.71, use_label: bool = False) -> DataFrame:
    """(corpus, kept, docs): the tokens that critical_filter() keeps, and the documents that have any, of docs (doc_id, corpus, field).

    Tokens are summed by term. A document with a frequent kept term is told by a list; only of others are the rarer terms joined.
    """
    docs = terms.single(docs, field, ("corpus",))
    freq = written(terms.totals(docs, analyzer, field, ("corpus",)).groupBy("term", "corpus").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), "frequencies")
    good = scored(contingency(freq, corpus_sizes(docs))).where(F.col("chisq") >= least)
    good = good.select("term", "corpus") if use_label else good.select("term").distinct()
    on = ["term", "corpus"] if use_label else ["term"]
    cells = written(freq.join(good, on), "kept")
    kept = cells.groupBy("corpus").agg(F.sum("cf").alias("kept"))
    # frequent kept terms, each with the corpora that keep it
    per = cells.groupBy("term").agg(F.sum("df").alias("df"), F.collect_set("corpus").alias("corpora"), F.max(F.col("corpus").isNull()).alias("none"))
    listed = terms.top(per, "corpora", "none")
    corpora = [(set(c), n) for c, n in zip(listed["corpora"].to_pylist(), listed["none"].to_pylist())]
    schema = T.StructType([docs.schema["doc_id"], docs.schema["corpus"], T.StructField("term", T.StringType())])

    def f(c):
        """A document with a listed term: one row without a term; else its terms."""
        c.groups()
        place, own = terms.looked_up(c, listed), c.batch.column("corpus").to_pylist()
        has = np.zeros(len(c.n), bool)
        for name in set(own):
            mine = np.array([name in cs or (name is None and none) for cs, none in corpora] + [False])
            rows = np.array([x == name for x in own])
            has[c.row[mine[place] & rows[c.row]]] = True
        at = np.flatnonzero(~has[c.row])
        row = np.concatenate([np.flatnonzero(has), c.row[at]])
        term = pa.concat_arrays([pa.nulls(int(has.sum()), pa.string()), c.terms.take(pa.array(c.code[at]))])
        return pa.RecordBatch.from_arrays([*(c.batch.column(x).take(pa.array(row)) for x in ("doc_id", "corpus")), term], ["doc_id", "corpus", "term"])

    found = written(terms.rows(docs, analyzer, field, ("doc_id", "corpus"), f, schema), "found")
    some = found.where("term is null").unionByName(found.where("term is not null").join(good, on, "left_semi").select(found.columns))
    n = some.select("corpus", "doc_id").distinct().groupBy("corpus").agg(F.count("*").alias("docs"))
    return kept.join(n, kept["corpus"].eqNullSafe(n["corpus"])).select(kept["corpus"], "kept", "docs")


def word_counts(tokens: DataFrame, words: list[str]) -> DataFrame:
    """(corpus, word columns): zeros appear."""
    return tokens.groupBy("corpus").agg(*[F.sum((F.col("term") == w).cast("long")).alias(f"n_{w}") for w in words])


def topics(docs: DataFrame, tokens: str, k: int = 20, iterations: int = 25, no_below: int = 15, no_above: float = 0.6, seed: int = 0):
    """(model, vocabulary, docs with topicDistribution) of online LDA over an array<string> column.

    Documents are counted once, into a table of vectors; no tokens are cached. An iteration sums a dense matrix (k by vocabulary) per partition, so there are
    only as many partitions as keep the cores busy; a task reads the table's share and the square root of so many matrices.
    """
    from pyspark.ml.clustering import LDA

    cv = terms.vectorizer(docs, tokens, "__bow", 1 << 18, no_below, no_above)
    bow = written(cv.transform(docs).drop(tokens), "bags")
    bow = bow.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    model = LDA(k=k, maxIter=iterations, optimizer="online", seed=seed, featuresCol="__bow").fit(bow)
    return model, cv.vocabulary, model.transform(bow)


def topic_mass(distributed: DataFrame) -> DataFrame:
    """(corpus, topic, mass): the mean probability of each topic in a corpus, over documents that have a word of the vocabulary."""
    from pyspark.ml.functions import vector_to_array

    known = distributed.select("corpus", vector_to_array("topicDistribution").alias("ps")).where("exists(ps, p -> p > 0)")
    rows = known.select("corpus", F.posexplode("ps").alias("topic", "p"))
    return rows.groupBy("corpus", "topic").agg(F.avg("p").alias("mass"))


def top_topic(mass: DataFrame) -> DataFrame:
    """Each corpus's topic of the largest mass; the first on ties."""
    w = Window.partitionBy("corpus").orderBy(F.desc("mass"), "topic")
    return mass.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def topic_words(model, vocabulary: list[str], k: int = 10) -> DataFrame:
    """(topic, rank, term, score)."""
    rows = model.describeTopics(k)
    words = rows.sparkSession.createDataFrame(list(enumerate(vocabulary)), "i int, term string")
    rows = rows.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "x"))
    rows = rows.select("topic", (F.col("pos") + 1).alias("rank"), F.col("x.termIndices").alias("i"), F.round("x.termWeights", 3).alias("score"))
    return rows.join(words, "i").select("topic", "rank", "term", "score")
