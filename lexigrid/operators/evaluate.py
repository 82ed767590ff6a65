"""Evaluation of rankings and of classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.maths import discount, t_cdf_two_sided

METRICS = ["p10", "r50", "rprec", "ap", "ndcg10", "ndcg20"]


def metrics(runs: DataFrame, qrels: DataFrame, strict: bool = False) -> DataFrame:
    """runs (system, query, rank, doc_id), qrels (query, doc_id, rel) -> one row per system and judged query.

    The grid is dense: a system without results for a query has zeros. P@10 is over 10 always. strict: nDCG at k is 0
    where fewer than k were retrieved. Queries without relevant documents have null for all but P@10.
    """
    ideal = qrels.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rel"), "doc_id")))
    best = ideal.groupBy("query").agg(F.count("*").alias("r"), *[F.sum(F.when(F.col("i") <= k, F.col("rel") / discount(F.col("i")))).alias(f"ideal{k}") for k in (10, 20)])
    grid = runs.select("system").distinct().crossJoin(F.broadcast(best))
    hits = runs.join(qrels, ["query", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))).withColumn("hit", (F.col("rel") > 0).cast("int"))
    upto = Window.partitionBy("system", "query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("cum", F.sum("hit").over(upto)).join(best.select("query", "r"), "query", "left")
    total = lambda k, what: F.sum(F.when(F.col("rank") <= k, F.col(what)).otherwise(0))
    got = hits.groupBy("system", "query").agg(
        total(10, "hit").alias("h10"), total(50, "hit").alias("h50"), F.sum(F.when(F.col("rank") <= F.col("r"), F.col("hit")).otherwise(0)).alias("hr"),
        F.sum(F.col("hit") * F.col("cum") / F.col("rank")).alias("s"), F.max("rank").alias("depth"),
        *[F.sum(F.when(F.col("rank") <= k, F.col("rel") / discount(F.col("rank"))).otherwise(0.0)).alias(f"dcg{k}") for k in (10, 20)],
    )
    rows = grid.join(got, ["system", "query"], "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    ndcg = lambda k: F.when(F.lit(strict) & (F.coalesce("depth", F.lit(0)) < k), F.lit(0.0)).otherwise(F.try_divide(zero(f"dcg{k}"), F.col(f"ideal{k}")))
    r = F.col("r").cast("double")
    return rows.select("system", "query", (zero("h10") / 10).alias("p10"), F.try_divide(zero("h50"), r).alias("r50"), F.try_divide(zero("hr"), r).alias("rprec"), F.try_divide(zero("s"), r).alias("ap"), ndcg(10).alias("ndcg10"), ndcg(20).alias("ndcg20"))


def rounded(df: DataFrame, places: int = 3) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in METRICS else c for c in df.columns])


def with_means(rows: DataFrame) -> DataFrame:
    """Rows per query, and one per system (query null) with the means of the unrounded metrics."""
    return rows.unionByName(means(rows).withColumn("query", F.lit(None).cast("int")))


def means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("system").agg(*[F.avg(m).alias(m) for m in METRICS])


def paired(rows: DataFrame, metric: str) -> DataFrame:
    """The system with the best mean against the best one whose values differ: (best, other, n, mean_diff, t). Systems are few: one row each."""
    mean = rows.groupBy("system").agg(F.avg(metric).alias("m"))
    best = mean.orderBy(F.desc("m"), "system").limit(1).select(F.col("system").alias("best"))
    mine = rows.join(F.broadcast(best), F.col("system") == F.col("best")).select("query", "best", F.col(metric).alias("x"))
    diff = rows.join(mine, "query").where("system <> best").withColumn("d", F.col("x") - F.col(metric))
    out = diff.groupBy("best", F.col("system").alias("other")).agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.avg(metric).alias("m"))
    out = out.where("sd > 0").orderBy(F.desc("m"), "other").limit(1)
    return out.select("best", "other", "n", "mean_diff", (F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def p_value(t: float, n: int) -> float:
    return t_cdf_two_sided(t, n - 1)


def with_p(rows: DataFrame) -> DataFrame:
    """paired()'s row with p, the two-sided p-value of its t. One row: the incomplete beta function has no built-in form."""
    p = F.udf(lambda t, n: None if t is None or n < 2 else p_value(float(t), int(n)), "double")
    return rows.withColumn("p", p("t", "n"))


def scores(predictions: DataFrame, *by: str) -> DataFrame:
    """(by..., label, pred) -> precision, recall and F1 of each class, 0 where they aren't defined."""
    hit = F.col("label") == F.col("pred")
    side = lambda c: predictions.groupBy(*by, F.col(c).alias("class"))
    real = side("label").agg(F.count("*").alias("real"), F.sum(hit.cast("long")).alias("tp"))
    said = side("pred").agg(F.count("*").alias("said"))
    rows = real.join(said, [*by, "class"], "full")
    rate = lambda b: F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col(b)), F.lit(0.0))
    rows = rows.select(*by, "class", rate("said").alias("p"), rate("real").alias("r"))
    return rows.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def macro(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(c).alias(c) for c in "prf"])


def report(predictions: DataFrame, classes: list[str], by: tuple[str, ...] = ("system", "split"), places: int = 3) -> DataFrame:
    """(by..., p_<class>, r_<class>, f_<class>, ..., p_macro, r_macro, f_macro): a row per group; the classes are listed, so that columns are known."""
    rows = scores(predictions.where(F.col("label").isin(classes) & F.col("pred").isin(classes)), *by)
    grid = predictions.select(*by).distinct().withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    rows = grid.join(rows, [*by, "class"], "left").fillna(0.0, ["p", "r", "f"])
    own = [F.round(F.max(F.when(F.col("class") == c, F.col(m))), places).alias(f"{m}_{c}") for c in classes for m in "prf"]
    return rows.groupBy(*by).agg(*own, *[F.round(F.avg(m), places).alias(f"{m}_macro") for m in "prf"])


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "pred").agg(F.count("*").alias("n"))


def misclassified(predictions: DataFrame) -> DataFrame:
    return predictions.where("label <> pred")
