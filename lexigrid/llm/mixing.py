"""Mixing sources to target weights with Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]+"
PER_BUCKET = 20_000


def n_words(text: Column) -> Column:
    """The number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight in [0.1, 1]: one tenth, and nine tenths of the share of letters and blanks among the text's characters."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\s]+", ""))
    return F.coalesce(F.lit(1.0) - F.lit(0.9) * odd / F.nullif(F.length(text), F.lit(0)), F.lit(0.1))


def targets(sources: DataFrame, weights: list[float], ceiling: float) -> DataFrame:
    """Each source's share of all words: sources (source, source_size) -> (source, source_size, target).

    In code-point order, null last, the sources take the weights in turn. A target is the level times the weight, but
    ceiling times the source's size at most; what exceeds that is shared again among the others by weight. One row per
    source goes through a single sorted pass, texts never do.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    cap = F.lit(float(ceiling)) * F.col("source_size")
    ranked = sources.withColumn("w", w).withColumn("fill", cap / F.col("w"))
    # sources full at the lowest levels come first: if the first i are at their ceiling, the level of the rest is left / weight
    upto = Window.orderBy("fill", "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(cap).over(upto), F.lit(0.0)))
        .withColumn("heft", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("heft"))
        .withColumn("nth", F.row_number().over(Window.orderBy("fill", "source")))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("nth", "level"))).over(whole)["level"])
    )
    return ranked.select("source", "source_size", F.least(cap, F.coalesce("level", "fill") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: list[float], ceiling: float = 3.0, seed: str = "mix") -> DataFrame:
    """docs with columns doc_id, text, source -> doc_id, source, size, source_size, target, taken, and its two parts: epochs (whole copies) and part (words of one more).

    Each source gives its target of words: as many complete epochs of all its documents as fit, then a sample without
    replacement by Efraimidis-Spirakis keys -ln(u) / quality in ascending order, until the budget is spent; the document
    on its edge gives its first words only. u comes from a hash of seed and doc_id, so that reruns agree; repeated rows
    have equal keys and are told apart by a number. No document gives more than ceiling (rounded up) times its size.
    Empty and null texts have size 0 and give nothing; an empty table gives no rows. Null sources are one
    source. Other columns, whatever their names, play no part.
    A source's documents are dealt to buckets that ascend with the key and hold some PER_BUCKET rows each; budgets come from
    bucket sums, and rows are sorted in the bucket on the edge only.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 1.0) / F.lit(float(2**52 + 1))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), quality(F.col("text")).alias("quality"), F.xxhash64("text").alias("also"))
    sized = written(sized.withColumn("key", -F.log(u) / F.col("quality")).drop("quality"), "mix-sizes")
    n = sized.count()
    buckets = max(16, -(-n // PER_BUCKET))
    # keys are about exponential: 1 - exp(-key) deals them nearly evenly, and ascends with them
    sized = sized.withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key"))) * F.lit(float(buckets))).cast("long"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    per_source = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ceiling)
    plan = per_source.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")).withColumn(
        "budget", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    )
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    plan = plan.withColumnRenamed("source", "of")
    spans = starts.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "of", F.col("bucket").alias("nth"), "before", "words", "source_size", "target", "epochs", "budget"
    )
    rows = sized.join(spans, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("nth"))).drop("of", "nth", "bucket")
    edge = (F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget"))
    flat = rows.where(~edge).withColumn("part", F.when(F.col("before") + F.col("words") <= F.col("budget"), F.col("size")).otherwise(F.lit(0).cast("long")))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "also").rowsBetween(Window.unboundedPreceding, -1)
    on_edge = rows.where(edge).withColumn("reached", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on_edge = on_edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("reached"))).cast("long")).drop("reached")
    return flat.unionByName(on_edge).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1 in turn, targets up to 3 times a source's size."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), [5, 2, 1]).drop("source")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370497.0::DOUBLE)
    / coalesce(1.0::DOUBLE - 0.9::DOUBLE * length(regexp_replace(text, '[\p{L}\s]+', '', 'g')) / nullif(length(text), 0)::DOUBLE, 0.1::DOUBLE) AS key FROM documents
), s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
w AS (SELECT source, n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w, source) AS i FROM w),
g AS (SELECT *, ((SELECT sum(n) FROM s) - coalesce(sum(3 * n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
t AS (SELECT source, n, least(3 * n, (SELECT arg_min(level, i) FROM g WHERE level <= 3 * n / w) * w) AS target FROM g),
p AS (SELECT *, CAST(floor(target / nullif(n, 0)) AS BIGINT) AS epochs, CAST(round(target - floor(target / nullif(n, 0)) * n) AS BIGINT) AS budget FROM t),
r AS (SELECT d.*, p.n, p.target, p.epochs, p.budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source),
o AS (SELECT *, CAST(greatest(0, least(size, budget - before)) AS BIGINT) AS part FROM r)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, epochs * size + part AS taken, epochs, part FROM o
"""
