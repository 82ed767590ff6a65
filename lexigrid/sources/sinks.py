"""Writers: index dumps, results, metrics, upserts, text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.evaluate import rounded, with_means
from lexigrid.operators.index import dump_lines


def index_dump(index: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """The index as text, ordered by term and document; files in the order of their names. A term of many documents may fill several files."""
    order = [F.col("term"), F.col("doc_id").asc_nulls_first()]
    lines = dump_lines(index, stats).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("line").write.mode("overwrite").text(path)


def boolean_results(rows: DataFrame, path: str, sep: str = ", ") -> None:
    """Lines `qid, doc`, ordered."""
    rows.orderBy("qid", "doc_id").select(F.concat_ws(sep, "qid", "doc_id").alias("value")).write.mode("overwrite").text(path)


def ranked_results(rows: DataFrame, path: str, k: int = 150) -> None:
    """Lines `qid,doc,score` with four places, best first."""
    line = F.format_string("%d,%d,%.4f", "qid", "doc_id", "score")
    rows.where(F.col("rank") <= k).orderBy("qid", "rank").select(line.alias("value")).write.mode("overwrite").text(path)


def csv(rows: DataFrame, path: str, *by: str, partition: str | None = None) -> None:
    out = rows.orderBy(*by) if by else rows
    w = out.write.mode("overwrite").option("header", True)
    (w.partitionBy(partition) if partition else w).csv(path)


def metrics(rows: DataFrame, path: str) -> None:
    """Each system's rows by query, then its means (query: "mean"), to three places."""
    out = rounded(with_means(rows), 3).withColumn("query", F.coalesce(F.col("query").cast("string"), F.lit("mean")))
    out.orderBy("system", F.col("query").try_cast("int").asc_nulls_last()).write.mode("overwrite").option("header", True).csv(path)


def table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """A saved table that later joins on key read without a shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def upsert(old: DataFrame | None, new: DataFrame, key: str, order: str) -> DataFrame:
    """The table after new rows: of each key the last by `order`; new rows replace old ones."""
    pick = F.max_by(F.struct(*[c for c in new.columns if c != key]), F.struct("__new", order))
    rows = new.withColumn("__new", F.lit(1))
    rows = rows if old is None else old.withColumn("__new", F.lit(0)).unionByName(rows)
    return rows.groupBy(key).agg(pick.alias("x")).select(key, "x.*")


def sentence_file(rows: DataFrame, path: str) -> None:
    """Lines `<doc_id> tok tok`; no tail is lost."""
    rows.orderBy("doc_id", "line_no").select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.array_join("tokens", " ")).alias("value")).write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def joined_lines(rows: DataFrame, path: str) -> None:
    rows.orderBy("line_no").select(F.array_join("tokens", " ").alias("value")).write.mode("overwrite").text(path)
