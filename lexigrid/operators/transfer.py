"""Chunked transfers as data: chunks, duplicates, completeness, reassembly, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(files: DataFrame, size: int = 1024, first: int = 0) -> DataFrame:
    """(transfer_id, content binary) -> (transfer_id, seq, is_last, payload)."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / F.lit(size))).cast("int")
    rows = files.select("transfer_id", "content", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return rows.select("transfer_id", (F.col("k") + first).alias("seq"), (F.col("k") == F.col("n") - 1).alias("is_last"), F.substring("content", F.col("k") * size + 1, F.lit(size)).alias("payload"))


def deduplicated(rows: DataFrame, order: str, keep: str = "first") -> DataFrame:
    """One copy of each (transfer_id, seq): the first or the last by `order`; a partial aggregation, not a sort."""
    own = F.struct(*[c for c in rows.columns if c not in ("transfer_id", "seq")])
    pick = (F.min_by if keep == "first" else F.max_by)(own, F.col(order))
    return rows.groupBy("transfer_id", "seq").agg(pick.alias("x")).select("transfer_id", "seq", "x.*")


def completeness(rows: DataFrame, first: int = 0) -> DataFrame:
    """(transfer_id, received, expected, complete, in_order): in_order is how many chunks from the first on have no gap."""
    got = rows.groupBy("transfer_id", "seq").agg(F.max("is_last").alias("is_last"))
    nth = F.row_number().over(Window.partitionBy("transfer_id").orderBy("seq")) - 1 + first
    got = got.withColumn("straight", (F.col("seq") == nth).cast("long"))
    out = got.groupBy("transfer_id").agg(F.count("*").alias("received"), (F.max(F.when(F.col("is_last"), F.col("seq"))) - first + 1).cast("long").alias("expected"), F.sum("straight").alias("in_order"))
    return out.select("transfer_id", "received", "expected", F.coalesce(F.col("received") == F.col("expected"), F.lit(False)).alias("complete"), "in_order")


def reassembled(rows: DataFrame, order: str) -> DataFrame:
    """(transfer_id, content): the payloads (strings) of complete transfers in the order of seq."""
    one = deduplicated(rows, order)
    whole = completeness(one).where("complete").select("transfer_id")
    parts = F.sort_array(F.collect_list(F.struct("seq", "payload")))
    return one.join(whole, "transfer_id", "left_semi").groupBy("transfer_id").agg(F.array_join(F.transform(parts, lambda p: p["payload"]), "").alias("content"))


def in_window(seq: Column, base: Column, width: int) -> Column:
    return seq.between(base - width, base + width - 1)


def throughput(rows: DataFrame) -> DataFrame:
    """(transfer_id, kilobytes per second, resent) from (transfer_id, seq, bytes, ts in seconds)."""
    out = rows.groupBy("transfer_id").agg(F.sum("bytes").alias("b"), (F.max("ts") - F.min("ts")).alias("s"), (F.count("*") - F.countDistinct("seq")).alias("resent"))
    return out.select("transfer_id", F.try_divide(F.col("b") / 1000.0, F.col("s")).alias("kb_per_s"), "resent")
