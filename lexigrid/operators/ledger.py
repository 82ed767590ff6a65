"""Ledgers as event folds: balances, supply, overdrafts, offers matched within a lock time, commitments revealed in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balances(entries: DataFrame) -> DataFrame:
    """(account, asset, balance, lowest, ever_negative) from (seq, account, asset, delta); amounts up to decimal(38, 0). Of one seq, what is taken comes first."""
    run = F.sum("delta").over(Window.partitionBy("account", "asset").orderBy("seq", "delta").rowsBetween(Window.unboundedPreceding, 0))
    rows = entries.withColumn("run", run)
    out = rows.groupBy("account", "asset").agg(F.sum("delta").alias("balance"), F.min("run").alias("lowest"))
    return out.withColumn("ever_negative", F.col("lowest") < 0)


def supply(entries: DataFrame) -> DataFrame:
    return entries.groupBy("asset").agg(F.sum("delta").alias("supply"))


def transfers(moves: DataFrame) -> DataFrame:
    """(seq, sender, receiver, asset, amount) as two entries each."""
    return moves.select("seq", F.col("sender").alias("account"), "asset", (-F.col("amount")).alias("delta")).unionByName(moves.select("seq", F.col("receiver").alias("account"), "asset", F.col("amount").alias("delta")))


def matched(offers: DataFrame, accepts: DataFrame, lock: int = 50) -> DataFrame:
    """Offers with an acceptance of the same terms by block + lock: (offer_id, accept_id), the earliest."""
    terms = ["give_asset", "give_amount", "want_asset", "want_amount"]
    pair = offers.join(accepts.withColumnRenamed("block", "at"), terms).where((F.col("at") >= F.col("block")) & (F.col("at") <= F.col("block") + lock))
    return pair.groupBy("offer_id").agg(F.min_by("accept_id", F.struct("at", "accept_id")).alias("accept_id"))


def revealed(events: DataFrame, limit: int = 30) -> DataFrame:
    """Reveals in time: (player, block) where a reveal follows the player's last commitment by 1 to limit blocks."""
    last = F.last(F.when(F.col("kind") == "commit", F.col("block")), ignorenulls=True).over(Window.partitionBy("player").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("committed", last).where((F.col("kind") == "reveal") & (F.col("block") > F.col("committed")) & (F.col("block") <= F.col("committed") + limit)).select("player", "block")
