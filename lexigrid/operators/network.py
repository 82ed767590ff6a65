"""Packet analytics: flow totals, prefix roll-up, per-flow rules in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.storage import written

ENDS = ["ip_version", "lo_ip", "lo_port", "hi_ip", "hi_port"]


def tcp(packets: DataFrame, versions: tuple[int, ...] = (4, 6)) -> DataFrame:
    return packets.where(F.col("ip_version").isin(*versions) & (F.col("proto") == 6))


def payload(ip_version: Column, total: Column, header_words: Column, plen: Column) -> Column:
    """Bytes after the IP header: v4 total length less the header, v6 the payload length."""
    return F.when(ip_version == 4, total - header_words * 4).otherwise(plen)


def canonical(packets: DataFrame) -> DataFrame:
    """packets with the endpoints of both directions in one order, and forward: whether the source is the lower end."""
    src, dst = (F.struct(F.col(f"{x}_ip").alias("ip"), F.col(f"{x}_port").alias("port")) for x in ("src", "dst"))
    lo, hi = F.least(src, dst), F.greatest(src, dst)
    return packets.select("*", lo["ip"].alias("lo_ip"), lo["port"].alias("lo_port"), hi["ip"].alias("hi_ip"), hi["port"].alias("hi_port"), (src <= dst).alias("forward"))


def flow_bytes(packets: DataFrame) -> DataFrame:
    """Bytes of each flow, both directions together."""
    return canonical(packets).groupBy(*ENDS).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("packets"))


def top_flows(flows: DataFrame, k: int = 100) -> DataFrame:
    return flows.orderBy(F.desc("bytes"), *ENDS).limit(k)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin from 0, n) over equal widths between the least and the largest value; the largest is in the last bin."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = F.nullif((F.col("high") - F.col("low")).cast("double"), F.lit(0.0))
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col(column) - F.col("low")) / width * bins), F.lit(0)))
    return df.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def source_bytes(packets: DataFrame) -> DataFrame:
    """(src_ip, bytes, total)."""
    own = packets.groupBy("src_ip").agg(F.sum("bytes").alias("bytes"))
    return own.crossJoin(F.broadcast(packets.agg(F.sum("bytes").alias("total"))))


def prefix_rollup(packets: DataFrame, share: float = 0.05) -> DataFrame:
    """(net, plen, bytes): every prefix that keeps `share` of all bytes after its heavier sub-prefixes took theirs, and what is left at the root.

    Bottom-up over prefix lengths 32 .. 0, so that the order of packets doesn't matter: at each length a prefix with enough bytes is
    given out, the others go on to the next shorter one. Rows are dealt by a prefix that eight lengths share, so these need no
    shuffle among them; sources are summed before, and what is given out, 1 / share prefixes at most, goes along as a list.
    """
    rows = written(packets.groupBy(F.col("src_ip").alias("net")).agg(F.sum("bytes").alias("bytes")).where("bytes > 0"), "rollup")
    least = share * (rows.agg(F.sum("bytes")).first()[0] or 0)
    one = lambda plen: F.struct(F.col("net"), F.lit(plen).alias("plen"), F.col("bytes"))
    rows = rows.withColumn("given", F.lit(None).cast("array<struct<net:bigint,plen:int,bytes:bigint>>"))
    for plen in range(32, 0, -1):
        if plen % 8 == 0:
            rows = rows.withColumn("key", F.shiftright("net", 40 - plen)).repartition("key")
        heavy = (F.col("bytes") >= least) & (F.col("bytes") > 0)
        also = F.concat(F.coalesce("given", F.array().cast(rows.schema["given"].dataType)), F.array(one(plen)))
        rows = rows.withColumn("given", F.when(heavy, also).otherwise(F.col("given"))).withColumn("bytes", F.when(heavy, 0).otherwise(F.col("bytes")))
        size = 1 << (33 - plen)
        wider = (F.floor(F.col("net") / size) * size).cast("long").alias("net")
        rows = rows.groupBy("key", wider).agg(F.sum("bytes").alias("bytes"), F.flatten(F.collect_list("given")).alias("given"))
        rows = rows.withColumn("given", F.when(F.size("given") > 0, F.col("given")))
    rest = F.when(F.col("bytes") > 0, F.array(one(0))).otherwise(F.array().cast(rows.schema["given"].dataType))
    return rows.select(F.inline(F.concat(F.coalesce("given", F.array().cast(rows.schema["given"].dataType)), rest)))


def allowed(packets: DataFrame) -> DataFrame:
    """packets (seq, outbound, ...) with allowed: outbound TCP, and inbound TCP of a flow that sent outbound before; all that is no TCP over IPv4.

    A flow is known by its first outbound packet: a partial aggregation and a join, so that a flow of many packets is no hot key.
    """
    rows = canonical(packets)
    ours = (F.col("ip_version") == 4) & (F.col("proto") == 6)
    first = rows.where(ours & F.col("outbound")).groupBy(*ENDS).agg(F.min("seq").alias("__opened"))
    rows = rows.join(first, ENDS, "left").withColumn("allowed", ~ours | F.col("outbound") | F.coalesce(F.col("__opened") < F.col("seq"), F.lit(False)))
    return rows.select(*packets.columns, *ENDS[1:], "forward", "allowed")


def syn(flags: Column) -> Column:
    """SYN without ACK."""
    return (flags.bitwiseAND(2) != 0) & (flags.bitwiseAND(16) == 0)


def mirrored(packets: DataFrame, n: int = 10) -> DataFrame:
    """packets with mirrored: the first n of each flow from each opening (an inbound SYN) on; a new SYN starts anew."""
    flow = Window.partitionBy(*ENDS).orderBy("seq")
    rows = canonical(packets).withColumn("opening", syn(F.col("flags")) & ~F.col("outbound") & (F.col("proto") == 6))
    rows = rows.withColumn("epoch", F.sum(F.col("opening").cast("int")).over(flow))
    nth = F.row_number().over(Window.partitionBy(*ENDS, "epoch").orderBy("seq"))
    return rows.withColumn("mirrored", (F.col("epoch") > 0) & (nth <= n)).drop("opening")
