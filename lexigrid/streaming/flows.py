"""Per-flow rules over streams of packets; each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.operators.network import ENDS, canonical, syn


def _stateful(rows: DataFrame, step, out: str, state: str, keys: list[str]) -> DataFrame:
    """applyInPandasWithState over a micro-batch's rows of a flow in the order of seq. step(state tuple or None, rows) -> (state tuple or None, columns)."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        # a micro-batch's packets of one flow, put in order; flows are bounded by the trigger's size
        pdf = pd.concat(list(batches)).sort_values("seq", ignore_index=True)
        now, made = step(now, pdf)
        if now is None:
            if held.exists:
                held.remove()
        else:
            held.update(now)
        yield pd.DataFrame({**dict(zip(keys, key, strict=True)), **made})[[*keys, *names]]

    types = dict(rows.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [out])
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", "NoTimeout")


def allow_list(packets: DataFrame) -> DataFrame:
    """(ends, seq, allowed): as network.allowed, packet by packet; a flow's state is whether it sent outbound TCP over IPv4."""
    rows = canonical(packets).withColumn("ours", (F.col("ip_version") == 4) & (F.col("proto") == 6))

    def step(now, rows):
        opens = rows["ours"] & rows["outbound"]
        before = opens.cummax().shift(fill_value=False) | bool(now and now[0])
        after = bool(now and now[0]) or bool(opens.any())
        return (after,), {"seq": rows["seq"], "allowed": ~rows["ours"] | rows["outbound"] | before}

    return _stateful(rows, step, "seq long, allowed boolean", "opened boolean", ENDS)


def mirror_first(packets: DataFrame, n: int = 10) -> DataFrame:
    """(ends, seq, mirrored): as network.mirrored; the count starts at an inbound SYN, and the state goes once n have passed."""
    rows = canonical(packets).withColumn("opening", syn(F.col("flags")) & ~F.col("outbound") & (F.col("proto") == 6))

    def step(now, rows):
        # the place of each packet since the last opening, or since the one that the state counts from
        epoch = rows["opening"].cumsum()
        nth = rows.groupby(epoch).cumcount() + 1
        carried = epoch == 0
        nth = nth + (now[0] if now else 0) * carried
        mirrored = (nth <= n) & (~carried | (now is not None))
        count = int(nth.iloc[-1])
        return ((count,) if mirrored.iloc[-1] and count < n else None), {"seq": rows["seq"], "mirrored": mirrored}

    return _stateful(rows, step, "seq long, mirrored boolean", "count int", ENDS)


def _timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """rows with a watermark; a timestamp without a time zone is taken in the session's."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def first_copies(chunks: DataFrame, late: str | None = None, ts: str = "ts") -> DataFrame:
    """The first copy of each (transfer_id, seq); with `late` (a delay), state is kept for so long only."""
    keys = ["transfer_id", "seq"]
    return _timed(chunks, ts, late).dropDuplicatesWithinWatermark(keys) if late else chunks.dropDuplicates(keys)


def flow_bytes(packets: DataFrame, window: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Bytes per flow of a stream, in windows of event time if asked for."""
    rows = canonical(packets)
    if window:
        return _timed(rows, ts, late).groupBy(F.window(ts, window), *ENDS).agg(F.sum("bytes").alias("bytes"))
    return rows.groupBy(*ENDS).agg(F.sum("bytes").alias("bytes"))
