"""The stream forms give what the batch forms give, over several micro-batches."""

import pytest

from lexigrid.operators import network
from lexigrid.plans.table_queries import packets_of
from lexigrid.streaming import flows


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stream")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 40")
    for k in range(3):  # files in the order of event_id: a micro-batch each
        rows.where(f"event_id >= {k * 334} and event_id < {(k + 1) * 334}").coalesce(1).write.parquet(f"{at}/{k}")
        (next((at / str(k)).glob("part-*.parquet"))).rename(at / f"{k}.parquet")
    whole = spark.read.parquet(*[f"{at}/{k}.parquet" for k in range(3)])
    return at, whole


def run(spark, at, schema, f, name):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(at))
    q = f(packets_of(stream)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_allow_list(spark, source):
    at, whole = source
    got = run(spark, at, whole.schema, flows.allow_list, "allow_list")
    assert {(r.seq, r.allowed) for r in got.collect()} == {(r.seq, r.allowed) for r in network.allowed(packets_of(whole)).collect()}


def test_mirror(spark, source):
    at, whole = source
    got = run(spark, at, whole.schema, flows.mirror_first, "mirror")
    assert {(r.seq, r.mirrored) for r in got.collect()} == {(r.seq, r.mirrored) for r in network.mirrored(packets_of(whole)).collect()}


def test_flow_bytes_in_windows(spark, source):
    """Windows that the watermark closes have the bytes that the batch gives them; all windows but the last ones close."""
    at, whole = source
    from pyspark.sql import functions as F

    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(at))
    out = flows.flow_bytes(packets_of(stream), "1 hour", "365 days")
    q = out.writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    ends = [c for c in out.columns if c not in ("window", "bytes")]
    last = spark.table("windows").groupBy("window", *ends).agg(F.max("bytes").alias("bytes"))  # the totals only grow
    want = flows.flow_bytes(packets_of(whole), "1 hour", "365 days")
    key = lambda r: (r.window.start, *[r[c] for c in ends], r.bytes)
    assert sorted(map(key, last.collect())) == sorted(map(key, want.collect()))


def test_first_copies(spark, source):
    at, whole = source
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(at)).selectExpr("user_id as transfer_id", "event_type as seq", "ts")
    q = flows.first_copies(stream).writeStream.format("memory").queryName("copies").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("copies").count() == whole.select("user_id", "event_type").distinct().count()
