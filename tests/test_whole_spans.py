from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_pq_windows_of_whole_spans(spark):
    sf_dir = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('error', 'purchase')")
    minute = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 60_000_000)
    span = e.groupBy("user_id").agg((minute(F.max("ts")) - minute(F.min("ts")) + 1).alias("minutes"))
    got = entry.queries()["i11_pq_windows"](spark, sf_dir)
    assert {r.perspective_id: r.minutes for r in got.collect()} == {r.user_id: r.minutes for r in span.collect()}
