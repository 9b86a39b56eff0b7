"""Streams end in the tables that the same rows in one batch give."""

from pyspark.sql import functions as F

from tessera.sources import tables
from tessera.streaming.sinks import upsert_stream, windowed_counts


def test_upsert_stream(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS stream_db")
    src = str(tmp_path / "in")
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("k long, v string").parquet(src)
        upsert_stream(s, "stream_db.kept", ["k"], str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted(map(tuple, spark.table(tables.quoted("stream_db.kept")).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_windowed_counts(spark, sf_dir, tmp_path):
    s = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    w = windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "60 days", "event_type")
    w.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert spark.table("counts").agg(F.sum("count")).first()[0] == events.count()
