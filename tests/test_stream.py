"""Streams, run to the end over files."""

from pyspark.sql import functions as F

from meterflow.streaming import stream


def _stream(spark, data):
    schema = spark.read.parquet(f"{data}/sf0.001/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{data}/sf0.001")
    return e.select(F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("t"), F.col("value").alias("v"))


def _run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windows(spark, data):
    out = _run(spark, stream.windowed(_stream(spark, data), ["channel"], "1 day"), "w", "complete")
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/sf0.001/events.parquet").count()


def test_sessions(spark, data):
    out = _run(spark, stream.sessions(_stream(spark, data), ["channel"], "12 hours"), "s", "complete")
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/sf0.001/events.parquet").count()


def test_changes(spark, data):
    s = _stream(spark, data).withColumn("v", F.floor(F.col("v") / 20).cast("double"))
    got = [(r["channel"], r["t"], r["v"]) for r in _run(spark, stream.changes(s, "channel"), "c", "append").orderBy("channel", "t").collect()]
    rows = spark.read.parquet(f"{data}/sf0.001/events.parquet").select("event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"), F.floor(F.col("value") / 20).cast("double")).orderBy("event_type", "ts").collect()
    want, last = [], {}
    for c, t, v in rows:
        if last.get(c) != v:
            want.append((c, t, v))
        last[c] = v
    assert got == want
