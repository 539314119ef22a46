from tessera.streaming.counts import windowed_cells


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_cells(stream, "ts", "user_id", "event_type", "value", "1 day").writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    want = windowed_cells(events, "ts", "user_id", "event_type", "value", "1 day")
    got = spark.sql("SELECT * FROM cells")
    key = lambda d: sorted((str(r.start), r.r, r.c, round(r.v, 6)) for r in d.collect())
    assert key(got) == key(want)
