from gridweave.streaming.incidence import windowed_incidence

DATA = "/root/testdata/sf0.001/events.parquet"


def test_stream_matches_batch(spark, tmp_path):
    batch = spark.read.parquet(DATA)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_incidence(stream, "ts", "user_id", "event_type").writeStream.outputMode("complete").format("memory").queryName("inc").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("select window_start, row, col, n from inc").collect()}
    want = {tuple(r) for r in windowed_incidence(batch, "ts", "user_id", "event_type").select("window_start", "row", "col", "n").collect()}
    assert got == want and got
