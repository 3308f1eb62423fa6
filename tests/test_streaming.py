import datetime

from tallyline.streaming import activity


def test_velocity_and_sessions(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [("a", start + datetime.timedelta(minutes=k), 1.0) for k in range(5)] + [("b", start, 2.0)] + [("z", start + datetime.timedelta(days=9), 0.0)]
    spark.createDataFrame(rows, "statement_id string, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("statement_id string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    for name, df in (("busy", activity.velocity(stream, 3)), ("runs", activity.sessions(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [(r["statement_id"], r["n_rows"]) for r in spark.table("busy").collect()] == [("a", 5)]
    assert sorted((r["statement_id"], r["n_rows"]) for r in spark.table("runs").collect()) == [("a", 5), ("b", 1)]
