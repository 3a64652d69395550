import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparkloom.streaming import jobs


def drain(query, seconds=60):
    query.awaitTermination(seconds)
    query.stop()


def _source(spark, tmp_path, rows):
    spark.createDataFrame(rows, "k long, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k long, ts timestamp, v double").parquet(str(tmp_path / "in"))


def _rows():
    t = datetime(2024, 1, 1)
    return [(1, t + timedelta(seconds=s), 1.0) for s in (0, 60, 120, 1000, 1010)] + [(2, t, 5.0)]


def test_sessions_batch_and_stream_agree(spark, tmp_path):
    rows = _rows()
    want = {(r.k, r.events) for r in jobs.sessions(spark.createDataFrame(rows, "k long, ts timestamp, v double"), "k", "ts").collect()}
    assert want == {(1, 3), (1, 2), (2, 1)}
    q = jobs.sessions(_source(spark, tmp_path, rows), "k", "ts").writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    drain(q)
    assert {(r.k, r.events) for r in spark.table("sess").collect()} == want


def test_rate_limit_and_buffer(spark, tmp_path):
    src = _source(spark, tmp_path, _rows())
    q = jobs.allow_requests(src, "k", "ts", 2, 600).writeStream.format("memory").queryName("rate").outputMode("append").trigger(availableNow=True).start()
    drain(q)
    got = sorted((r.k, r.ts, r.admitted) for r in spark.table("rate").collect())
    assert [x[2] for x in got if x[0] == 1] == [True, True, False, True, True]
    q = jobs.burst_flush(src, "k", "ts", most=2).writeStream.format("memory").queryName("burst").outputMode("update").trigger(availableNow=True).start()
    drain(q, 12)  # its timers keep it running
    assert sum(r.turns for r in spark.table("burst").collect() if r.k == 1) == 4


def test_once_and_spend(spark, tmp_path):
    rows = _rows()
    q = jobs.once(_source(spark, tmp_path, rows), "k", "ts").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    drain(q)
    assert spark.table("once").count() == 2
    spent = jobs.spend_windows(spark.createDataFrame(rows, "k long, ts timestamp, v double"), "k", "ts", "v")
    assert spent.groupBy("k").agg(F.max("spent").alias("m")).where("k = 1").first().m == 5.0


def test_watch_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    q = jobs.watch_folder(spark, str(tmp_path / "in"), "*.md", lambda df, i: seen.extend(r.path for r in df.collect()), str(tmp_path / "ck"), "1 second")
    (tmp_path / "in" / "a.md").write_text("x")
    deadline = time.time() + 60
    while not seen and time.time() < deadline:
        time.sleep(0.5)
    q.stop()
    assert len(seen) == 1 and seen[0].endswith("a.md")
