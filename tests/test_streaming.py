"""Streams give what batches give."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators import state
from folioflow.streaming import state as stream


def drained(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null and user_id < 8").orderBy("ts", "event_id").repartition(1)
    halves = events.withColumn("n", F.ntile(2).over(Window.orderBy("ts", "event_id")))
    for n in (1, 2):
        halves.where(F.col("n") == n).drop("n").write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    order = ["ts", "event_id"]
    got = drained(spark, stream.ema(source, "user_id", order, "value"), "update", "ema_out").groupBy("user_id").agg(F.max_by("mean", "n").alias("mean"), F.max("n").alias("n"))
    want = {r.user_id: (r.mean, r.n) for r in state.ema(events, "user_id", order, "value").collect()}
    assert {r.user_id: round(r.mean, 9) for r in got.collect()}.keys() == want.keys()
    assert all(abs(r.mean - want[r.user_id][0]) < 1e-9 and r.n == want[r.user_id][1] for r in got.collect())


def test_steps_match_folds(spark):
    rows = [(1, i, f, x, ok) for i, (f, x, ok) in enumerate([("a", 10.0, True), ("a", 11.0, False), ("b", 9.0, True), ("b", 10.0, True), ("b", 12.0, False), ("c", 100.0, True), ("b", 10.5, True)])]
    df = spark.createDataFrame(rows, "k int, i int, f string, x double, ok boolean")
    form, votes, mean, n, good, bad = None, 0, None, 0, 0.0, 0.0
    for _, _, f, x, ok in rows:
        form, votes = state.vote_step(form, votes, f)
        mean, n = state.ema_step(mean, n, x)
        good, bad = state.health_step(good, bad, ok)
    assert tuple(state.votes(df, "k", ["i"], "f").first())[1:] == (form, votes)
    r = state.ema(df, "k", ["i"], "x").first()
    assert abs(r["mean"] - mean) < 1e-12 and r["n"] == n == 6
    h = state.decayed_health(df, "k", ["i"], "ok").first()
    assert (h.ok, h.fail) == (good, bad)


def test_watermarked_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value").where("value is not null")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = drained(spark, stream.windowed_rms(source, "ts", "value", "1 day"), "complete", "rms_out")
    want = events.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in want.collect())
