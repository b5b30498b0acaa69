"""Results by request and generation: replayed, stale, cancelled and swept."""

import pytest
from pyspark.sql import functions as F

from folioflow.sinks import progressive

ROWS = "request string, generation int, hit int, batch_no int"


def frame(spark, *rows):
    return spark.createDataFrame([(*r, 0) for r in rows], ROWS)


def held(spark, path):
    return sorted((r.request, r.generation, r.hit) for r in progressive.results(spark, path).collect())


def stored(spark, path):
    return sorted((r.request, r.generation, r.hit) for r in spark.read.parquet(f"{path}/rows").collect())


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "found")


def test_a_replayed_batch_leaves_one_copy(spark, path):
    write = progressive.sink(path)
    for number in (0, 1, 1, 0):
        write(frame(spark, ("a", 1, 10 + number), ("b", 1, 20 + number)), number)
    assert stored(spark, path) == [("a", 1, 10), ("a", 1, 11), ("b", 1, 20), ("b", 1, 21)] == held(spark, path)


def test_older_generations_are_stale(spark, path):
    write = progressive.sink(path)
    write(frame(spark, ("a", 1, 1), ("b", 1, 2)), 0)
    progressive.ask(frame(spark, ("a", 2, 0)), path)
    assert held(spark, path) == [("b", 1, 2)]
    write(frame(spark, ("a", 1, 3), ("a", 2, 4), ("b", 1, 5)), 1)
    assert held(spark, path) == [("a", 2, 4), ("b", 1, 2), ("b", 1, 5)]
    assert ("a", 1, 3) not in stored(spark, path) and ("a", 1, 1) in stored(spark, path)
    write(frame(spark, ("b", 3, 6), ("b", 2, 7)), 2)  # never asked: the newest that has results
    assert held(spark, path) == [("a", 2, 4), ("b", 3, 6)]


def test_a_cancelled_generation_leaves_nothing(spark, path):
    write = progressive.sink(path)
    write(frame(spark, ("a", 1, 1), ("a", 2, 2), ("b", 1, 3)), 0)
    write(frame(spark, ("a", 2, 4)), 1)
    for _ in range(2):
        progressive.ask(frame(spark, ("a", 2, 0)), path, cancelled=True)
    write(frame(spark, ("a", 2, 5), ("b", 1, 6)), 2)
    assert held(spark, path) == [("b", 1, 3), ("b", 1, 6)]
    for _ in range(2):
        progressive.sweep(spark, path)
        assert stored(spark, path) == [("b", 1, 3), ("b", 1, 6)]
    progressive.ask(frame(spark, ("a", 3, 0)), path)
    write(frame(spark, ("a", 3, 7), ("a", 2, 8)), 3)
    assert held(spark, path) == [("a", 3, 7), ("b", 1, 3), ("b", 1, 6)]


def test_nulls_and_empty_batches(spark, path):
    write = progressive.sink(path)
    progressive.ask(frame(spark, (None, 1, 0), ("a", None, 0)), path)
    write(frame(spark), 0)
    assert held(spark, path) == []
    write(frame(spark, (None, 1, 1), ("a", None, 2), ("a", 1, None), ("a", 1, None)), 1)
    assert progressive.results(spark, path).count() == 2


def test_a_stream_that_starts_again_and_replays_its_last_batch(spark, tmp_path, path):
    """The log of finished batches loses its last entry, as if the driver had died after writing: that batch comes again."""
    source, log = str(tmp_path / "in"), tmp_path / "log"
    for k in range(3):
        frame(spark, ("a", 1, k), ("b", k, k)).coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
        q = stream.writeStream.foreachBatch(progressive.sink(path)).option("checkpointLocation", str(log)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    drain()
    once = held(spark, path)
    assert [r for r in once if r[0] == "a"] == [("a", 1, k) for k in range(3)] and len([r for r in once if r[0] == "b"]) == 1
    batches = {r.batch for r in progressive.results(spark, path).select("batch").distinct().collect()}
    last = sorted(p for p in (log / "commits").iterdir() if p.name.isdigit())[-1]
    last.unlink()
    (log / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    drain()
    assert held(spark, path) == once and {r.batch for r in progressive.results(spark, path).select("batch").distinct().collect()} == batches
    assert progressive.results(spark, path).where(F.col("request").isNull()).count() == 0
