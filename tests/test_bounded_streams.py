"""Streams with bounded state against their batch forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.operators import state
from folioflow.streaming import bounded

START = datetime(2024, 1, 1)
USES = "g string, item string, at timestamp, rewound boolean, candidates int"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, bounded.ROCKSDB)
    yield spark
    spark.conf.unset(key)


def fed(spark, rows, schema, folder, files=3):
    """A stream of the rows, so many files of them in order, a file a trigger."""
    step = -(-len(rows) // files)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, df, name, folder, mode="update"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.table(name).collect(), q


def uses(n, items, groups=2, seed=1):
    rng = random.Random(seed)
    return [(f"g{rng.randrange(groups)}", f"i{rng.randrange(items)}", START + timedelta(seconds=k), rng.random() < 0.4, rng.randrange(1, 9)) for k in range(n)]


def test_lru_holds_what_was_used_last_and_no_more(rocks, tmp_path):
    rows, keep = uses(900, 300), 10
    got, q = drained(rocks, bounded.lru(fed(rocks, rows, USES, tmp_path / "in"), "g", "item", "at", keep), "lru_out", tmp_path / "cp")
    held = {}
    for r in got:
        held.pop((r.group, r.item), None)
        if r.state == "kept":
            held[r.group, r.item] = r.used
    df = rocks.createDataFrame(rows, USES)
    for g in ("g0", "g1"):
        want = {r["item"] for r in state.lru(df.where(F.col("g") == g), "item", "at", keep).collect()}
        assert {i for (h, i) in held if h == g} == want
    assert any(r.state == "evicted" for r in got)
    kept = q.lastProgress["stateOperators"][0]["customMetrics"]
    stored = rocks.read.format("statestore").option("stateVarName", "items").load(str(tmp_path / "cp")).count()
    assert stored == 2 * keep, kept  # 300 items were used in either group


def test_blame_and_listening_equal_their_batch_forms(rocks, tmp_path):
    rows = uses(600, 12)
    df = rocks.createDataFrame(rows, USES).withColumn("k", F.concat_ws("/", "g", "item"))
    stream = fed(rocks, rows, USES, tmp_path / "in")
    got, _ = drained(rocks, bounded.blame(stream, "g", "item", "at", "rewound", "candidates", keep=50), "blame_out", tmp_path / "cp1")
    last = {f"{r.group}/{r.item}": r.blame / 1e6 for r in got}
    want = {r.k: r.blame for r in state.blame(df, "k", ["at"], "rewound", "candidates").collect()}
    assert last.keys() == want.keys() and all(abs(last[k] - want[k]) < 1e-5 for k in want)
    got, _ = drained(rocks, bounded.listening(stream, "g", "item", "at", "rewound", keep=50), "listening_out", tmp_path / "cp2")
    last = {f"{r.group}/{r.item}": (r.rewinds, r.heard) for r in got}
    assert last == {r.k: (r.rewinds, r.heard) for r in state.listening(df, "k", ["at"], "rewound").collect()}


def test_idle_groups_expire_and_late_rows_are_dropped(rocks, tmp_path):
    day = lambda k: START + timedelta(days=k)
    rows = [("a", "x", day(0), True, 1), ("a", None, day(0), True, 1), ("b", "y", day(40), True, 1), ("c", "n", None, True, 1), ("b", "y", day(41), True, 1), ("a", "late", day(1), True, 1)]
    got, _ = drained(rocks, bounded.lru(fed(rocks, rows, USES, tmp_path / "in", files=6), "g", "item", "at", 5, idle="30 days"), "idle_out", tmp_path / "cp")
    assert {(r.group, r.item, r.state) for r in got} == {("a", "x", "kept"), ("a", None, "kept"), ("a", "x", "expired"), ("a", None, "expired"), ("b", "y", "kept")}
    assert max(r.uses for r in got if r.group == "b") == 2


def test_ratio_of_two_streams_out_of_order(spark, sf_dir, tmp_path):
    """Shuffled rows of two streams, with a row each far ahead to close the window, give what the batch query gives."""
    from folioflow.queries import QUERIES

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    schema = "user_id long, ts timestamp, value double"
    sides = []
    for kind in ("view", "click"):
        rows = [tuple(r) for r in events.where(F.col("event_type") == kind).select("user_id", "ts", "value").collect()]
        random.Random(5).shuffle(rows)
        rows += [(-1, datetime(2031, 1, 1), 1.0), (-1, datetime(2032, 1, 1), 1.0), (rows[0][0], datetime(2024, 1, 5), 1e9)]  # the last is late
        spark.createDataFrame(rows[:-3], schema).coalesce(1).write.parquet(str(tmp_path / kind))
        for r in rows[-3:]:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
        sides.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / kind)))
    got, _ = drained(spark, bounded.calibrated(*sides, "user_id", "ts", "value", width="1000 days", late="40 days"), "ratio_out", tmp_path / "cp", "append")
    want = {r.user_id: r.ratio for r in QUERIES["st_calibrated"](spark, sf_dir).collect()}
    found = {r.user_id: round(r.ratio, 8) for r in got if r.user_id != -1}
    assert want and found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-7 for k in want)
