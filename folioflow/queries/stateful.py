"""Signals, adaptive statistics and small stores over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, signal, state
from .register import Register, read

REGISTER = Register()


def _samples(spark, d):
    return read(spark, d, "events").select((F.col("event_id") % 20).alias("clip"), F.floor(F.col("event_id") / 20).alias("i"), F.col("value").alias("x"))


_RMS = """SELECT clip, w, sqrt(avg(x * x)) AS rms FROM (SELECT event_id % 20 AS clip, (event_id // 20) // 25 AS w, value AS x FROM events) GROUP BY 1, 2 HAVING count(*) = 25"""


@REGISTER("sg_rms", f"SELECT clip, w, round(rms, 8) AS rms FROM ({_RMS})")
def rms(spark, d):
    return signal.rms_windows(_samples(spark, d), "clip", "i", "x", 25).select("clip", "w", F.round("rms", 8).alias("rms"))


@REGISTER(
    "sg_p95",
    f"""WITH r AS ({_RMS}), o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY rms) - 1 AS n, count(*) OVER (PARTITION BY clip) AS a FROM r),
    e AS (SELECT clip, max(rms) AS edge FROM o WHERE n = least(floor(a * 0.95), a - 1) GROUP BY 1)
    SELECT clip, w, round(pow(least(1.0, rms / greatest(edge, 0.06)), 0.65), 8) AS level FROM r JOIN e USING (clip)""",
)
def p95(spark, d):
    windows = signal.rms_windows(_samples(spark, d), "clip", "i", "x", 25)
    return signal.normalised(windows, "clip", "rms").select("clip", "w", F.round("level", 8).alias("level"))


@REGISTER("sg_smooth", f"SELECT clip, w, round(coalesce(lag(rms) OVER o, rms) * 0.25 + rms * 0.5 + coalesce(lead(rms) OVER o, rms) * 0.25, 8) AS smooth FROM ({_RMS}) WINDOW o AS (PARTITION BY clip ORDER BY w)")
def smooth(spark, d):
    windows = signal.rms_windows(_samples(spark, d), "clip", "i", "x", 25)
    return signal.smoothed(windows, "clip", "w", "rms").select("clip", "w", F.round("smooth", 8).alias("smooth"))


@REGISTER(
    "st_ema",
    """WITH RECURSIVE e AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL),
    s AS (SELECT user_id, 1::BIGINT AS k, x AS mean, 1::BIGINT AS n FROM e WHERE k = 1
      UNION ALL SELECT s.user_id, e.k, CASE WHEN s.n >= 4 AND (e.x < s.mean * 0.4 OR e.x > s.mean * 2.5) THEN s.mean ELSE s.mean + (e.x - s.mean) * greatest(0.08, 1.0 / (s.n + 1)) END,
        CASE WHEN s.n >= 4 AND (e.x < s.mean * 0.4 OR e.x > s.mean * 2.5) THEN s.n ELSE s.n + 1 END FROM s JOIN e ON s.user_id = e.user_id AND e.k = s.k + 1)
    SELECT user_id, round(arg_max(mean, k), 8) AS mean, arg_max(n, k) AS n FROM s GROUP BY 1""",
)
def ema(spark, d):
    return state.ema(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", F.round("mean", 8).alias("mean"), "n")


@REGISTER(
    "st_vote",
    """WITH RECURSIVE e AS (SELECT user_id, event_type AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT user_id, 1::BIGINT AS k, f AS form, 1::BIGINT AS votes FROM e WHERE k = 1
      UNION ALL SELECT s.user_id, e.k, CASE WHEN form <> f AND votes - 1 <= 0 THEN f ELSE form END, CASE WHEN form = f THEN least(1000, votes + 1) WHEN votes - 1 <= 0 THEN 1 ELSE votes - 1 END
      FROM s JOIN e ON s.user_id = e.user_id AND e.k = s.k + 1)
    SELECT user_id, arg_max(form, k) AS form, arg_max(votes, k) AS votes FROM s GROUP BY 1""",
)
def vote(spark, d):
    return state.votes(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@REGISTER(
    "st_health",
    """WITH RECURSIVE e AS (SELECT event_type AS g, (value > 30)::INTEGER::DOUBLE AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT g, 0::BIGINT AS k, 0.0::DOUBLE AS ok, 0.0::DOUBLE AS fail FROM e WHERE k = 1
      UNION ALL SELECT s.g, e.k, ok / CASE WHEN ok + fail > 200 THEN 2.0 ELSE 1.0 END + x, fail / CASE WHEN ok + fail > 200 THEN 2.0 ELSE 1.0 END + 1 - x FROM s JOIN e ON s.g = e.g AND e.k = s.k + 1)
    SELECT g AS event_type, round((arg_max(ok, k) + 2) / (arg_max(ok, k) + arg_max(fail, k) + 3), 8) AS health FROM s GROUP BY 1""",
)
def health(spark, d):
    t = read(spark, d, "events").where("value is not null").withColumn("good", F.col("value") > 30)
    return state.decayed_health(t, "event_type", ["ts", "event_id"], "good").select("event_type", F.round("health", 8).alias("health"))


@REGISTER("st_lru_topk", "SELECT user_id, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def lru(spark, d):
    return state.lru(read(spark, d, "events"), "user_id", "ts", 40).select("user_id", F.unix_micros(F.col("last_used").cast("timestamp")).alias("last_us"))


@REGISTER("st_behaviour", "SELECT user_id, (CASE WHEN count(*) >= 20 THEN -floor(least(8.0, count(*) FILTER (event_type = 'error') / count(*) * 40) + 0.5) ELSE 0 END)::BIGINT AS penalty FROM events GROUP BY 1")
def behaviour(spark, d):
    return state.behaviour_ratio(read(spark, d, "events").withColumn("bad", F.col("event_type") == "error"), "user_id", "bad")


@REGISTER(
    "st_calibrated",
    """SELECT user_id, CASE WHEN na >= 6 AND nb >= 6 AND b <> 0 THEN round(greatest(0.7, least(1.45, a / b)), 8) ELSE 1.0 END AS ratio FROM
    (SELECT user_id, avg(value) AS a, count(*) AS na FROM events WHERE event_type = 'view' GROUP BY 1) JOIN (SELECT user_id, avg(value) AS b, count(*) AS nb FROM events WHERE event_type = 'click' GROUP BY 1) USING (user_id)""",
)
def calibrated(spark, d):
    t = read(spark, d, "events")
    side = lambda kind: t.where(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return state.calibrated_ratio(side("view"), side("click"), "user_id").select("user_id", F.round("ratio", 8).alias("ratio"))


@REGISTER("st_recents", "SELECT uri, last_us FROM (SELECT user_id % 40 AS uri, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1) ORDER BY last_us DESC, uri LIMIT 30")
def recents(spark, d):
    t = read(spark, d, "events").select((F.col("user_id") % 40).alias("uri"), F.unix_micros(F.col("ts").cast("timestamp")).alias("last_us"), "event_id")
    return ranking.recent(t, "uri", "last_us").select("uri", "last_us")


@REGISTER("st_bookmarks", "SELECT user_id, page FROM (SELECT user_id, event_id % 9 AS page, count(*) AS n FROM events GROUP BY 1, 2) WHERE n % 2 = 1")
def bookmarks(spark, d):
    return ranking.toggled(read(spark, d, "events").select("user_id", (F.col("event_id") % 9).alias("page")), "user_id", "page")


@REGISTER("st_best_choice", "SELECT event_type, arg_max(user_id, value) AS user_id, max(value) AS value FROM events GROUP BY 1")
def best(spark, d):
    return ranking.pick_best(read(spark, d, "events").where("value is not null"), "event_type", "value", "user_id")


@REGISTER(
    "st_gate",
    """WITH m AS (SELECT event_id, event_id % 60 AS chars, (event_id * 37) % 130000 AS ms, event_id % 90 - 60 AS pct, (event_id % 7 - 1) / 2.0::DOUBLE AS rate FROM events)
    SELECT event_id, round(CASE WHEN chars >= 14 AND ms >= 400 AND ms::DOUBLE / chars * greatest(0.5, 1 + pct / 100.0::DOUBLE) BETWEEN 10 AND 500 THEN ms::DOUBLE / chars * greatest(0.5, 1 + pct / 100.0::DOUBLE) END, 8) AS service,
      round(CASE WHEN chars >= 14 AND ms BETWEEN 400 AND 120000 AND rate > 0 AND ms::DOUBLE / chars * rate BETWEEN 10 AND 600 THEN ms::DOUBLE / chars * rate END, 8) AS device FROM m""",
)
def gate(spark, d):
    i = F.col("event_id")
    t = read(spark, d, "events").select("event_id", (i % 60).alias("chars"), (i * 37 % 130000).alias("ms"), (i % 90 - 60).alias("pct"), ((i % 7 - 1) / 2.0).alias("rate"))
    chars, ms = F.col("chars"), F.col("ms")
    return t.select("event_id", F.round(state.pace(chars, ms, F.col("pct")), 8).alias("service"), F.round(state.device_pace(chars, ms, F.col("rate")), 8).alias("device"))


@REGISTER(
    "st_blame",
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
        (CASE WHEN event_type IN ('error', 'signup') THEN least(1.0, 3.0 / (1 + event_id % 5)) ELSE -0.1 END)::DECIMAL(18,6) AS step FROM events),
    s AS (SELECT user_id, 0::BIGINT AS k, 0::DECIMAL(18,6) AS b FROM e WHERE k = 1 UNION ALL SELECT s.user_id, e.k, greatest(0, s.b + e.step)::DECIMAL(18,6) FROM s JOIN e ON s.user_id = e.user_id AND e.k = s.k + 1)
    SELECT user_id, round(arg_max(b, k)::DOUBLE, 6) AS blame, round(arg_max(b, k)::DOUBLE, 6) >= 2 AS reverts FROM s GROUP BY 1""",
)
def blame(spark, d):
    t = read(spark, d, "events").withColumns({"rewound": F.col("event_type").isin("error", "signup"), "candidates": 1 + F.col("event_id") % 5})
    return state.blame(t, "user_id", ["ts", "event_id"], "rewound", "candidates")


@REGISTER(
    "st_listening",
    """WITH RECURSIVE e AS (SELECT event_type, (value > 30)::INTEGER AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL),
    s AS (SELECT event_type, 0::BIGINT AS k, 0.0::DOUBLE AS r, 0.0::DOUBLE AS h FROM e WHERE k = 1
      UNION ALL SELECT s.event_type, e.k, CASE WHEN r > 400 THEN r / 2 ELSE r END + x, CASE WHEN h > 400 THEN h / 2 ELSE h END + 1 - x FROM s JOIN e ON s.event_type = e.event_type AND e.k = s.k + 1),
    l AS (SELECT event_type, arg_max(r, k) AS rewinds, arg_max(h, k) AS heard FROM s GROUP BY 1)
    SELECT event_type, round(rewinds, 8) AS rewinds, round(heard, 8) AS heard, (CASE WHEN rewinds + heard >= 20 THEN -floor(least(8.0, rewinds / (rewinds + heard) * 40) + 0.5) ELSE 0 END)::BIGINT AS percent FROM l""",
)
def listening(spark, d):
    t = read(spark, d, "events").where("value is not null").withColumn("back", F.col("value") > 30)
    return state.listening(t, "event_type", ["ts", "event_id"], "back").select("event_type", F.round("rewinds", 8).alias("rewinds"), F.round("heard", 8).alias("heard"), "percent")
