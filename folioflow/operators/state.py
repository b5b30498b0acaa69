"""Adaptive statistics as ordered folds; ``streaming.state`` has the same steps for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A running mean's least weight of news, and how far news may stray once it has some history.
LEAST_WEIGHT, WARM, LOW, HIGH = 0.08, 4, 0.4, 2.5


def ema_step(mean: float | None, n: int, x: float) -> tuple[float, int]:
    """One observation: the first sets the mean; after a few, strays are dropped."""
    if n >= WARM and mean and not LOW * mean <= x <= HIGH * mean:
        return mean, n
    n += 1
    weight = max(LEAST_WEIGHT, 1 / n)
    return (x if mean is None else mean + (x - mean) * weight), n


def vote_step(form: str | None, votes: int, seen: str) -> tuple[str, int]:
    """The same form gains a vote, another costs one, and takes over when none are left."""
    if form == seen:
        return form, min(1000, votes + 1)
    return (seen, 1) if form is None or votes - 1 <= 0 else (form, votes - 1)


def health_step(ok: float, fail: float, success: bool) -> tuple[float, float]:
    """Counts that have passed 200 halve before the next one."""
    ok, fail = (ok / 2, fail / 2) if ok + fail > 200 else (ok, fail)
    return ok + success, fail + (not success)


def health(ok: Column, fail: Column) -> Column:
    return (ok + 2) / (ok + fail + 3)


def ema(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Mean and count after all observations of a key in order: ``key, mean, n``."""
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__x"))))
    grouped = df.where(F.col(value).isNotNull()).groupBy(key).agg(items.alias("__s"))
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, s: Column) -> Column:
        x = s["__x"].cast("double")
        stray = (a.n >= WARM) & ((x < a.mean * LOW) | (x > a.mean * HIGH))
        weight = F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) / (a.n + 1))
        moved = F.when(a.mean.isNull(), x).otherwise(a.mean + (x - a.mean) * weight)
        return F.struct(F.when(stray, a.mean).otherwise(moved).alias("mean"), F.when(stray, a.n).otherwise(a.n + 1).alias("n"))

    return grouped.select(key, F.aggregate("__s", start, step).alias("__r")).select(key, "__r.mean", "__r.n")


def votes(df: DataFrame, key: str, order: list[str], form: str) -> DataFrame:
    """The form that holds a key after all votes in order."""
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(form).alias("__f"))))
    grouped = df.groupBy(key).agg(items.alias("__s"))
    start = F.struct(F.lit(None).cast("string").alias("form"), F.lit(0).cast("long").alias("votes"))

    def step(a: Column, s: Column) -> Column:
        same, out = a.form == s["__f"], a.votes - 1 <= 0
        takes = a.form.isNull() | (~same & out)
        return F.struct(
            F.when(takes, s["__f"]).otherwise(a.form).alias("form"),
            F.when(takes, F.lit(1).cast("long")).when(same, F.least(F.lit(1000).cast("long"), a.votes + 1)).otherwise(a.votes - 1).alias("votes"),
        )

    return grouped.select(key, F.aggregate("__s", start, step).alias("__r")).select(key, "__r.form", "__r.votes")


def decayed_health(df: DataFrame, key: str, order: list[str], success: str) -> DataFrame:
    """Success and failure counts that halve, and the health they give."""
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(success).cast("double").alias("__x"))))
    grouped = df.groupBy(key).agg(items.alias("__s"))
    start = F.struct(F.lit(0.0).alias("ok"), F.lit(0.0).alias("fail"))

    def step(a: Column, s: Column) -> Column:
        cut = F.when(a.ok + a.fail > 200, 2.0).otherwise(1.0)
        return F.struct((a.ok / cut + s["__x"]).alias("ok"), (a.fail / cut + 1 - s["__x"]).alias("fail"))

    out = grouped.select(key, F.aggregate("__s", start, step).alias("__r")).select(key, "__r.ok", "__r.fail")
    return out.withColumn("health", health(F.col("ok"), F.col("fail")))


def calibrated_ratio(a: DataFrame, b: DataFrame, key: str, mean: str = "mean", n: str = "n", least: int = 6, low: float = 0.70, high: float = 1.45) -> DataFrame:
    """Ratio of two sides' means where both have enough samples, kept within bounds; one otherwise."""
    left = a.select(key, F.col(mean).alias("__a"), F.col(n).alias("__na"))
    right = b.select(key, F.col(mean).alias("__b"), F.col(n).alias("__nb"))
    ratio = F.greatest(F.lit(low), F.least(F.lit(high), F.try_divide(F.col("__a"), F.col("__b"))))
    enough = (F.col("__na") >= least) & (F.col("__nb") >= least) & (F.col("__b") != 0)
    return left.join(right, key).select(key, F.when(enough, ratio).otherwise(1.0).alias("ratio"))


def latest_generation(df: DataFrame, key: str, generation: str) -> DataFrame:
    """Results of the newest request of each key alone: what older ones still bring is dropped."""
    newest = df.groupBy(key).agg(F.max(generation).alias("__g"))
    return df.join(newest, key).where(F.col(generation) == F.col("__g")).drop("__g")


def kept_statistics(lines: DataFrame) -> DataFrame:
    """Statistics of a state file's lines (``tag, fields``) that can be believed: ``tag, key, first, second``.

    Paces (N, D) lie between 5 and 600 milliseconds a character and rest on an observation at least; health (H) is any two numbers.
    """
    f = F.col("fields")
    rows = lines.where(F.col("tag").isin("N", "D", "H") & (F.size(f) >= 3)).select("tag", f[0].alias("key"), f[1].try_cast("double").alias("first"), f[2].try_cast("double").alias("second"))
    sane = (F.col("tag") == "H") | ((F.col("first") > 5) & (F.col("first") < 600) & (F.col("second") > 0) & (F.col("second") == F.floor("second")))
    return rows.where(F.col("first").isNotNull() & F.col("second").isNotNull() & sane)


def lru(df: DataFrame, key: str, at: str, keep: int) -> DataFrame:
    """The ``keep`` keys used last: a bounded top-k, ties by key."""
    return df.groupBy(key).agg(F.max(at).alias("last_used")).orderBy(F.col("last_used").desc(), key).limit(keep)


#: What a measurement of speech must hold to count: characters, milliseconds, and milliseconds a character of a service and of a device.
LEAST_CHARS, LEAST_MS, MOST_MS, SLOWEST_SERVICE, SLOWEST_DEVICE = 14, 400, 120_000, 500, 600


def pace(chars: Column, ms: Column, percent: Column) -> Column:
    """Milliseconds a character of a service's clip, as if spoken without the style's speed; null for what must not be learned from."""
    value = F.try_divide(ms, chars) * F.greatest(F.lit(0.5), 1 + percent / 100)
    return F.when((chars >= LEAST_CHARS) & (ms >= LEAST_MS) & value.between(10, SLOWEST_SERVICE), value)


def device_pace(chars: Column, ms: Column, rate: Column) -> Column:
    """The same for a device's voice at a rate."""
    value = F.try_divide(ms, chars) * rate
    return F.when((chars >= LEAST_CHARS) & ms.between(LEAST_MS, MOST_MS) & (rate > 0) & value.between(10, SLOWEST_DEVICE), value)


def blame(df: DataFrame, key: str, order: list[str], rewound: str, candidates: str, least: float = 2.0) -> DataFrame:
    """Blame of each key after all listens in order: ``key, blame, reverts``.

    A rewind adds ``min(1, 3 / candidates)``, a chunk heard to its end takes 0.1 away, never below zero.  A sum held at zero is
    the plain sum less its lowest point so far, so two running windows do it and no key's history is gathered.
    """
    step = F.when(F.col(rewound), F.least(F.lit(1.0), F.lit(3.0) / F.col(candidates))).otherwise(-0.1).cast("decimal(18,6)")
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.withColumn("__s", F.sum(step).over(upto)).groupBy(key).agg(F.min("__s").alias("__low"), F.max_by("__s", F.struct(*order)).alias("__s"))
    left = (F.col("__s") - F.least(F.lit(0).cast("decimal(18,6)"), F.col("__low"))).cast("double")
    return sums.select(key, F.round(left, 6).alias("blame"), (F.round(left, 6) >= least).alias("reverts"))


def listening_step(rewinds: float, heard: float, rewound: bool) -> tuple[float, float]:
    """Each counter halves once past 400, before the new listen counts."""
    rewinds, heard = (c / 2 if c > 400 else c for c in (rewinds, heard))
    return rewinds + rewound, heard + (not rewound)


def listening(df: DataFrame, key: str, order: list[str], rewound: str) -> DataFrame:
    """Decayed counts of rewinds and chunks heard, and the change of pace in per cent that they ask for: ``key, rewinds, heard, percent``."""
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(rewound).alias("__x"))))
    start = F.struct(F.lit(0.0).alias("rewinds"), F.lit(0.0).alias("heard"))

    def step(a: Column, s: Column) -> Column:
        kept = [c / F.when(c > 400, 2.0).otherwise(1.0) for c in (a.rewinds, a.heard)]
        back = s["__x"].cast("double")
        return F.struct((kept[0] + back).alias("rewinds"), (kept[1] + 1 - back).alias("heard"))

    out = df.groupBy(key).agg(items.alias("__s")).select(key, F.aggregate("__s", start, step).alias("__r")).select(key, "__r.rewinds", "__r.heard")
    total = F.col("rewinds") + F.col("heard")
    percent = F.when(total >= 20, -F.floor(F.least(F.lit(8.0), F.col("rewinds") / total * 40) + 0.5)).otherwise(0)
    return out.withColumn("percent", percent.cast("long"))


def behaviour_ratio(df: DataFrame, key: str, bad: str) -> DataFrame:
    """Penalty by share of bad observations once there are twenty."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(bad)).alias("bad"))
    share = F.col("bad") / F.col("n")
    return g.select(key, F.when(F.col("n") >= 20, -F.floor(F.least(F.lit(8.0), share * 40) + 0.5)).otherwise(0).cast("long").alias("penalty"))


def running_flags(df: DataFrame, group: str, order: str, flag: str, out: str) -> DataFrame:
    """Number of the island a row is in: flags so far."""
    return df.withColumn(out, F.sum(F.col(flag).cast("long")).over(Window.partitionBy(group).orderBy(order)))
