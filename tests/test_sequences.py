"""Counters of nested lists and mergeable heavy-hitter sketches against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.operators import heavy
from folioflow.operators.numbering import decimal_label, list_counters, pattern_label


def slow(rows):
    counts, out = {}, []
    for doc, pos, level, starts in rows:
        c = counts.setdefault(doc, [None] * 9)
        first = lambda k: starts[k] if starts and k < len(starts) and starts[k] is not None else 1  # noqa: B023, E731
        level = level if level is not None and 0 <= level < 9 else 0
        c[level] = first(level) if c[level] is None else c[level] + 1
        c[level + 1 :] = [None] * (8 - level)
        out.append((doc, pos, [first(k) if x is None else x for k, x in enumerate(c)]))
    return out


def test_counters_match_a_walk(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([*range(9), None, -1, 9]), rng.choice([None, [], [rng.randrange(5) for _ in range(9)], [None, 4]])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc string, pos int, level int, starts array<int>").repartition(4)
    got = list_counters(df, ["doc"], ["pos"], "level", "starts")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
    assert sorted(((r.doc, r.pos, r.counters) for r in got.collect()), key=repr) == sorted(slow(rows), key=repr)
    assert list_counters(df.limit(0), ["doc"], ["pos"], "level", "starts").count() == 0


def test_labels(spark):
    row = spark.createDataFrame([([2, 3, 1, 1, 1, 1, 1, 1, 1], 1, "%1.%2) %9%")], "c array<int>, level int, p string")
    r = row.select(decimal_label(F.col("c"), F.col("level")).alias("a"), pattern_label(F.col("c"), F.col("p")).alias("b")).first()
    assert (r.a, r.b) == ("2.3", "2.3) 1%")


def corpus(seed, n=6000):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice([f"top{rng.randrange(3)}", f"mid{rng.randrange(40)}", f"rare{rng.randrange(3000)}", None])) for _ in range(n)]


@pytest.mark.parametrize(("k", "held", "parts"), [(1, 500_000, 5), (5, 500_000, 1), (20, 30, 7), (5000, 500_000, 3)])
def test_bounds_hold_and_heavy_items_are_held(spark, monkeypatch, k, held, parts):
    monkeypatch.setattr(heavy, "HELD", held)
    rows = corpus(k)
    df = spark.createDataFrame(rows, "c string, i string").repartition(parts)
    true, total = Counter((c, i) for c, i in rows if i is not None), Counter(c for c, i in rows if i is not None)
    got = {(r.context, r["item"]): r for r in heavy.heavy_hitters(df, "c", "i", k).collect()}
    assert all(r.least <= true[key] <= r.most and r.n == total[key[0]] and (r.most - r.least) * (k + 1) <= r.n for key, r in got.items())
    assert {key for key, n in true.items() if n * (k + 1) > total[key[0]]} <= got.keys()
    assert max(Counter(c for c, _ in got).values()) <= k
    want = {(*key, n) for key, n in true.items() if n * (k + 1) > total[key[0]]}
    found = heavy.verified_hitters(df, "c", "i", k).collect()
    assert {(r.context, r["item"], r["count"]) for r in found} == want and all(r.bounded for r in found)


def test_heavy_hitters_of_odd_tables(spark):
    df = spark.createDataFrame([], "c string, i string")
    assert heavy.verified_hitters(df, "c", "i", 3).count() == 0
    one = spark.createDataFrame([(1, 7, "x")], "c int, i int, context string")
    assert [tuple(r) for r in heavy.verified_hitters(one, "c", "i", 3).collect()] == [("1", "7", 1, 1, True)]
