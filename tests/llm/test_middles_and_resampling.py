"""Fill-in-the-middle and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import common, fim, resampling

DOCS = "doc_id long, text string"
ODD = [None, "", " ", " \n\t ", "a", " a", "a ", "one  two\nthree ", "é ü x  日本 語\x0b!", "<P> in it", "x <S>", "a < P >b", "word " * 3000, "w" * 5000, " " * 3000 + "end", "A9 b'c Ünï a9", "same same same", "same same same", "\U0001f600 \U0001f600"]


def table(spark, texts):
    return spark.createDataFrame([*enumerate(texts), (None, "an id that is null, with words enough to be cut somewhere")], DOCS)


def h(seed, i, k):
    return int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[8 * k - 8 : 8 * k], 16)


# ---------------------------------------------------------------- fill in the middle


@pytest.mark.parametrize("piece", [8, 1 << 20])
def test_rank_and_select(monkeypatch, piece):
    monkeypatch.setattr(fim, "PIECE", piece)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 700]))) for _ in range(60)]
    data, offsets = common.utf8(pa.array(texts))
    held = fim.Boundaries(data, offsets)
    ends = [m.end() + int(offsets[i]) for i, t in enumerate(texts) for m in re.finditer(r"[ \n]*[^ \n]+|[ \n]+", t)]
    assert held.select(np.arange(1, len(ends) + 1)).tolist() == ends
    places = np.arange(int(offsets[-1]) + 1)
    assert held.rank(places).tolist() == np.searchsorted(ends, places, "right").tolist()
    assert held.words.nbytes <= len(data) / 8 + 64  # a bit a byte


def test_slices_and_wide_offsets():
    for texts in (pa.array(["no", "a b", "", "c"])[1:], pa.array(["no", "a b", "", "c"], pa.large_string())[1:]):
        data, offsets = common.utf8(texts)
        n, first, second = fim.cuts(data, offsets, np.array([1, 0, 0]), np.array([2, 0, 1]))
        assert (n.tolist(), first.tolist(), second.tolist()) == ([2, 0, 1], [1, 0, 0], [3, 0, 1])


def test_outputs_match_brute_force_and_turn_back(spark):
    got = fim.fill_in_middle(table(spark, ODD), rate=100).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in got} == {"plain", "spm", "psm"} and len(got) == len(ODD) + 1
    texts = dict(enumerate(ODD)) | {None: "an id that is null, with words enough to be cut somewhere"}
    for r in got:
        text = texts[r.doc_id] or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        a, b = sorted(h(42, r.doc_id, k) % (len(units) + 1) for k in (1, 2))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        assert r.n == len(units) and r.back == text
        if not text or re.search("<[PSM]>", text):
            assert (r.form, r.output, r.prefix) == ("plain", text, None)
        else:
            assert r.form == ("spm" if h(42, r.doc_id, 4) % 100 < 80 else "psm") and (r.prefix, r.middle, r.suffix) == (p, m, s)
            assert r.output == (f"<S>{s}<P>{p}<M>{m}" if r.form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_middles_of_odd_tables(spark):
    assert fim.fill_in_middle(table(spark, []).where("false")).count() == 0
    clash = table(spark, ["a b c"]).withColumns({c: F.lit(1) for c in ("n", "form", "output", "t", "id", "cut", "h1", "digest")})
    assert fim.fill_in_middle(clash).columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output"]
    assert fim.fill_in_middle(clash, rate=0).where("form != 'plain'").count() == 0


# ---------------------------------------------------------------- resampling


def slow_features(text, n=2):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize(("piece", "size", "steps", "n"), [(1 << 18, 1 << 22, 48, 2), (3, 7, 2, 2), (2, 1, 1, 3), (5, 16, 4, 1)])
def test_features_match_brute_force(monkeypatch, piece, size, steps, n):
    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(resampling, "BYTES", size)
    monkeypatch.setattr(resampling, "STEPS", steps)
    texts = [t or "" for t in ODD if not t or len(t) < 500 or size > 100] + ["ends", "", "starts here", "x" * 60 + " y"]
    data, offsets = common.utf8(pa.array(texts))
    found = [Counter() for _ in texts]
    for _, crc, text in resampling.features(resampling._LOWER[data], offsets, n):
        for c, t in zip(crc.tolist(), text.tolist(), strict=True):
            found[t][c] += 1
    assert found == [Counter(zlib.crc32(f.encode()) for f in slow_features(t, n)[1]) for t in texts]


def test_draw_matches_brute_force(spark):
    rng = random.Random(2)
    common_words, rare = [f"w{i}" for i in range(40)], [f"t{i}" for i in range(20)]
    texts = ODD + [" ".join(rng.choices(common_words + rare * (i % 3), k=rng.randrange(5, 60))) for i in range(150)]
    texts += [texts[30]] * 5
    target = spark.createDataFrame([(0, " ".join(rare * 5)), (1, None), (2, "w1 t1")], "item_id long, text string")
    got = resampling.resample(table(spark, texts).repartition(3), target, buckets=500).collect()
    rows = [*enumerate(texts), (None, "an id that is null, with words enough to be cut somewhere")]
    bucket = lambda f: zlib.crc32(f.encode()) % 500
    s = Counter(bucket(f) for _, t in rows for f in slow_features(t)[1])
    t = Counter(bucket(f) for x in (" ".join(rare * 5), "w1 t1") for f in slow_features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (t.total() * 0 + s.total() + 500) / ((s[b] + 1) * (t.total() + 500))))
    expected = {}
    for i, text in rows:
        n, fs = slow_features(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        expected[i] = (n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h(7, i, 1) + 0.5) / 4294967296))))
    able = sorted((i for i in expected if expected[i][0] >= 20), key=lambda i: (-expected[i][3], -1 if i is None else i))
    rank = {i: k + 1 for k, i in enumerate(able[: 25 * len(able) // 100])}
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got} == {i: (*x[1:], rank.get(i)) for i, x in expected.items()}
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(rank) + 1))
    mean = lambda rs: sum(r.weight for r in rs) / len(rs)
    assert mean([r for r in got if r["rank"]]) > mean([r for r in got if r["rank"] is None and r.doc_id is not None and expected[r.doc_id][0] >= 20])


def test_repeated_rows_have_ranks_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b " * 20)] * 7 + [(2, "c " * 30)], DOCS)
    got = resampling.resample(docs, docs.limit(0), percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 9)) and {r.n_features for r in got} == {79, 59}


def test_resampling_of_odd_tables(spark):
    empty = table(spark, []).where("false")
    assert resampling.resample(empty, empty).count() == 0
    clash = table(spark, ["a b c " * 9]).withColumns({c: F.lit(1) for c in ("id", "rank", "weight", "score", "n_words", "part", "row", "k")})
    assert resampling.resample(clash, clash).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_texts_are_batched_by_bytes(spark):
    """Spark cuts Arrow batches by bytes as well as by rows, so many long texts never meet in one buffer."""
    sizes = spark.range(0, 60, numPartitions=1).select(F.repeat(F.lit("word "), 1_000_000).alias("t"))

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["rows"])

    assert max(r.rows for r in sizes.mapInArrow(seen, "rows long").collect()) <= 14


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_importance_resampling"])
def test_queries_match_their_sql(spark, sf_dir, name):
    import duckdb

    from folioflow.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, expected))
