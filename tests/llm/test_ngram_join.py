"""The Jaccard join of n-gram sets against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import ngramjoin

DOCS = "doc_id long, text string"


def grams(text, words=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def slow(rows, words=4, percent=85):
    sets = [grams(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, u in enumerate(sets):
        for j in range(i):
            v = sets[j]
            if u and v and 100 * len(u & v) >= percent * len(u | v):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def fast(spark, rows, **options):
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), **options)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)


def corpus(seed, families=12, copies=9):
    """Families whose members differ by a few words, near the edge of similarity, over words common to all; a passage in every other text."""
    rng, texts = random.Random(seed), []
    passage = " ".join(f"p{i}" for i in range(25))
    for f in range(families):
        base = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.choice([3, 6, 9, 10, 40, 120, 300]))]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25 + (c % 3))):
                text[rng.randrange(len(text))] = f"x{rng.randrange(50)}"
            if c % 4 == 3:
                text = text[: -rng.randrange(1, 3)] or text
            texts.append(" ".join(text) + (f" {passage}" if f % 2 else ""))
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_links_match_brute_force(spark, seed):
    rows = list(enumerate(corpus(seed) + [None, "", "one", "One", "one two", " a b\tc\nd ", "A B C D"], 1))
    expected = slow(rows)
    assert fast(spark, rows) == expected
    assert len({x[2] for x in expected}) < len(rows) - 20  # there are links to be found


def test_other_words_and_similarities(spark):
    rows = list(enumerate(corpus(7, 6)))
    for words, percent in ((1, 60), (3, 100)):
        assert fast(spark, rows, words=words, percent=percent) == slow(rows, words, percent)


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    """With a poor order and small blocks, runs and turns the links are the same."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    monkeypatch.setattr(ngramjoin, "PAIRS", 5)
    monkeypatch.setattr(ngramjoin, "NEAREST", ())
    monkeypatch.setattr(ngramjoin, "rarity", lambda texts, words: np.zeros(ngramjoin.CELLS, np.uint8))
    rows = list(enumerate(corpus(5)))
    assert fast(spark, rows) == slow(rows)


def test_a_hot_family_is_linked_without_all_pairs(spark):
    """Of a family of near copies each member is verified with few others."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        text = list(base)
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    made = []
    real = ngramjoin._links

    def counted(docs, sets, pairs, words, percent):
        made.append(pairs.count())
        return real(docs, sets, pairs, words, percent)

    ngramjoin._links = counted
    try:
        assert {x[2] for x in fast(spark, rows)} == {0}
    finally:
        ngramjoin._links = real
    assert sum(made) < 400 * 12


def test_null_ids_repeated_rows_and_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (None, text), (9, text + " end"), (None, "only null has this text"), (None, None), (3, "")]
    got = fast(spark, rows)
    assert got == sorted([(5, 57, 5), (5, 57, 5), (None, 57, 5), (9, 58, 5), (None, 2, None), (None, 0, None), (3, 0, 3)], key=repr)
    assert fast(spark, rows[:0] or [(1, None)]) == [(1, 0, 1)]
    empty = spark.createDataFrame([], DOCS)
    assert ngramjoin.jaccard_components(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e")], DOCS).withColumns({c: F.lit(1) for c in ("id", "t", "n", "digest", "s", "tok", "label", "known")})
    assert ngramjoin.jaccard_components(clash).columns == ["doc_id", "n_shingles", "component_id"]


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = [str(rng.randrange(10**6)) for _ in range(60_000)]
    other = list(long)
    for k in range(0, 60_000, 120):
        other[k] = "new"
    assert fast(spark, [(1, " ".join(long)), (2, " ".join(other)), (3, "word " * 50_000)]) == [(1, 59_997, 1), (2, 59_997, 1), (3, 1, 3)]


def test_query_matches_its_sql(spark, sf_dir):
    import duckdb

    from folioflow.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = QUERIES["op11_ngram_join"](spark, sf_dir)
    columns = sorted(got.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({ORACLES['op11_ngram_join']})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, expected))
