"""The pipeline's stages against what each operator decides."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import decontam, quality, simhash, surrogates


def slow_shingles(text):
    """Sets of 5-word shingles, by hand."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text_hash", F.lit("extra"))
    columns, kept = docs.columns, docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept.cache()
        kept = stage(spark, before, sf_dir).cache()
        out[name] = (before, kept)
        if name != "packing":
            assert kept.columns == columns
    ids = {name: ({r.doc_id for r in a.select("doc_id").collect()}, {r.doc_id for r in b.select("doc_id").collect()}) for name, (a, b) in out.items()}

    before, after = out["quality"]
    model = quality.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in before.collect()}
    assert ids["quality"][1] == {i for i, t in texts.items() if quality.predict(model, [t])[0] >= 0.3}

    before, after = out["near_dedup"]
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in before.collect()}
    sets = {r.doc_id: slow_shingles(r.text) for r in before.collect()}
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            near = (prints[a] ^ prints[b]).bit_count() <= 3
            if a < b and (near or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert ids["near_dedup"][1] == {root(i) for i in prints}

    before, after = out["decontamination"]
    bench = [(r.item_id, " ".join(decontam.tokenize(r.text))) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {r.doc_id for r in before.collect() if any(t in " ".join(decontam.tokenize(r.text)) for _, t in bench)}
    assert held <= ids["decontamination"][0] - ids["decontamination"][1]

    before, after = out["pii"]
    assert ids["pii"][0] == ids["pii"][1]
    was = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text)
        found = surrogates.find(was[r.doc_id])
        assert all(v not in r.text for _, _, _, v in found)
        if not found:
            assert r.text == was[r.doc_id]
        assert not re.search(r"@mail\d\.example\.com", r.text)
    assert ids["packing"][0] == ids["packing"][1]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.select("doc_id").distinct().count() == out.count()


def test_stages_keep_their_word_on_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", None, None, 0), (2, "a few words of text here.", "en", "s", 25)], schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, sf_dir).count()
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.near_dedup(spark, odd, sf_dir).count() == 3


def test_rows_that_share_an_id_are_told_apart(spark, sf_dir):
    schema = "doc_id long, text string"
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a), (3, b)], schema)
    assert sorted(corpus_pipeline.near_dedup(spark, rows, sf_dir).collect()) == [(1, a), (1, b)]


def test_stages_are_written_as_parquet(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", lambda s, d, f: d.limit(3)), ("b", lambda s, d, f: seen.append(d) or d)])
    assert corpus_pipeline.run(spark, sf_dir).count() == 3
    assert all(f.endswith(".parquet") and "/documents.parquet" not in f for f in seen[0].inputFiles()) and seen[0].inputFiles()


def test_near_dedup_by_similarity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gone = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir, None).join(corpus_pipeline.near_dedup(spark, docs, sf_dir), "doc_id", "left_anti").collect()}
    assert {145, 177} <= gone


def test_columns_with_names_of_ours_stay(spark, sf_dir):
    schema = "doc_id long, text string, n_chars long, pii_kinds string, kept string, id string, digest string, label string, quality_score string, benchmark_matches string, kinds string, __replaced string, __kept string, text_digest string, kept_id string"
    mine = ["mine"] * 12
    rows = spark.createDataFrame([(1, "Write to joe@corp.com about it, as was said here before by all of us.", 1, *mine), (2, "Another text that has nothing to do with the first one, of course.", 1, *mine)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns, name
        assert all(list(r)[3:] == mine for r in out.collect()), name
    assert corpus_pipeline.packing_plan(spark, rows, sf_dir).count() == 2


def test_large_bands_are_compared_in_full(spark, monkeypatch):
    """Pairs of copies amid others that share their bands and are not similar: no pair is lost, even if the turns link nothing."""
    import random

    from folioflow.llm import simhash

    draw = random.Random(3)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(60):
        own = list(base)
        for k in draw.sample(range(5, 145), 3):
            own[k] = f"x{i}_{k}"
        again = list(own)
        for k in (2, 147):
            again[k] = f"y{i}_{k}"
        texts += [" ".join(own), " ".join(again)]
    monkeypatch.setattr(simhash, "BAND_PAIRS", 1)
    monkeypatch.setattr(simhash, "_verified", lambda *given: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(simhash, "BLOCK", 16, raising=False)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = {r.id: r.label for r in simhash.labelled(rows, similarity=0.8).collect()}
    assert sum(label[i] == label[i + 1] for i in range(0, 120, 2)) == 60
    assert len(set(label.values())) > 20


def test_components_of_few_edges(spark):
    """In one task, the labels of the large way."""
    import random

    from folioflow.llm.components import components

    draw = random.Random(1)
    edges = [(draw.randrange(-400, 400), draw.randrange(-400, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(components(df, few=1000).collect()) == sorted(components(df).collect())
    assert components(df.limit(0), few=1000).count() == 0


def test_shuffle_files_go_with_their_step(spark, sf_dir):
    """The setting holds while it lasts, and the session is as it was after."""
    from folioflow.llm.common import files_removed

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with files_removed(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
