"""Queries on keys and sizes beyond the smallest tables."""

import base64

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow.operators import colour, infer, speech
from folioflow.plans.inspect import plan_text
from folioflow.queries import ORACLES, QUERIES
from folioflow.sources import office


def compared(spark, tmp_path, name, table, rows):
    """Sorted rows of a query over one small table, and those of its SQL."""
    import duckdb

    rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    return sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*names).collect())), sorted(found.fetchall())


def test_tint_rounds_as_its_sql(spark, tmp_path):
    parts = spark.range(2000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    got, want = compared(spark, tmp_path, "cf_tint", "part", parts)
    assert got == want


def test_tint_stays_a_small_expression(spark):
    """Steps that use the one before several times are not written out at each use."""
    df = spark.createDataFrame([("336699", 0.4)], "c string, t double")
    assert len(df.select(colour.tinted(F.col("c"), F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()) < 50_000
    assert df.select(colour.tinted(F.col("c"), F.col("t"))).first()[0] == "#75A3D1"


def test_column_names_of_any_length(spark, tmp_path):
    numbers = [0, 1, 26, 27, 702, 703, 16384, 18278, 18279, 475254, 475255, 1200000]
    names = ["@", "A", "Z", "AA", "ZZ", "AAA", "XFD", "ZZZ", "AAAA", "ZZZZ", "AAAAA", "BPGCV"]
    t = spark.createDataFrame([(n,) for n in numbers], "p_partkey long")
    rows = t.select(infer.column_name(F.col("p_partkey")).alias("name"), infer.column_index(infer.column_name(F.col("p_partkey"))).alias("c")).collect()
    assert [r.name for r in rows] == names and [r.c for r in rows] == numbers
    got, want = compared(spark, tmp_path, "in_a1", "part", t)
    assert got == want


def test_packages_are_made_and_read_by_many_tasks(spark, sf_dir):
    """A table that one task reads is dealt out before its rows become files."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("wb_rtf_runs", "wb_docx_runs", "wb_pptx_placed", "wb_pptx_tables"):
        assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == n > 1, name


def test_language_runs_take_time_by_length(spark, sf_dir, tmp_path):
    """No window looks from each word to the end of its text, and texts are dealt over all tasks before they become words."""
    plan = plan_text(QUERIES["sp_language_runs_documents"](spark, sf_dir))
    assert "currentrow$(), unboundedfollowing$()" not in plan
    assert plan.count("Exchange ") == 1 and plan.index("Exchange ") > plan.index("Generate ")
    long = " ".join("1" if i % 3 else "word" for i in range(30_000))
    texts = [None, "", " \t\n", "7", "1 2 3 4 5 6 7 8 9 10 11", "1 2 3 4 5 6 7 8 9 ten 11 12", "one", "- one two 3 four five six seven eight", long, "9 " * 25 + long, "alif bā 7 é"]
    rows = [*enumerate(texts), (6, texts[6]), (7, texts[7])]  # copies of whole rows
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = compared(spark, tmp_path, "sp_language_runs_documents", "documents", docs)
    assert got == want and len({r[0] for r in got}) == 8


def test_language_runs_over_tokens_in_any_order(spark):
    """Positions need not follow each other, and texts may begin or consist of tokens of no language."""
    rows = [(1, 40, "b"), (1, 0, "7"), (1, 10, "8"), (1, 30, "كتاب"), (1, 55, "9"), (2, 5, "1"), (2, 9, None), (3, 2, "ب")]
    runs = speech.language_runs(spark.createDataFrame(rows, "doc int, at int, w string"), "doc", "at", "w")
    assert sorted(map(tuple, runs.collect())) == [(1, 0, "ar", 0, 3), (1, 1, "en", 40, 2), (2, 0, "en", 5, 2), (3, 0, "ar", 2, 1)]
    assert runs.dtypes == [("doc", "int"), ("run", "bigint"), ("lang", "string"), ("first", "int"), ("n", "bigint")]


@pytest.mark.parametrize("broken", ["true", "false"])
def test_data_uris_are_one_line(spark, broken):
    key = "spark.sql.legacy.chunkBase64String.enabled"
    spark.conf.set(key, broken)
    try:
        got = spark.createDataFrame([(b"GIF89a" + bytes(range(200)),), (b"none",), (None,)], "b binary").select(infer.data_uri(F.col("b")).alias("u")).collect()
    finally:
        spark.conf.unset(key)
    assert got[0].u == "data:image/gif;base64," + base64.b64encode(b"GIF89a" + bytes(range(200))).decode() and got[1].u is None and got[2].u is None


def test_small_files_share_a_frame():
    """A frame for each file took ten times as long as reading the files; rows of many files are handed on together, within bounds."""

    def parse(content):
        if content == b"bad":
            yield 0, "before the fault"
            raise ValueError
        for i in range(len(content)):
            yield i, "x"

    files = [b"ab", b"", b"bad", b"abc"] * 300
    frames = [pd.DataFrame({"path": [str(i) for i in range(len(part))], "content": part}) for part in (files[:700], files[700:])]
    out = list(office._gathered(parse, ["path", "i", "t"], 500, 1 << 20)(iter(frames)))
    assert [len(f) for f in out] == [500, 500, 500, 300]
    want = [(str(i), *row) for frame in frames for i, c in enumerate(frame["content"]) for row in ([(0, "before the fault")] if c == b"bad" else [(k, "x") for k in range(len(c))])]
    assert [tuple(r) for f in out for r in f.itertuples(index=False)] == want
    assert len(list(office._gathered(parse, ["path", "i", "t"], 500, 2)(iter(frames)))) == 900  # bytes bound a frame too


def test_packages_are_made_a_few_at_a_time(spark, sf_dir):
    """Packages are handed on in small frames, so what a task's Python holds does not follow the rows of a batch."""
    import inspect

    from folioflow.queries import tables

    files = tables._zipped(tables._files(spark, sf_dir), lambda *row: {"a": "b"})
    assert "MapInPandas" in plan_text(files) and "ArrowEvalPython" not in plan_text(files) and "500" in inspect.getsource(tables._zipped)
    assert files.count() == files.select("path").distinct().count() and files.where("content is null").count() == 0


def test_pages_of_chunks_share_batches(spark):
    """Chunks of a page are joined as they pass: across batches, with no group a page."""
    from folioflow.operators.layout import merge_chunks, merged_chunks

    rows, want = [], []
    for page in [None, *range(300)]:
        n = 0 if page is None else page
        at, chunks = 0, []
        for k in range(1 + (400 if page == 7 else n % 9)):
            size = 20 + (n * 31 + k * 57) % 280
            chunks.append((at, at + size, "ar" if (n + k) % 4 == 0 else "en"))
            at += size
        rows += [(page, *c) for c in chunks]
        want += [(page, *c) for c in merged_chunks(chunks)]
    df = spark.createDataFrame(rows[::-1], "page long, start long, end long, lang string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = merge_chunks(df)
        got = list(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert "FlatMapGroupsInPandas" not in plan_text(found) and merge_chunks(df.limit(0)).count() == 0


def test_results_of_texts_are_held_a_few_at_a_time(spark):
    """Tokens of a whole batch of texts took gigabytes; results leave a bounded number of characters at a time, each with its row."""
    held = pd.Series(["abc", None, "", "de", "x" * 20, "f", "gh"])
    assert [list(x) for x in speech._slices(held, 5)] == [["abc", None, "", "de"], ["x" * 20], ["f", "gh"]]
    assert [list(x) for x in speech._slices(held.iloc[:0], 5)] == [[]]
    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else f"word{i} " * (200_000 if i == 40 else i * 3) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    got = df.select("id", F.size(speech.with_offsets(F.col("t"))).alias("n"), F.size(F.coalesce(speech.speech_pieces(F.col("t")), F.array())).alias("p")).collect()
    assert {r.id: r.n for r in got} == {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert {r.id: r.p for r in got} == {i: len(speech.halved(t or "")) for i, t in enumerate(texts)}


def test_words_of_pages_move_as_texts(spark, sf_dir):
    """Texts are dealt before they become words, and words of a page are placed once."""
    plan = plan_text(QUERIES["ly_page_text_documents"](spark, sf_dir))
    assert plan.count("Exchange ") == 1 and plan.count("Generate ") == 1 and plan.index("Exchange ") > plan.index("Generate ") and "Join" not in plan
    plan = plan_text(QUERIES["ly_word_at_documents"](spark, sf_dir))
    assert plan.count("Exchange ") + plan.count("ReusedExchange ") <= 2 and "Join" not in plan and plan.index("Union") < plan.index("Exchange ")  # of texts and of keys; none of words


def test_word_at_offsets_of_any_page(spark):
    """Offsets before the first word, between words, far behind the last, twice, on pages without words and on none."""
    from folioflow.operators.layout import word_at

    placed = spark.createDataFrame([(1, 2, 4, "ab"), (1, 6, 9, "cde"), (1, 900, 901, "f"), (None, 0, 1, "z")], "page int, start int, end int, text string")
    asked = [(1, 0), (1, 2), (1, 5), (1, 6), (1, 6), (1, 899), (1, 900), (1, 10**6), (2, 0), (None, 3), (1, None)]
    got = word_at(placed, spark.createDataFrame(asked, "page int, offset int")).collect()
    want = [None, ("ab", 2, 4), ("ab", 2, 4), ("cde", 6, 9), ("cde", 6, 9), ("cde", 6, 9), ("f", 900, 901), ("f", 900, 901), None, None, None]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((*a, *(w or (None,) * 3)) for a, w in zip(asked, want, strict=True)), key=repr)


def test_closure_sends_no_parents_through_the_driver(spark, sf_dir, monkeypatch):
    """Levels are joined where they lie: no parents are broadcast, and a level is made once."""
    from folioflow.operators import lookup

    plans, real = [], lookup.pinned
    monkeypatch.setattr(lookup, "pinned", lambda df: plans.append(plan_text(df)) or real(df))
    rows = [(i, i // 2 if i > 1 else None) for i in range(1, 300)] + [(1000, 1001), (1001, 1000)]
    got = sorted(map(tuple, lookup.closure(spark.createDataFrame(rows, "s long, p long"), "s", "p").collect()))
    want = [(i, i >> d, d) for i in range(1, 300) for d in range(i.bit_length())] + [(1000, 1000, 0), (1000, 1001, 1), (1001, 1001, 0), (1001, 1000, 1)]
    assert got == sorted(want)
    assert sum("SortMergeJoin" in p for p in plans) == 9 and not any("Broadcast" in p for p in plans)


def test_words_are_counted_in_large_tables(monkeypatch):
    """Small Arrow batches are counted together, so an item is added to its sketch once a table and not once a batch."""
    import pyarrow as pa

    from folioflow.operators import heavy

    added, real = [], heavy.Sketch.add
    monkeypatch.setattr(heavy.Sketch, "add", lambda self, items, *x: added.append(len(items)) or real(self, items, *x))
    batches = [pa.RecordBatch.from_pydict({"context": [None, "a", "b", "a"], "item": ["x", "x", "y", str(i % 3)]}) for i in range(300)]
    out = [r for b in heavy._sketched(10)(iter(batches)) for r in b.to_pylist()]
    assert added == [4, 1, 1] or sorted(added) == [1, 1, 4]
    assert {r["context"]: dict(zip(r["items"], r["counts"], strict=True)) for r in out} == {None: {"x": 300}, "a": {"x": 300, "0": 100, "1": 100, "2": 100}, "b": {"y": 300}}
    monkeypatch.setattr(heavy, "ROWS", 8)
    assert [t.num_rows for t in heavy._tables(iter(batches[:5]))] == [8, 8, 4]


def test_offsets_take_time_by_length(spark, sf_dir, tmp_path):
    """A token is looked up in a block of its text and not from the first letter on, which took the square of a text's length; texts are dealt over all tasks."""
    plan = plan_text(QUERIES["sp_offsets"](spark, sf_dir))
    assert "substring(text" not in plan and plan.count("ArrowEvalPython ") == 1 and "regexp_extract_all" in plan[plan.index("Generate ") :] and "regexp_extract_all" not in plan[: plan.index("Generate ")]
    assert plan.index("RoundRobinPartitioning") > plan.index("ArrowEvalPython ")
    long = "".join(f"{'é' * (i % 7)}w{i} \u20ac\U0001f600\n" for i in range(40_000))
    texts = [None, "", " \t\n", "a", " a", "a ", long, "x" * 255, "x" * 256, "x" * 257 + "\t" + "é" * 700 + "\r\U0001f600" * 300, " " * 255 + "ab", long[::-1], "z"]
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7])], "doc_id long, text string")
    got, want = compared(spark, tmp_path, "sp_offsets", "documents", docs)
    assert got == want and len(got) == 10


def test_tokens_lie_where_they_are_said_to(spark):
    blanks = " \t\n\x0b\x1c\x85\u00a0\u1680\u2003\u2007\u2028\u202f\u3000"
    texts = [None, "", blanks, "a", *(f"{x}é\U0001f600{x}{x}b\u200b" for x in blanks), "no blank", "\x00 \ufeff"]
    rows = speech._tokens(texts).to_pylist()
    assert [[(r["token"], r["start"]) for r in x] for x in rows] == [[(m[0], m.start()) for m in speech._TOKEN.finditer(x or "")] for x in texts]
    assert speech._tokens([]).to_pylist() == [] and speech._tokens([None]).to_pylist() == [[]]
    df = spark.createDataFrame([("é\n\U0001f600" * 300,)], "t string")
    asked = [(0, 1), (254, 5), (255, 1), (256, 600), (899, 1), (890, 50), (900, 1), (5000, 3)]
    got = df.select(*(speech.text_at(speech.text_blocks(F.col("t")), F.lit(a), F.lit(n)).alias(f"x{i}") for i, (a, n) in enumerate(asked))).first()
    assert list(got) == [("é\n\U0001f600" * 300)[a : a + n] for a, n in asked]
