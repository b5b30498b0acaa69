"""Reading aloud, workbook operators, document sink."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow import sources
from folioflow.operators import speech, workbook
from folioflow.operators import textops as T
from folioflow.sinks import docx

MARKS = st.text(st.sampled_from("بتك" + speech.MARK_ORDER + " ab"), max_size=30)


@given(MARKS)
@settings(deadline=None)
def test_marks_settle(s):
    once = speech.normalised(s)
    assert speech.normalised(once) == once
    bare = lambda x: [c for c in unicodedata.normalize("NFD", x) if c not in speech.MARK_ORDER]
    assert bare(once) == bare(s)


def test_words():
    assert speech.order_marks("\u0643\u064e\u0651") == "\u0643\u0651\u064e" and speech.tanween_before_alef("كتاباً") == "كتابًا"
    assert speech.article("الشمس") == "الشّمس" and speech.article("القمر") == "الْقمر"
    assert speech.pausal("مدرسةٌ") == "مدرسه" and speech.pausal("كتابًا") == "كتابَا" and speech.pausal("كتابٌ") == "كتابْ"
    assert speech.lost_letters("كتب", "كَتَ") == "ب" and speech.lost_letters("كتاب", "كتب") == ""
    assert speech.glyph_text("ﻛﺘﺎﺏ") == "كتاب" and speech.logical_word("باتك") == "كتاب" and speech.logical_word("abc") == "abc" and speech.logical_word("12.5ب") == "ب12.5"
    assert speech.scripts("كتابbook12") == [(0, 4, "ar"), (4, 8, "lat"), (8, 10, "num")] and speech.scripts("سX") == [(0, 1, "lat"), (1, 2, "lat")]


def test_speech_forms():
    cases = {"5kg": "5 kilograms", "3-5cm": "3 to 5 centimetres", "±2%": "plus or minus 2 percent", "[12,13].": "", "a@b.org": "", "https://x.y": "", "α": "alpha", "HTML": "H T M L", "NASA": "NASA", "km/h": "km per h", "and/or": "and or or", "e.g.": "for example", "word": "word"}
    assert {k: speech.speech_form(k) for k in cases} == cases


@given(st.text(st.sampled_from("abc .,!é "), max_size=400))
@settings(deadline=None)
def test_pieces_keep_the_words(s):
    parts = speech.halved(s, 40)
    assert "".join("".join(parts).split()) == "".join(s.split()) and all(len(p.encode()) <= 40 for p in parts)


@given(st.text(st.sampled_from("abAB12 .,-ب"), max_size=60))
@settings(deadline=None, max_examples=20)
def test_bidi_strip_undoes_wrap(s):
    import re

    wrapped = re.sub(r"([A-Za-z0-9][A-Za-z0-9 .,:/@_-]*[A-Za-z0-9]|[A-Za-z0-9])", T.RLM + T.LRM + r"\1" + T.LRM + T.RLM, s)
    assert wrapped.replace(T.RLM, "").replace(T.LRM, "") == s


def test_columns(spark):
    t = spark.createDataFrame([(1, "hello  12\tكتاب جديد 7 end")], "doc_id int, s string")
    tokens = t.select("doc_id", F.inline(speech.with_offsets(F.col("s"))))
    assert [(r.token, r.start) for r in tokens.collect()] == [("hello", 0), ("12", 7), ("كتاب", 10), ("جديد", 15), ("7", 20), ("end", 22)]
    runs = speech.language_runs(tokens.select("doc_id", F.col("start").alias("pos"), F.col("token").alias("word"))).orderBy("first")
    assert [(r.lang, r.first, r.n) for r in runs.collect()] == [("en", 0, 2), ("ar", 10, 3), ("en", 22, 1)]
    assert t.select(speech.applied("speech", F.lit("5kg")).alias("x"), speech.foreign_letters(F.lit("پک")).alias("y")).first() == ("5 kilograms", "بك")
    marks = spark.createDataFrame([(0, 0.0, 10.0, 3), (0, 10.0, 5.0, 2), (1, 0.0, 4.0, 6), (2, 1.0, 1.0, 1)], "part int, at_ms double, ms double, chars int")
    assert [(r.part, r.at_ms, r.char_shift) for r in speech.joined_timeline(marks).orderBy("at_ms").collect()] == [(0, 0.0, 0), (0, 10.0, 0), (1, 15.0, 5), (2, 20.0, 11)]
    lines = spark.createDataFrame([("GIF=>jif",), ("a=b",), ("none",), ("=x",)], "line string")
    assert [tuple(r) for r in speech.lexicon(lines).collect()] == [("gif", "jif"), ("a", "b")]
    assert speech.changed_lines(spark.createDataFrame([("A", " a"), ("a", "b")], "source string, translation string")).count() == 1
    assert [r.p for r in t.select(F.explode(speech.speech_pieces(F.lit("one two. three four"), 10)).alias("p")).collect()] == ["one two.", "three four"]


def test_workbook_operators(spark):
    schema = "path string, sheet_idx int, sheet string, r int, c int, f string, t string, n double, s string, b boolean, e string, style int, shown string, shared_row int, shared_col int"
    cells = spark.createDataFrame(
        [("p", 0, "S", 1, 1, None, "n", 2.0, None, None, None, 0, None, None, None), ("p", 0, "S", 1, 2, "A1*$A$1", "n", 4.0, None, None, None, 0, None, None, None), ("p", 0, "S", 2, 2, None, "n", 0.0, None, None, None, 0, None, 1, 2), ("p", 0, "S", 3, 4, None, "s", None, "x", None, None, 0, None, None, None)], schema,
    )
    assert {(r.r, r.c): r.f for r in workbook.expand_shared(cells).collect()} == {(1, 1): None, (1, 2): "A1*$A$1", (2, 2): "A2*$A$1", (3, 4): None}
    moved = {(r.r, r.c): r.f for r in workbook.restructured(cells, "s", "row", 1, 2).collect()}
    assert moved == {(3, 1): None, (3, 2): "A3*$A$3", (4, 2): None, (5, 4): None}
    assert workbook.restructured(cells, "S", "col", 2, -1).count() == 2
    assert {r.r: r.fields for r in workbook.row_table(cells).collect()}[3] == ["", "", "", "x"]
    assert workbook.viewer_caps(cells, rows=2).count() == 3 and tuple(workbook.used_range(cells).first())[2:] == (3, 4, 4)
    shown = workbook.shown_values(spark.createDataFrame([(45352.0, "yyyy-mm-dd"), (None, "0")], "v double, k string"), "v", "k")
    assert [r.shown for r in shown.collect()] == ["2024-03-01", None]


def test_documents_round_trip(spark, tmp_path):
    run = "struct<text:string,bold:boolean,italic:boolean,link:string>"
    schema = f"path string, pos int, type string, level int, label string, text string, runs array<{run}>, rows array<array<struct<text:string,colspan:int,rowspan:int>>>"
    data = [
        ("d", 0, "HEADING", 2, None, "Head <1>", [("Head <1>", False, False, None)], []), ("d", 1, "PARAGRAPH", None, None, "a\tb\nc link", [("a\tb\nc ", True, False, None), ("link", False, True, "http://x.org/?a=1&b=2")], []),
        ("d", 2, "LIST_ITEM", 0, "1.", "item", [("item", False, False, None)], []), ("d", 3, "TABLE", None, None, "", [], [[("wide", 2, 1), ("tall", 1, 2)], [("x\ny", 1, 1), ("z", 1, 1)]]),
    ]
    blocks = spark.createDataFrame(data, schema)
    for r in docx.packages(blocks).collect():
        (tmp_path / "d.docx").write_bytes(r.content)
    got = sources.blocks(spark, str(tmp_path)).drop("path").orderBy("pos").collect()
    assert got == blocks.drop("path").orderBy("pos").collect()
