"""Files written here and read back."""

import io
import zipfile

from folioflow import sources
from folioflow.operators import layout
from folioflow.sinks import html, xlsx
from folioflow.sources.plain import csv_rows, speech_marks, state_lines, toggled_fields

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def rels(*items):
    return "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f"<Relationship Id='{i}' Type='{R}/{k}' Target='{t}' {m}/>" for i, k, t, m in items) + "</Relationships>"


def test_workbook_round_trip(spark, tmp_path):
    schema = "workbook_id long, sheet string, r int, c int, f string, t string, n double, s string, b boolean, e string, format string"
    rows = [
        (1, "One/Two", 1, 1, None, "s", None, "héllo & <b>", None, None, None), (1, "One/Two", 1, 3, None, "n", 45352.0, None, None, None, "yyyy-mm-dd"), (1, "One/Two", 3, 1, "=C1*2", "n", 90704.0, None, None, None, None),
        (1, "one_two", 2, 2, None, "b", None, None, True, None, None), (1, "one_two", 2, 28, None, "e", None, None, None, "#N/A", None), (2, "S", 1, 1, None, "s", None, "héllo & <b>", None, None, None),
    ]
    for r in xlsx.packages(spark.createDataFrame(rows, schema)).collect():
        (tmp_path / f"{r.workbook_id}.xlsx").write_bytes(r.content)
    got = {(r.path[-6:], r.sheet, r.r, r.c): r for r in sources.cells(spark, str(tmp_path), display=True).collect()}
    assert set(got) == {("1.xlsx", "One_Two", 1, 1), ("1.xlsx", "One_Two", 1, 3), ("1.xlsx", "One_Two", 3, 1), ("1.xlsx", "one_two(2)", 2, 2), ("1.xlsx", "one_two(2)", 2, 28), ("2.xlsx", "S", 1, 1)}
    assert got["1.xlsx", "One_Two", 1, 1].s == "héllo & <b>" and got["1.xlsx", "One_Two", 1, 3].shown == "2024-03-01" and got["1.xlsx", "One_Two", 3, 1].f == "C1*2"
    assert got["1.xlsx", "one_two(2)", 2, 2].b is True and got["1.xlsx", "one_two(2)", 2, 28].e == "#N/A"
    kinds = {(r.id, r.kind) for r in sources.relationships(spark, str(tmp_path), "2.xlsx").collect()}
    assert ("rId1", "officeDocument") in kinds and ("rId2", "sharedStrings") in kinds
    assert sources.parts(spark, str(tmp_path), "2.xlsx").count() == 7


def test_odd_workbook(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = (
        f"<worksheet xmlns='{main}'><sheetData><row><c t='s'><v>0</v></c><c t='inlineStr'><is><r><t>in</t></r><r><t>line</t></r></is></c></row><row r='5'><c r='B5'><f t='shared' si='0'>A1</f><v>3</v></c>"
        "<c><f t='shared' si='0'/><v>4</v></c><c t='s'><v>99</v></c><c s='0'/></row></sheetData><mergeCells><mergeCell ref='A1:B2'/></mergeCells></worksheet>"
    )
    parts = {
        "_rels/.rels": rels(("a", "officeDocument", "xl/workbook.xml", "")),
        "xl/workbook.xml": f"<workbook xmlns='{main}' xmlns:r='{R}'><sheets><sheet name='Hid' state='hidden' r:id='r2'/><sheet name='Vis' r:id='r1'/><sheet name='Chart' r:id='r4'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/a.xml", ""), ("r2", "worksheet", "/xl/worksheets/b.xml", ""), ("r3", "sharedStrings", "SHARED.xml", ""), ("r4", "chartsheet", "c.xml", "")),
        "xl/shared.xml": f"<sst xmlns='{main}'><si><r><t>a</t></r><r><t>b</t></r><rPh><t>phonetic</t></rPh></si></sst>",
        "xl/worksheets/a.xml": sheet,
        "xl/worksheets/b.xml": sheet,
    }
    (tmp_path / "odd.xlsx").write_bytes(package(parts))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    got = sources.cells(spark, str(tmp_path), hidden=False).orderBy("r", "c").collect()
    assert [(r.sheet, r.r, r.c, r.s or r.n, r.f, r.shared_row) for r in got] == [("Vis", 1, 1, "ab", None, None), ("Vis", 1, 2, "inline", None, None), ("Vis", 5, 2, 3.0, "A1", None), ("Vis", 5, 3, 4.0, None, 5)]
    assert [(m.sheet, m.r1, m.r2, m.c1, m.c2) for m in sources.merges(spark, str(tmp_path)).orderBy("sheet").collect()] == [("Hid", 1, 2, 1, 2), ("Vis", 1, 2, 1, 2)]


def test_docx_blocks(spark, tmp_path):
    def p(text, properties=""):
        return f"<w:p><w:pPr>{properties}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"

    item = "<w:numPr><w:ilvl w:val='{}'/><w:numId w:val='1'/></w:numPr>"
    body = (
        p("Top", "<w:pStyle w:val='H1b'/>") + p("") + p("one", item.format(0)) + p("deep", item.format(1)) + p("two", item.format(0)) + p("deep again", item.format(1))
        + f"<w:p><w:ins><w:r><w:t>kept</w:t></w:r></w:ins><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r><w:hyperlink r:id='l1'><w:r><w:rPr><w:b/></w:rPr><w:t>link</w:t></w:r></w:hyperlink><w:r><w:tab/><w:br/><w:footnoteReference w:id='4'/></w:r></w:p>"
        + "<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>" + p("wide") + "</w:tc><w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr>" + p("tall") + "</w:tc></w:tr><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr>" + p("") + "</w:tc></w:tr></w:tbl>"
    )
    level = "<w:lvl w:ilvl='{0}'><w:start w:val='1'/><w:numFmt w:val='{1}'/><w:lvlText w:val='{2}'/></w:lvl>"
    parts = {
        "_rels/.rels": rels(("a", "officeDocument", "word/document.xml", "")),
        "word/document.xml": f"<w:document xmlns:w='{W}' xmlns:r='{R}'><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": rels(("s", "styles", "styles.xml", ""), ("n", "numbering", "numbering.xml", ""), ("f", "footnotes", "footnotes.xml", ""), ("l1", "hyperlink", "http://x.org/", "TargetMode='External'")),
        "word/styles.xml": f"<w:styles xmlns:w='{W}'><w:style w:styleId='H1'><w:name w:val='heading 1'/></w:style><w:style w:styleId='H1b'><w:name w:val='mine'/><w:basedOn w:val='H1'/></w:style></w:styles>",
        "word/numbering.xml": f"<w:numbering xmlns:w='{W}'><w:abstractNum w:abstractNumId='0'>" + level.format(0, "decimal", "%1.") + level.format(1, "lowerLetter", "%1%2)") + "</w:abstractNum><w:num w:numId='1'><w:abstractNumId w:val='0'/></w:num></w:numbering>",
        "word/footnotes.xml": f"<w:footnotes xmlns:w='{W}'><w:footnote w:id='0' w:type='separator'><w:p/></w:footnote><w:footnote w:id='4'>{p('a note')}</w:footnote></w:footnotes>",
    }
    (tmp_path / "a.docx").write_bytes(package(parts))
    got = sources.blocks(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(b.type, b.level, b.label, b.text) for b in got[:5]] == [("HEADING", 1, None, "Top"), ("LIST_ITEM", 0, "1.", "one"), ("LIST_ITEM", 1, "1a)", "deep"), ("LIST_ITEM", 0, "2.", "two"), ("LIST_ITEM", 1, "2a)", "deep again")]
    assert got[5].text == "keptlink\t\n[1]" and got[5].runs[1].bold and got[5].runs[1].link == "http://x.org/"
    assert [[tuple(c) for c in row] for row in got[6].rows] == [[("wide", 2, 1), ("tall", 1, 2)], [("a", 1, 1), ("b", 1, 1)]]
    assert (got[7].type, got[7].label, got[7].text) == ("NOTE", "[1]", "a note")


def test_pptx_order_and_titles(spark, tmp_path):
    def slide(*shapes):
        return f"<p:sld xmlns:p='{P}' xmlns:a='{A}'><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"

    def shape(text, kind=None):
        place = f"<p:ph type='{kind}'/>" if kind else ""
        return f"<p:sp><p:nvSpPr><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"

    parts = {
        "_rels/.rels": rels(("a", "officeDocument", "ppt/presentation.xml", "")),
        "ppt/presentation.xml": f"<p:presentation xmlns:p='{P}' xmlns:r='{R}'><p:sldIdLst><p:sldId r:id='b'/><p:sldId r:id='a'/></p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": rels(("a", "slide", "slides/slide1.xml", ""), ("b", "slide", "slides/slide2.xml", "")),
        "ppt/slides/slide1.xml": slide(shape("last", "title"), f"<p:grpSp>{shape('grouped')}</p:grpSp>"),
        "ppt/slides/slide2.xml": slide(shape("first", "ctrTitle"), shape("body")),
    }
    (tmp_path / "a.pptx").write_bytes(package(parts))
    got = [(r.slide, r.pos, r.type, r.text) for r in sources.slides(spark, str(tmp_path)).orderBy("slide", "pos").collect()]
    assert got == [(1, 0, "TITLE", "first"), (1, 1, "BODY", "body"), (2, 0, "TITLE", "last"), (2, 1, "BODY", "grouped")]


def test_rtf(spark, tmp_path):
    body = rb"{\rtf1\ansi\ansicpg1256{\fonttbl{\f0 A;}}{\*\generator x\par}Hello \b bold\b0\line next\par caf\u233?\~x \'c7\par\trowd a\cell b\cell\row{\field{\*\fldinst HYPERLINK \"u\"}{\fldrslt link}}\par}"
    (tmp_path / "a.rtf").write_bytes(body)
    got = [(r.type, r.text) for r in sources.rtf_paragraphs(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [("PARAGRAPH", "Hello bold\nnext"), ("PARAGRAPH", "café x ا"), ("ROW", "a\tb"), ("PARAGRAPH", "link")]


def test_plain_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo\r\n\r\n\r\n  three \rfour\n\n\n".encode())
    assert [(r.pos, r.text) for r in sources.text_paragraphs(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, "one\ntwo"), (1, "three \nfour")]
    (tmp_path / "a.csv").write_text('a,"b,c",d""e,\n"x ""y""",,z\n')
    assert [r.fields for r in csv_rows(spark, str(tmp_path)).collect()] == [["a", "b,c", 'd""e', ""], ['x "y"', "", "z"]]
    assert [r.fields for r in csv_rows(spark, str(tmp_path), strict=True).collect()] == [["a", "b,c", "de", ""], ["x y", "", "z"]]
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    assert [(r.mime, r.uri) for r in sources.image_files(spark, str(tmp_path)).collect()] == [("image/png", "data:image/png;base64,iVBORw0KGgo=")]
    (tmp_path / "a.json").write_text('﻿{"a": [1, 2]}')
    assert str(sources.json_values(spark, str(tmp_path)).first().value) == '{"a":[1,2]}'
    (tmp_path / "state").write_text("T\ta\tb\nbad line\nV\tc\t1\n")
    assert [(r.tag, r.fields) for r in state_lines(spark, str(tmp_path / "state")).collect()] == [("T", ["a", "b"]), ("V", ["c", "1"])]
    (tmp_path / "marks").write_text('{"Metadata":[{"Type":"WordBoundary","Data":{"Offset":1000000,"Duration":500000,"text":{"Text":"hi"}}},{"Type":"End"}]}')
    assert [tuple(r) for r in speech_marks(spark, str(tmp_path / "marks")).collect()] == [("hi", 100.0, 50.0)]
    assert sources.read(spark, str(tmp_path / "a.txt")).count() == 2


def test_toggled_quotes(spark):
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([('a,"b""c,d",e',)], "line string")
    assert lines.select(toggled_fields(F.col("line")).alias("f")).first().f == ["a", "bc,d", "e"]


def test_html_blocks(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([("HEADING", 2, "a<b"), ("LIST_ITEM", 0, "x"), ("PARAGRAPH", None, "p\nq")], "type string, level int, text string")
    assert [r.h for r in t.select(html.block_html(F.col("type"), F.col("level"), F.col("text")).alias("h")).collect()] == ["<h2>a&lt;b</h2>", "<li>x</li>", "<p>p<br>q</p>"]


def test_chunks_and_reading_order():
    parts = ["Short one."] * 12 + ["w " * 300]
    chunks = layout.chunk(parts)
    assert " ".join(chunks).split() == " ".join(parts).split() and all(len(c) <= 420 for c in chunks)
    boxes = [(0, 0, 250, 8), (0, 20, 100, 30), (150, 20, 250, 30), (0, 40, 100, 50), (150, 40, 250, 50), (0, 60, 100, 70), (150, 60, 250, 70), (0, 80, 100, 90), (150, 80, 250, 90)]
    assert layout.xy_order(boxes, 10.0) == [0, 1, 3, 5, 7, 2, 4, 6, 8]


def test_workbook_side_tables(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    parts = {
        "_rels/.rels": rels(("a", "officeDocument", "xl/workbook.xml", "")),
        "xl/workbook.xml": f"<workbook xmlns='{main}' xmlns:r='{R}'><sheets><sheet name='A' r:id='r1'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/a.xml", "")),
        "xl/worksheets/a.xml": f"<worksheet xmlns='{main}' xmlns:r='{R}'><sheetViews><sheetView rightToLeft='1'><pane ySplit='2' state='frozen'/></sheetView></sheetViews><cols><col min='3' max='4' hidden='1'/></cols><sheetData><row r='7' hidden='1'/></sheetData><hyperlinks><hyperlink ref='A1:B2' r:id='h'/><hyperlink ref='C3' location='A!A1'/></hyperlinks></worksheet>",
        "xl/worksheets/_rels/a.xml.rels": rels(("h", "hyperlink", "http://x.org/", "TargetMode='External'"), ("c", "comments", "../comments1.xml", ""), ("t", "table", "../tables/t.xml", "")),
        "xl/comments1.xml": f"<comments xmlns='{main}'><authors><author>me</author></authors><commentList><comment ref='B2' authorId='0'><text><r><t>a </t></r><r><t>note</t></r></text></comment></commentList></comments>",
        "xl/tables/t.xml": f"<table xmlns='{main}' displayName='T1' ref='A1:B9' headerRowCount='1'><tableColumns><tableColumn name='x'/><tableColumn name='y'/></tableColumns></table>",
    }
    (tmp_path / "a.xlsx").write_bytes(package(parts))
    p = str(tmp_path)
    assert sorted(tuple(r)[1:] for r in sources.links(spark, p).collect()) == [("A", 1, 2, 1, 2, "http://x.org/"), ("A", 3, 3, 3, 3, "#A!A1")]
    assert [tuple(r)[1:] for r in sources.comments(spark, p).collect()] == [("A", 2, 2, "me", "a note")]
    assert [tuple(r)[1:] for r in sources.tables(spark, p).collect()] == [("A", "T1", 1, 9, 1, 2, 1, ["x", "y"])]
    assert [tuple(r)[1:] for r in sources.geometry(spark, p).collect()] == [("A", True, 2, 0, [7], [3, 4])]


def test_recognition_helpers(spark, tmp_path):
    import numpy as np

    from folioflow.operators import imageprep, ngram, ranking
    from folioflow.sources.plain import recognised_cache

    words = spark.createDataFrame([(1, 1, 0, "Hello", 0, 0, 5, 5, 90), (1, 1, 1, ",", 5, 0, 6, 5, 70), (1, 2, 2, ".", 0, 9, 1, 9, 50)], "page int, line int, pos int, text string, x0 int, y0 int, x1 int, y1 int, conf int")
    assert sorted((r.line, r.text, r.x1) for r in layout.glued(words).collect()) == [(1, "Hello,", 6), (2, ".", 1)]
    grey = np.tile(np.array([[100, 110, 120, 130]], np.uint8), (4, 1))
    assert imageprep.stretched(grey).min() == 0 and imageprep.stretched(grey).max() == 255
    page = np.full((20, 20), 200, np.uint8)
    page[8:12, 8:12] = 20
    black = imageprep.thresholded(page, 9) == 0
    assert black[8:12, 8:12].all() and black.sum() == 16
    (tmp_path / "cache").write_text("#ocr1\n3\t0.1\t0.2\t0.3\t0.4\thi\nbad\n")
    assert [tuple(r) for r in recognised_cache(spark, str(tmp_path / "cache")).collect()] == [(3, 0.1, 0.2, 0.3, 0.4, "hi")]
    text = spark.createDataFrame([("banana",)] * 50, "t string")
    table = ngram.context_table(ngram.contexts(text, "t"))
    assert ngram.beam("ban", table, 3)[0] == ("banana", 1.0)
    recents = spark.createDataFrame([("a", "A", 5), ("b", "B", 9)], "uri string, displayName string, lastOpened long")
    assert ranking.recents_json(recents).first().json == '[{"lastOpened":9,"uri":"b","displayName":"B"},{"lastOpened":5,"uri":"a","displayName":"A"}]'


def test_running_sum(spark):
    from pyspark.sql import functions as F

    from folioflow.operators.running import running_sum

    got = running_sum(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(2).alias("v")), "k", "v", "s").collect()
    assert all(r.s == 2 * (r.k + 1) for r in got) and len(got) == 1000
