"""Packages written and read back, workbooks recalculated, formats, speech preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..formula import evaluator
from ..operators import speech, workbook
from ..sinks import docx as docx_sink
from ..sinks import html
from ..sinks import xlsx as xlsx_sink
from ..sources.docx import read_blocks
from ..sources.office import BLOCKS, CELLS, parsed
from ..sources.xlsx import read_cells
from .register import Register, read

REGISTER = Register()


def _cells(spark, d):
    """A workbook a region: nations in columns A to C, a formula in D."""
    t = read(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("workbook_id"), F.lit("Nations").alias("sheet"), (F.col("n_nationkey") + 1).alias("r"), "n_name", "n_nationkey", "n_regionkey")
    kinds = {"f": "string", "n": "double", "s": "string", "b": "boolean", "e": "string"}

    def cell(c, kind, **given):
        return F.struct(F.lit(c).alias("c"), F.lit(kind).cast("string").alias("t"), *(given.get(k, F.lit(None)).cast(v).alias(k) for k, v in kinds.items()))

    made = F.array(
        cell(1, "s", s=F.col("n_name")),
        cell(2, "n", n=F.col("n_nationkey").cast("double")),
        cell(3, "b", b=F.col("n_nationkey") % 2 == 0),
        cell(4, None, f=F.concat(F.lit("=IF(C"), F.col("r"), F.lit(",B"), F.col("r"), F.lit("*2,UPPER(LEFT(A"), F.col("r"), F.lit(",3)))"))),
    )
    return t.select("workbook_id", "sheet", "r", F.inline(made))


@REGISTER(
    "wb_evaluate",
    "SELECT n_regionkey::BIGINT AS workbook_id, (n_nationkey + 1)::INTEGER AS r, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 2.0::DOUBLE END AS n, CASE WHEN n_nationkey % 2 <> 0 THEN upper(left(n_name, 3)) END AS s FROM nation",
)
def evaluate(spark, d):
    return evaluator.evaluate(_cells(spark, d)).where("c = 4").select("workbook_id", "r", "n", "s")


@REGISTER("wb_round_trip", "SELECT n_regionkey::VARCHAR AS path, 'Nations' AS sheet, (n_nationkey + 1)::INTEGER AS r, n_name AS name, n_nationkey::DOUBLE AS n, n_nationkey % 2 = 0 AS even, 'IF(C' || (n_nationkey + 1) || ',B' || (n_nationkey + 1) || '*2,UPPER(LEFT(A' || (n_nationkey + 1) || ',3)))' AS f FROM nation")
def round_trip(spark, d):
    books = xlsx_sink.packages(_cells(spark, d)).select(F.col("workbook_id").cast("string").alias("path"), "content")
    cells = parsed(books, CELLS, read_cells)
    return cells.groupBy("path", "sheet", "r").agg(F.max("s").alias("name"), F.max("n").alias("n"), F.bool_or("b").alias("even"), F.max("f").alias("f"))


@REGISTER("wb_documents_round_trip", "SELECT n_regionkey::VARCHAR AS path, n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'HEADING' WHEN n_nationkey % 3 = 1 THEN 'LIST_ITEM' ELSE 'PARAGRAPH' END AS type, n_name AS text FROM nation")
def documents_round_trip(spark, d):
    k = F.col("n_nationkey")
    kind = F.when(k % 3 == 0, "HEADING").when(k % 3 == 1, "LIST_ITEM").otherwise("PARAGRAPH")
    level = F.when(k % 3 == 0, 1).when(k % 3 == 1, 0).cast("int")
    text = F.concat(k.cast("string"), F.lit(" "), F.col("n_name"))
    t = read(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("path"), k.alias("pos"), kind.alias("type"), level.alias("level"), text.alias("text"))
    back = parsed(docx_sink.packages(t), BLOCKS, read_blocks)
    return back.select("path", F.split_part("text", F.lit(" "), F.lit(1)).cast("int").alias("id"), "type", F.regexp_replace("text", "^\\d+ ", "").alias("text"))


@REGISTER("wb_block_html", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '<h2>' || n_name || '</h2>' ELSE '<p>' || n_name || '</p>' END AS h FROM nation")
def block_html(spark, d):
    kind = F.when(F.col("n_nationkey") % 2 == 0, "HEADING").otherwise("PARAGRAPH")
    return read(spark, d, "nation").select("n_nationkey", html.block_html(kind, F.lit(2), F.col("n_name")).alias("h"))


@REGISTER("wb_formats", "SELECT o_orderkey, printf('%,.2f', o_totalprice::DECIMAL(18,2)) AS money, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def shown(spark, d):
    from ..functions.dates import date_serial

    t = read(spark, d, "orders").select("o_orderkey", "o_totalprice", date_serial(F.col("o_orderdate")).alias("serial"), F.lit("#,##0.00").alias("k1"), F.lit("yyyy-mm-dd").alias("k2"))
    t = workbook.shown_values(workbook.shown_values(t, "o_totalprice", "k1", "money"), "serial", "k2", "day")
    return t.select("o_orderkey", "money", "day")


@REGISTER("wb_row_table", "SELECT n_regionkey::VARCHAR AS path, (n_nationkey + 1)::INTEGER AS r, n_name || '|' || n_nationkey || '.0|' || CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS row FROM nation")
def row_table(spark, d):
    cells = _cells(spark, d).where("c < 4").withColumn("path", F.col("workbook_id").cast("string"))
    return workbook.row_table(cells).select("path", "r", F.array_join("fields", "|").alias("row"))


# ---------------------------------------------------------------- reading aloud


@REGISTER("sp_forms", "SELECT * FROM (VALUES ('5kg', '5 kilograms'), ('3-5cm', '3 to 5 centimetres'), ('[12].', ''), ('HTML', 'H T M L'), ('and/or', 'and or or'), ('word', 'word')) t(w, said)")
def forms(spark, d):
    t = spark.createDataFrame([(x,) for x in ("5kg", "3-5cm", "[12].", "HTML", "and/or", "word")], "w string")
    return t.select("w", speech.applied("speech", F.col("w")).alias("said"))


@REGISTER("sp_offsets", r"SELECT doc_id, count(*)::BIGINT AS n, sum(length(w))::BIGINT AS chars FROM (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[\s   ]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1")
def offsets(spark, d):
    # Texts are dealt over all tasks: they are often read by a few, and long to cut.
    t = read(spark, d, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = t.select("doc_id", "text", speech.text_blocks(F.col("text")).alias("blocks"))  # once a text, and not once a token
    t = t.select("doc_id", "blocks", F.inline(speech.with_offsets(F.col("text"))))
    t = t.where(speech.text_at(F.col("blocks"), F.col("start"), F.length("token")) == F.col("token"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("chars"))


@REGISTER("sp_language_runs", "SELECT * FROM (VALUES (1, 'en', 0, 2::BIGINT), (1, 'ar', 2, 3::BIGINT), (1, 'en', 5, 1::BIGINT)) t(doc_id, lang, first, n)")
def language_runs(spark, d):
    words = ["hello", "12", "كتاب", "جديد", "7", "end"]
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "doc_id int, pos int, word string")
    return speech.language_runs(t).select("doc_id", "lang", "first", "n")


@REGISTER("sp_foreign_letters", "SELECT * FROM (VALUES (1, 'بك'), (2, 'جا')) t(id, s)")
def foreign(spark, d):
    t = spark.createDataFrame([(1, "پک"), (2, "چا")], "id int, s string")
    return t.select("id", speech.foreign_letters(F.col("s")).alias("s"))


@REGISTER("sp_pieces", None)
def pieces(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(speech.speech_pieces(F.col("text"), 3300)).alias("part", "t")).select("doc_id", "part", F.octet_length("t").alias("bytes"))


@REGISTER("sp_timeline", "SELECT user_id, event_id, (v + coalesce((SELECT sum(d) FROM (SELECT user_id AS u, max(v + 1) AS d FROM (SELECT user_id, event_id % 60 AS v FROM events) GROUP BY 1) WHERE u < user_id), 0))::BIGINT AS at_ms FROM (SELECT user_id, event_id, event_id % 60 AS v FROM events)")
def timeline(spark, d):
    t = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 60).alias("at_ms"), F.lit(1).alias("ms"), F.lit(1).alias("chars"))
    return speech.joined_timeline(t, "user_id").select("user_id", "event_id", F.col("at_ms").cast("long").alias("at_ms"))


@REGISTER("sp_lexicon", "SELECT * FROM (VALUES ('gif', 'jif'), ('a', 'b')) t(word, spoken)")
def lexicon(spark, d):
    return speech.lexicon(spark.createDataFrame([("GIF=>jif",), ("a=b",), ("none",), ("=x",)], "line string"))


@REGISTER("sp_changed_lines", "SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 1")
def changed(spark, d):
    t = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("source"), F.when(F.col("n_nationkey") % 2 == 1, "other").otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("translation"))
    return speech.changed_lines(t).select("n_nationkey")


@REGISTER("sp_marks", "SELECT * FROM (VALUES (1, chr(1603) || chr(1617) || chr(1614)), (2, 'plain')) t(id, s)")
def marks(spark, d):
    t = spark.createDataFrame([(1, "كَّ"), (2, "plain")], "id int, s string")
    return t.select("id", speech.applied("normalised", F.col("s")).alias("s"))
