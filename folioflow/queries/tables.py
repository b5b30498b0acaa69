"""Operators whose other queries run on literal rows, here over whole tables with SQL that works the answer out.

No table has Arabic text, so it is made from Latin text letter by letter, the same way on both sides.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..operators import condfmt, infer, layout, lookup, speech
from ..operators import dictionary as Dict
from ..operators import textops as T
from ..sources import docx, pptx, rtf
from ..sources.office import parsed
from ..sources.plain import quoted_rows
from .register import Register, read

REGISTER = Register()

_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "أإآٱةىابتثجحخدذرزسشصضطظعغـ"
_MARKED = "ًَُِّْ"


def _arabic(s: Column) -> Column:
    """Letters for letters, and marks for digits."""
    return F.translate(F.lower(s), _FROM + "012345", _TO + _MARKED)


def _arabic_sql(s: str) -> str:
    return f"translate(lower({s}), '{_FROM}012345', '{_TO}{_MARKED}')"


_BARE = r"'[\x{064B}-\x{0670}\x{065F}\x{0640}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]'"
_DOCS = f"(SELECT doc_id, {_arabic_sql('text')} AS s FROM documents)"


@REGISTER("tx_normalize_documents", f"SELECT doc_id, md5(lower(translate(regexp_replace(s, {_BARE}, '', 'g'), 'أإآٱةى', 'ااااهي'))) AS h FROM {_DOCS}")
def normalize(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.search_key(_arabic(F.col("text")))).alias("h"))


@REGISTER("tx_dictionary_key_documents", f"SELECT doc_id, md5(translate(regexp_replace(s, {_BARE}, '', 'g'), 'أإآٱ', 'اااا')) AS h FROM {_DOCS}")
def dictionary_key(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.dictionary_key(_arabic(F.col("text")))).alias("h"))


_HALF = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_arabic_sql('text')} WHEN doc_id % 3 = 1 THEN text ELSE '12, ' || {_arabic_sql('left(text, 200)')} || substr(text, 201, doc_id % 400) END AS s FROM documents"


def _half(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    mixed = F.concat(F.lit("12, "), _arabic(F.left(t, F.lit(200))), F.substring(t, F.lit(201), (i % 400).cast("int")))
    return read(spark, d, "documents").select("doc_id", F.when(i % 3 == 0, _arabic(t)).when(i % 3 == 1, t).otherwise(mixed).alias("s"))


@REGISTER("tx_script_documents", rf"SELECT doc_id, CASE WHEN len(regexp_extract_all(s, '[\x{{0620}}-\x{{064A}}\x{{0671}}-\x{{06D3}}]')) > len(regexp_extract_all(s, '[A-Za-z\x{{00C0}}-\x{{024F}}]')) THEN 'ar' ELSE 'en' END AS lang FROM ({_HALF})")
def script(spark, d):
    return _half(spark, d).select("doc_id", T.script_language(F.col("s")).alias("lang"))


@REGISTER("tx_first_strong_documents", rf"SELECT doc_id, CASE WHEN w = '' THEN NULL WHEN ord(w) BETWEEN 1425 AND 2303 THEN 'rtl' ELSE 'ltr' END AS dir FROM (SELECT doc_id, regexp_extract(s, '\p{{L}}') AS w FROM ({_HALF}))")
def first_strong(spark, d):
    return _half(spark, d).select("doc_id", T.first_strong(F.col("s")).alias("dir"))


@REGISTER("tx_clean_documents", "SELECT doc_id, md5(translate(replace(text, '·', ''), '٠١٢', '012')) AS h FROM documents")
def clean(spark, d):
    foreign = F.concat(F.lit("•​"), F.translate("text", "0123456789", "٠١٢٣٤۵۶۷۸۹"))
    return read(spark, d, "documents").select("doc_id", F.md5(T.clean_token(foreign)).alias("h"))


@REGISTER("tx_garbled_documents", "SELECT doc_id, length(text) > 0 AND (length(text) - length(replace(replace(text, 'e', ''), 'a', '')))::DOUBLE >= length(text) * 0.08 AS bad, md5(replace(replace(text, 'e', ' '), 'a', ' ')) AS h FROM documents")
def garbled(spark, d):
    s = F.translate("text", "ea", "\u0001\u0002")
    return read(spark, d, "documents").select("doc_id", T.garbled(s).alias("bad"), F.md5(T.sanitized(s)).alias("h"))


@REGISTER(
    "tx_packed_documents",
    r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{2,}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
    q AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM p),
    c AS (SELECT doc_id, i, k, length(substr(p, (k * 600 + 1)::BIGINT, 600)) AS n FROM (SELECT *, unnest(range(0, (length(p) - 1) // 600 + 1)) AS k FROM q)),
    o AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS r FROM c),
    s AS (SELECT doc_id, r, 0 AS part, n FROM o WHERE r = 1 UNION ALL SELECT s.doc_id, o.r, CASE WHEN s.n + 1 + o.n <= 600 THEN s.part ELSE s.part + 1 END, CASE WHEN s.n + 1 + o.n <= 600 THEN s.n + 1 + o.n ELSE o.n END FROM s JOIN o ON s.doc_id = o.doc_id AND o.r = s.r + 1)
    SELECT doc_id, part, max(n)::INTEGER AS n FROM s GROUP BY 1, 2""",
)
def packed(spark, d):
    parts = read(spark, d, "documents").select("doc_id", F.posexplode(T.split_to_size(F.col("text"), 600)).alias("part", "t"))
    return parts.select("doc_id", "part", F.length("t").alias("n"))


# ---------------------------------------------------------------- recognition and input

_ENDS = ("pdf", "DOCX", "xlsm", "pptx", "rtf", "csv", "log", "htm", "webp", "json", "doc", "zip")
_KINDS = ("pdf", "docx", "xlsx", "pptx", "rtf", "csv", "txt", "html", "image", "json", "unsupported", "unknown")


@REGISTER("in_ext_parts", f"SELECT p_partkey, list_value({', '.join(map(repr, _KINDS))})[p_partkey % 12 + 1] AS kind FROM part")
def extension(spark, d):
    ends = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", infer.document_type(F.concat("p_name", F.lit("."), ends)).alias("kind"))


_HEADS = ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "424D3132", "52494646313233345745425000", "3C7376672076", "25504446")
_IMAGES = ("image/png", "image/jpeg", "image/gif", "image/bmp", "image/webp", "image/svg+xml", None)


@REGISTER("in_images_parts", f"SELECT p_partkey, k AS kind, CASE WHEN k IS NOT NULL THEN 'data:' || k || ';base64,' || to_base64(unhex(h) || encode(p_name)) END AS uri FROM (SELECT p_partkey, p_name, list_value({', '.join(repr(x) if x else 'NULL' for x in _IMAGES)})[p_partkey % 7 + 1] AS k, list_value({', '.join(map(repr, _HEADS))})[p_partkey % 7 + 1] AS h FROM part)")
def images(spark, d):
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    t = read(spark, d, "part").select("p_partkey", F.unhex(F.concat(head, F.hex(F.encode("p_name", "UTF-8")))).alias("b"))
    return t.select("p_partkey", infer.image_type(F.col("b")).alias("kind"), infer.data_uri(F.col("b")).alias("uri"))


@REGISTER(
    "in_typed_orders",
    """SELECT o_orderkey, list_value('date', 'date', 'number', 'number', 'time', 'text', 'bool', 'formula', 'blank')[o_orderkey % 9 + 1] AS kind,
      round(CASE o_orderkey % 9 WHEN 0 THEN day WHEN 1 THEN CASE WHEN day(o_orderdate) > 12 OR month(o_orderdate) = day(o_orderdate) THEN day ELSE swapped END WHEN 2 THEN o_orderkey::DOUBLE / 100 WHEN 3 THEN o_orderkey::DOUBLE + 1000 WHEN 4 THEN (o_orderkey % 24) / 24.0 + 5 / 1440.0 WHEN 6 THEN o_orderkey % 2 END, 9) AS n
    FROM (SELECT *, (datediff('day', DATE '1899-12-30', o_orderdate::DATE))::DOUBLE AS day, CASE WHEN day(o_orderdate) <= 12 THEN datediff('day', DATE '1899-12-30', make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)))::DOUBLE END AS swapped FROM orders)""",
)
def typed(spark, d):
    i, at = F.col("o_orderkey"), F.col("o_orderdate")
    texts = [
        F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "MM/dd/yyyy"), F.concat(i.cast("string"), F.lit("%")), F.format_number(i + 1000, 0), F.concat((i % 24).cast("string"), F.lit(":05")),
        F.concat(F.lit("'"), i.cast("string")), F.when(i % 2 == 1, "true").otherwise("False"), F.concat(F.lit("=A"), i.cast("string")), F.lit(" "),
    ]
    t = read(spark, d, "orders").select("o_orderkey", infer.typed_input(F.element_at(F.array(*texts), (i % 9 + 1).cast("int"))).alias("x"))
    return t.select("o_orderkey", "x.kind", F.round("x.n", 9).alias("n"))


@REGISTER("in_cells_parts", "SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN (p_partkey // 26 + 1)::INTEGER END AS r, CASE WHEN p_partkey % 5 < 4 THEN (p_partkey % 26 + 1)::INTEGER END AS c FROM part")
def cells(spark, d):
    i = F.col("p_partkey")
    name = F.concat(F.lit("$"), F.chr(i % 26 + 65), F.when(i % 2 == 1, "$").otherwise(""), F.floor(i / 26) + 1, F.when(i % 5 == 4, "!").otherwise(""))
    t = read(spark, d, "part").select("p_partkey", infer.cell_of(name).alias("x"))
    return t.select("p_partkey", "x.r", "x.c")


# ---------------------------------------------------------------- functions


@REGISTER("xl_proper_parts", "SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS name FROM part")
def proper(spark, d):
    return read(spark, d, "part").select("p_partkey", X.proper(F.lower("p_type")).alias("name"))


@REGISTER("xl_mid_parts", "SELECT p_partkey, CASE WHEN p_size % 9 >= 1 THEN substr(p_name, p_size % 9, p_size % 4) END AS v, CASE WHEN p_size % 9 < 1 THEN '#VALUE!' END AS fault FROM part")
def mid(spark, d):
    r = X.mid(F.col("p_name"), F.col("p_size") % 9, F.col("p_size") % 4)
    return read(spark, d, "part").select("p_partkey", r["v"].alias("v"), r["e"].alias("fault"))


@REGISTER("xl_substitute_parts", "SELECT p_partkey, CASE WHEN len(w) > 2 THEN w[1] || ' ' || w[2] || '__' || array_to_string(w[3:], ' ') ELSE p_type END AS r FROM (SELECT p_partkey, p_type, string_split(p_type, ' ') AS w FROM part)")
def substitute(spark, d):
    return read(spark, d, "part").select("p_partkey", X.substitute(F.col("p_type"), " ", "__", 2).alias("r"))


@REGISTER("xl_value_parts", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size / 100.0::DOUBLE WHEN 1 THEN p_size * 1000.0::DOUBLE WHEN 2 THEN -p_size::DOUBLE END AS v, CASE WHEN p_partkey % 4 = 3 THEN '#VALUE!' END AS fault FROM part")
def value(spark, d):
    n, s = F.col("p_size"), F.col("p_size").cast("string")
    texts = [F.concat(s, F.lit("%")), F.concat(F.lit(" "), s, F.lit("e3 ")), F.concat(F.lit("-"), s), F.concat(F.lit("x"), s)]
    r = N.value(F.element_at(F.array(*texts), (F.col("p_partkey") % 4 + 1).cast("int")))
    return read(spark, d, "part").where(n.isNotNull()).select("p_partkey", r["v"].alias("v"), r["e"].alias("fault"))


@REGISTER("xl_number_text_parts", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (p_size * 1000)::VARCHAR ELSE rtrim(rtrim(printf('%.2f', p_retailprice), '0'), '.') END AS s FROM part")
def number_text(spark, d):
    x = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") * 1000.0).otherwise(F.round("p_retailprice", 2))
    return read(spark, d, "part").select("p_partkey", N.number_text(x).alias("s"))


@REGISTER("xl_ifna_parts", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN -1.0::DOUBLE WHEN 2 THEN p_retailprice END AS v FROM part")
def if_na(spark, d):
    from ..functions.errors import if_na as replaced

    i = F.col("p_partkey") % 3
    r = F.struct(F.when(i == 2, F.col("p_retailprice")).alias("v"), F.when(i == 0, "#N/A").when(i == 1, "#REF!").alias("e"))
    return read(spark, d, "part").select("p_partkey", replaced(r, F.lit(-1.0)).alias("v"))


@REGISTER("cf_blanks_parts", "SELECT p_partkey, p_partkey % 4 < 2 AS blank, p_partkey % 4 = 2 AS fault FROM part")
def blanks(spark, d):
    i = F.col("p_partkey") % 4
    v = F.when(i == 1, F.lit("  ")).when(i == 2, F.concat(F.lit("#"), "p_brand")).when(i == 3, F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", condfmt.is_blank(v).alias("blank"), condfmt.is_error(v).alias("fault"))


@REGISTER("cf_mix_parts", "SELECT p_partkey, CASE WHEN x < 0.5 THEN printf('FF%02X00', floor(255 * 2 * x + 0.5)::INTEGER) ELSE printf('%02XFF00', floor(255 + (0 - 255) * (2 * x - 1) + 0.5)::INTEGER) END AS colour FROM (SELECT p_partkey, p_size / 64.0::DOUBLE AS x FROM part)")
def mixed(spark, d):
    return read(spark, d, "part").select("p_partkey", condfmt.mix(F.col("p_size") / 64.0, [(255, 0, 0), (255, 255, 0), (0, 255, 0)]).alias("colour"))


@REGISTER(
    "dx_style_closure_parts",
    """WITH RECURSIVE s AS (SELECT p_partkey AS node, p_partkey AS ancestor, 0 AS depth FROM part
      UNION ALL SELECT s.node, s.ancestor // 3, depth + 1 FROM s WHERE s.ancestor // 3 > 0) SELECT node, ancestor, depth FROM s""",
)
def closure(spark, d):
    up = F.floor(F.col("p_partkey") / 3)
    parents = read(spark, d, "part").select(F.col("p_partkey").alias("style"), F.when(up > 0, up).alias("based_on"))
    return lookup.closure(parents, "style", "based_on")


# ---------------------------------------------------------------- dictionaries

# Entries of three packs: a word of a part's name with a mark after every letter that the pack chooses.
_WORD = "list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 4)"
_ENTRIES = rf"""SELECT p_partkey % 3 AS pack, p_partkey AS line_no, p AS plain, regexp_replace(p, '(.)', '\1' || list_value('َ', 'ُ', 'ِ')[p_partkey % 3 + 1], 'g') AS shaped
  FROM (SELECT p_partkey, translate(regexp_replace(unnest({_WORD}), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'أبتثجحخدذرزسشصضطظعغفقكلمنه') AS p FROM part) WHERE length(p) >= 3"""
_ARABIC_WORD = ("abcdefghijklmnopqrstuvwxyz", "أبتثجحخدذرزسشصضطظعغفقكلمنه")
_MERGED = f"SELECT plain, arg_max(shaped, pack * 1000000000 + line_no) AS shaped, max(pack)::INTEGER AS priority FROM ({_ENTRIES}) GROUP BY 1"


def _entries(spark, d):
    words = F.filter(F.split(F.lower("p_name"), " "), lambda x: F.length(x) >= 4)
    t = read(spark, d, "part").select("p_partkey", F.explode(words).alias("w"))
    plain = F.translate(F.regexp_replace("w", "[^a-z]", ""), *_ARABIC_WORD)
    mark = F.element_at(F.array(F.lit("َ"), F.lit("ُ"), F.lit("ِ")), (F.col("p_partkey") % 3 + 1).cast("int"))
    t = t.select("p_partkey", plain.alias("p"), mark.alias("m")).where(F.length("p") >= 3)
    shaped = F.array_join(F.transform(F.filter(F.split("p", ""), lambda c: c != ""), lambda c: F.concat(c, F.col("m"))), "")
    # Sides of a line may stand either way round; the marked one is the shaped one.
    cut = F.when(F.col("p_partkey") % 2 == 0, F.concat("p", F.lit("\t"), shaped)).otherwise(F.concat(shaped, F.lit("="), "p"))
    lines = t.select((F.col("p_partkey") % 3).cast("int").alias("priority"), F.col("p_partkey").alias("line_no"), cut.alias("line"))
    return Dict.parse_lines(lines)


@REGISTER("dc_parse_parts", f"SELECT line_no, plain, shaped FROM ({_ENTRIES})")
def parse(spark, d):
    return _entries(spark, d).select("line_no", "plain", "shaped")


@REGISTER("dc_merge_parts", _MERGED)
def merge(spark, d):
    return Dict.merge(_entries(spark, d)).select("plain", "shaped", "priority")


_NORM = f"SELECT replace(plain, 'أ', 'ا') AS key, CASE WHEN count(DISTINCT shaped) = 1 THEN min(shaped) END AS shaped, count(DISTINCT shaped) > 1 AS ambiguous FROM ({_MERGED}) GROUP BY 1"


@REGISTER("dc_keys_parts", _NORM)
def keys(spark, d):
    return Dict.keys(Dict.merge(_entries(spark, d)))


# Words of the part types and names: plain, written with a bare alef, with a particle before or an ending after, marked, or short.
_TEXT = rf"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN w WHEN 1 THEN replace(w, 'أ', 'ا') WHEN 2 THEN 'و' || w WHEN 3 THEN w || 'ها' WHEN 4 THEN w || 'َ' ELSE left(w, 2) END AS t
  FROM (SELECT p_partkey, unnest(list_transform(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: translate(regexp_replace(x, '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'أبتثجحخدذرزسشصضطظعغفقكلمنه'))) AS w FROM part) WHERE w <> ''"""
_PLAIN = r"replace(regexp_replace(t, '[\x{064B}-\x{0652}]', '', 'g'), 'ـ', '')"


@REGISTER(
    "dc_coverage_parts",
    f"""WITH w AS (SELECT {_PLAIN} AS t, regexp_matches(t, '[\\x{{064B}}-\\x{{0652}}]') AS marked FROM ({_TEXT})),
    merged AS ({_MERGED}), norm AS (SELECT key, shaped FROM ({_NORM}) WHERE shaped IS NOT NULL),
    c AS (SELECT w.t, marked, replace(w.t, 'أ', 'ا') AS key, m.shaped AS exact FROM w LEFT JOIN merged m ON w.t = m.plain),
    k AS (SELECT *, key IN (SELECT key FROM norm) AS by_key, left(key, 1) IN ('و', 'ف', 'ب', 'ل', 'ك') AND length(key) > 3 AND substr(key, 2) IN (SELECT key FROM norm) AS by_stem,
      list_sort(list_filter(['ها', 'هم', 'هن', 'كم', 'نا', 'ه', 'ك', 'ي'], lambda x: ends_with(key, x) AND length(key) >= 3 + length(x)), 'DESC') AS ends FROM c),
    b AS (SELECT *, left(key, length(key) - length(list_reduce(list_prepend('', ends), lambda a, b: CASE WHEN length(a) >= length(b) THEN a ELSE b END))) AS base FROM k),
    kinds AS (SELECT *, CASE WHEN marked THEN 'marked' WHEN length(t) < 3 THEN 'short' WHEN exact IS NOT NULL THEN 'EXACT' WHEN by_key THEN 'NORMALIZED' WHEN by_stem THEN 'CLITIC' WHEN len(ends) > 0 AND base IN (SELECT key FROM norm) THEN 'SUFFIX' ELSE 'UNKNOWN' END AS kind FROM b)
    SELECT kind, count(*)::BIGINT AS n FROM kinds GROUP BY 1""",
)
def coverage(spark, d):
    parts = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    t = read(spark, d, "part").select("p_partkey", F.explode(parts).alias("w")).select("p_partkey", F.translate(F.regexp_replace("w", "[^a-z]", ""), *_ARABIC_WORD).alias("w")).where("w != ''")
    w, i = F.col("w"), F.col("p_partkey") % 6
    shown = F.when(i == 0, w).when(i == 1, F.replace(w, F.lit("أ"), F.lit("ا"))).when(i == 2, F.concat(F.lit("و"), w)).when(i == 3, F.concat(w, F.lit("ها"))).when(i == 4, F.concat(w, F.lit("َ"))).otherwise(F.left(w, F.lit(2)))
    learned = spark.createDataFrame([], "plain string, shaped string")
    return Dict.coverage_by_kind(t.select(shown.alias("text")), learned, Dict.merge(_entries(spark, d)))


# ---------------------------------------------------------------- layout and speech

_BOXES = "SELECT page, line, t, t + 9.0::DOUBLE AS b FROM (SELECT p_partkey % 40 AS page, p_partkey // 40 AS line, ((p_partkey // 40) * 12 + (p_size % 4) * 9)::DOUBLE AS t FROM part)"


@REGISTER(
    "ly_paragraph_parts",
    f"""WITH l AS (SELECT *, t - lag(t) OVER (PARTITION BY page ORDER BY line) AS step FROM ({_BOXES})),
    u AS (SELECT page, (list(step ORDER BY step))[len(list(step)) // 2 + 1] AS usual FROM l WHERE step > 0 GROUP BY 1)
    SELECT page, line, sum(CASE WHEN step > CASE WHEN usual IS NULL THEN 2.1 * 9 ELSE greatest(1.7 * usual, 1.6 * 9) END OR step <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line)::BIGINT AS paragraph FROM l LEFT JOIN u USING (page)""",
)
def paragraph(spark, d):
    i = F.col("p_partkey")
    line = F.floor(i / 40)
    t = read(spark, d, "part").select((i % 40).alias("page"), line.alias("line"), (line * 12 + F.col("p_size") % 4 * 9).cast("double").alias("t")).withColumn("b", F.col("t") + 9.0)
    return layout.paragraphs(t).select("page", "line", "paragraph")


@REGISTER("ly_line_boxes_parts", "SELECT p_partkey % 50 AS page, (p_partkey // 50) // 10 AS seg, string_agg(left(p_name, 1), '' ORDER BY x, left(p_name, 1)) AS text, min(x) AS x0, max(x) + 5 AS x1 FROM (SELECT *, (p_partkey // 50 * 7 + p_partkey // 500 * 90)::DOUBLE AS x FROM part) GROUP BY 1, 2")
def line_boxes(spark, d):
    i = F.col("p_partkey")
    t = read(spark, d, "part").select((i % 50).alias("page"), F.left("p_name", F.lit(1)).alias("u"), (F.floor(i / 50) * 7 + F.floor(i / 500) * 90).cast("double").alias("x0"))
    t = t.withColumns({"x1": F.col("x0") + 5.0, "top": F.lit(0.0), "bottom": F.lit(9.0), "font": F.lit(10.0)})
    cut = layout.islands(t, ["page"], "x0", "x1", "font", layout.LINE_CUT, "seg")
    return layout.line_boxes(cut, ["page", "seg"]).select("page", "seg", "text", "x0", "x1")


@REGISTER(
    "ly_nearest_mark_parts",
    """WITH b AS (SELECT p_partkey % 20 AS page, p_partkey AS id, (p_partkey // 20 % 30 * 9)::DOUBLE AS x0, (p_partkey // 20 % 30 * 9 + 8)::DOUBLE AS x1, (p_partkey // 600 * 30)::DOUBLE AS base FROM part),
    m AS (SELECT page, id + 1000000 AS mark, x0 + 2 + id % 5 AS x0, x0 + 4 + id % 5 AS x1, base - 4 AS base FROM b WHERE id % 3 = 0),
    s AS (SELECT m.page, mark, id, greatest(0.0, b.x0 - m.x1, m.x0 - b.x1) AS d, abs((m.x0 + m.x1) / 2 - (b.x0 + b.x1) / 2) AS c, abs(b.base - m.base) AS dy FROM m JOIN b USING (page))
    SELECT page, mark, arg_min(id, d + 0.15 * c + 0.35 * dy + id * 1e-9) AS glyph FROM s WHERE dy <= 12 AND d <= 9 GROUP BY 1, 2""",
)
def nearest_mark(spark, d):
    i = F.col("p_partkey")
    x = (F.floor(i / 20) % 30 * 9).cast("double")
    b = read(spark, d, "part").select((i % 20).alias("page"), i.alias("id"), x.alias("x0"), (x + 8).alias("x1"), (F.floor(i / 600) * 30).cast("double").alias("base"), F.lit(10.0).alias("font"))
    j = F.col("id")
    m = b.where(j % 3 == 0).select("page", (j + 1000000).alias("id"), (F.col("x0") + 2 + j % 5).alias("x0"), (F.col("x0") + 4 + j % 5).alias("x1"), (F.col("base") - 4).alias("base"), "font")
    return layout.attach_marks(m, b).select("page", "mark", "glyph")


@REGISTER("ly_hocr_parts", "SELECT p_partkey // 10 AS page, (p_partkey % 10 // 5 + 1)::BIGINT AS line, replace(p_name, '#', ' & ') AS text, (p_partkey % 10)::INTEGER AS x0, (p_size % 100)::INTEGER AS conf FROM part WHERE p_size % 100 >= 15 AND (p_size % 100 >= 30 OR length(regexp_replace(p_name, '[^a-zA-Z]', '', 'g')) > 2)")
def hocr(spark, d):
    i = F.col("p_partkey")
    word = F.format_string("<span class='ocrx_word' title='bbox %d 2 30 9; x_wconf %d'><b>%s</b></span>", i % 10, F.col("p_size") % 100, F.replace("p_name", F.lit("#"), F.lit(" &amp; ")))
    t = read(spark, d, "part").select(F.floor(i / 10).alias("page"), F.floor(i % 10 / 5).alias("line"), i.alias("i"), word.alias("w"))
    lines = t.groupBy("page", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x.w), " ").alias("w"))
    lines = lines.withColumn("w", F.concat(F.lit("<span class='ocr_line' title=\"bbox 0 0 100 10\">"), "w", F.lit("</span>")))
    pages = lines.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "w"))), lambda x: x.w), "").alias("html"))
    # A line without a word has no number in the result, so lines count from 1 in a page whatever it holds.
    return layout.confident(layout.hocr_words(pages)).select("page", "line", "text", "x0", "conf")


_SAID = "SELECT doc_id, (generate_subscripts(ws, 1) - 1)::INTEGER AS pos, unnest(ws) AS w FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\\s   ]+'), lambda x: x <> '') AS ws FROM documents)"


@REGISTER(
    "sp_language_runs_documents",
    rf"""WITH t AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 3 THEN '12' WHEN pos % 20 < 6 THEN {_arabic_sql('w')} ELSE w END AS w FROM ({_SAID})),
    o AS (SELECT *, CASE WHEN regexp_matches(w, '[\x{{0621}}-\x{{064A}}]') THEN 'ar' WHEN regexp_matches(w, '[A-Za-z\x{{00C0}}-\x{{024F}}]') THEN 'en' END AS own FROM t),
    l AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'en') AS lang FROM o),
    r AS (SELECT *, sum(CASE WHEN lang <> p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(lang) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM l))
    SELECT doc_id, lang, min(pos)::INTEGER AS first, count(*)::BIGINT AS n FROM r GROUP BY doc_id, run, lang""",
)
def language_runs(spark, d):
    # Texts are dealt, not their words: so words of a text are where its windows want them.
    t = T.word_rows(_dealt(spark, read(spark, d, "documents").select("doc_id", "text"), "doc_id"), ["doc_id"], "text")
    p = F.col("pos")
    t = t.withColumn("word", F.when(p % 7 == 3, "12").when(p % 20 < 6, _arabic(F.col("word"))).otherwise(F.col("word")))
    return speech.language_runs(t).select("doc_id", "lang", "first", "n")


@REGISTER("sp_foreign_documents", "SELECT doc_id, md5(translate(lower(text), 'abcdefghijklmno', 'بجزكفقتدرنههههي')) AS h FROM documents")
def foreign(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(speech.foreign_letters(F.translate(F.lower("text"), "abcdefghijklmno", "پچژگڤڨٹڈڑںھہۂۃے"))).alias("h"))


@REGISTER("sp_lexicon_parts", "SELECT lower(p_brand) || p_partkey AS word, p_type AS spoken FROM part WHERE p_partkey % 3 < 2")
def lexicon(spark, d):
    i = F.col("p_partkey")
    line = F.concat("p_brand", i.cast("string"), F.when(i % 3 == 0, " => ").when(i % 3 == 1, "= ").otherwise(" - "), "p_type", F.lit(" "))
    return speech.lexicon(read(spark, d, "part").select(line.alias("line")))


@REGISTER("sp_forms_parts", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' kilograms' WHEN 1 THEN p_size || ' to ' || (p_size + 5) || ' centimetres' WHEN 2 THEN '' ELSE 'B C D' END AS said FROM part")
def forms(spark, d):
    s = F.col("p_size").cast("string")
    texts = [F.concat(s, F.lit("kg")), F.concat(s, F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit("cm")), F.concat(F.lit("["), s, F.lit("].")), F.lit("BCD")]
    token = F.element_at(F.array(*texts), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", speech.applied("speech", token).alias("said"))


# ---------------------------------------------------------------- pages

_GLYPHS = "SELECT p_partkey % 40 AS page, p_partkey AS id, (p_retailprice * 0.4)::DOUBLE AS base, (8 + p_size % 7)::DOUBLE AS font FROM part"


@REGISTER(
    "ly_bands_parts",
    f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY base, id) AS k FROM ({_GLYPHS})),
    s AS (SELECT page, id, k, 0::BIGINT AS band, 1::BIGINT AS n, base AS mean, font AS size FROM g WHERE k = 1
      UNION ALL SELECT g.page, g.id, g.k, CASE WHEN abs(g.base - mean) <= 0.5 * greatest(size, g.font) THEN band ELSE band + 1 END, CASE WHEN abs(g.base - mean) <= 0.5 * greatest(size, g.font) THEN n + 1 ELSE 1 END,
        CASE WHEN abs(g.base - mean) <= 0.5 * greatest(size, g.font) THEN mean + (g.base - mean) / (n + 1) ELSE g.base END, CASE WHEN abs(g.base - mean) <= 0.5 * greatest(size, g.font) THEN greatest(size, g.font) ELSE g.font END
      FROM s JOIN g ON s.page = g.page AND g.k = s.k + 1)
    SELECT page, id, band FROM s""",
)
def bands(spark, d):
    i = F.col("p_partkey")
    t = read(spark, d, "part").select((i % 40).alias("page"), i.alias("id"), (F.col("p_retailprice") * 0.4).alias("base"), (8 + F.col("p_size") % 7).cast("double").alias("font"))
    return layout.banded(t)


_PAGE = f"SELECT doc_id AS page, pos, pos // 9 AS line, CASE WHEN pos % 9 = 8 AND pos % 2 = 0 THEN w || '-' ELSE w END AS text, pos % 45 = 0 AND pos > 0 AS starts FROM ({_SAID})"


def _page(spark, d):
    # Texts are dealt, not their words: so words of a page are where windows and groups of pages want them.
    docs = _dealt(spark, read(spark, d, "documents").select(F.col("doc_id").alias("page"), "text"), "page")
    t, p = T.word_rows(docs, ["page"], "text"), F.col("pos")
    return t.select("page", "pos", F.floor(p / 9).alias("line"), F.when((p % 9 == 8) & (p % 2 == 0), F.concat("word", F.lit("-"))).otherwise(F.col("word")).alias("text"), ((p % 45 == 0) & (p > 0)).alias("starts"))


@REGISTER(
    "ly_page_text_documents",
    rf"""WITH w AS (SELECT *, lag(text) OVER o AS bt, lag(line) OVER o AS bl, lead(text) OVER o AS nt, lead(line) OVER o AS nl, lead(starts) OVER o AS ns FROM ({_PAGE}) WINDOW o AS (PARTITION BY page ORDER BY pos)),
    j AS (SELECT *, bt IS NOT NULL AND NOT starts AND bl <> line AND ends_with(bt, '-') AND length(bt) > 2 AND regexp_matches(text, '^\p{{Ll}}') AS glue, nt IS NOT NULL AND NOT ns AND nl <> line AND ends_with(text, '-') AND length(text) > 2 AND regexp_matches(nt, '^\p{{Ll}}') AS cut FROM w),
    k AS (SELECT *, CASE WHEN bt IS NULL OR glue THEN '' WHEN starts THEN CASE WHEN regexp_matches(bt, '[.,!?:;،؛؟…)"”»\]]$') THEN chr(10) ELSE '.' || chr(10) END ELSE ' ' END || CASE WHEN cut THEN left(text, length(text) - 1) ELSE text END AS said FROM j)
    SELECT page, md5(string_agg(said, '' ORDER BY pos)) AS h, sum(length(said))::BIGINT AS n FROM k GROUP BY 1""",
)
def page_text(spark, d):
    texts = layout.page_texts(layout.page_words(_page(spark, d)))
    return texts.select("page", F.md5("text").alias("h"), F.col("end").cast("long").alias("n"))


@REGISTER(
    "ly_paragraph_starts_documents",
    f"""WITH p AS (SELECT doc_id AS page, pos, pos // 7 AS line, w AS text, (pos // 7 * 0.02 + CASE WHEN pos // 7 % 6 = 5 THEN 0.03 ELSE 0 END - CASE WHEN pos // 7 % 11 = 10 THEN 0.02 ELSE 0 END - pos // 280 * 0.75)::DOUBLE AS t FROM ({_SAID}) WHERE doc_id % 5 = 0),
    w AS (SELECT *, lag(line) OVER o AS bl, lag(text) OVER o AS bt, t - lag(t) OVER o AS dy, greatest(0.004, (lag(t) OVER o + 0.012) - lag(t) OVER o) AS h FROM p WINDOW o AS (PARTITION BY page ORDER BY pos)),
    u AS (SELECT page, (list(dy ORDER BY dy))[len(list(dy)) // 2 + 1] AS usual FROM w WHERE bl <> line AND dy > 0.002 GROUP BY 1 HAVING count(*) >= 3),
    c AS (SELECT w.*, usual, regexp_matches(text, '^\\p{{L}}') AND (regexp_matches(bt, '[,،]$') OR (regexp_matches(bt, '[\\p{{L}}\\x{{064B}}-\\x{{0652}}]$') AND lower(regexp_replace(bt, '[^\\p{{L}}]', '', 'g')) IN ({', '.join(repr(x) for x in layout.OPEN_ENDERS)}))) AS goes FROM w LEFT JOIN u USING (page))
    SELECT page, count(*) FILTER (bl <> line AND CASE WHEN abs(dy) < 0.35 * h THEN NOT goes WHEN dy > CASE WHEN usual IS NULL THEN 2.1 * h ELSE greatest(1.7 * usual, 1.6 * h) END THEN true WHEN dy < -2.4 * h THEN NOT goes ELSE false END)::BIGINT AS n FROM c GROUP BY 1""",
)
def paragraph_starts(spark, d):
    docs = read(spark, d, "documents").where(F.col("doc_id") % 5 == 0)
    w = T.word_rows(docs, [F.col("doc_id").alias("page")], "text")
    line = F.floor(F.col("pos") / 7)
    t = line * F.lit("0.02").cast("decimal(4,2)") + F.when(line % 6 == 5, F.lit("0.03").cast("decimal(4,2)")).otherwise(0) - F.when(line % 11 == 10, F.lit("0.02").cast("decimal(4,2)")).otherwise(0) - F.floor(F.col("pos") / 280) * F.lit("0.75").cast("decimal(4,2)")
    words = w.select("page", "pos", line.alias("line"), F.col("word").alias("text"), t.cast("double").alias("t")).withColumn("b", F.col("t") + 0.012)
    return layout.paragraph_starts(words).groupBy("page").agg(F.count_if("starts").alias("n"))


@REGISTER(
    "ly_merge_chunks_orders",
    """WITH RECURSIVE o AS (SELECT o_custkey AS page, o_orderkey AS k, 20 + o_orderkey * 7 % 280 AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'ar' ELSE 'en' END AS lang FROM orders),
    c AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY k) AS r, sum(n) OVER (PARTITION BY page ORDER BY k)::BIGINT AS e, sum(n) OVER (PARTITION BY page ORDER BY k)::BIGINT - n AS s, lang FROM o),
    m AS (SELECT page, r, 0 AS done, s, e, lang FROM c WHERE r = 1
      UNION ALL SELECT m.page, c.r, CASE WHEN f THEN done ELSE done + 1 END, CASE WHEN f THEN m.s ELSE c.s END, c.e, CASE WHEN NOT f THEN c.lang WHEN m.lang = c.lang OR m.e - m.s >= c.e - c.s THEN m.lang ELSE c.lang END
      FROM m JOIN c ON m.page = c.page AND c.r = m.r + 1, LATERAL (SELECT c.e - m.s <= CASE done WHEN 0 THEN 300 WHEN 1 THEN 800 ELSE 1400 END AND (m.lang = c.lang OR least(m.e - m.s, c.e - c.s) < 40) AS f))
    SELECT page, s AS start, max(e) AS "end", arg_max(lang, r) AS lang FROM m GROUP BY page, done, s""",
)
def merge_chunks(spark, d):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    t = read(spark, d, "orders").select(F.col("o_custkey").alias("page"), k, (20 + k * 7 % 280).alias("n"), F.when(k % 5 == 0, "ar").otherwise("en").alias("lang"))
    t = t.withColumn("end", F.sum("n").over(Window.partitionBy("page").orderBy("o_orderkey"))).withColumn("start", F.col("end") - F.col("n"))
    return layout.merge_chunks(t)


@REGISTER(
    "tx_search_report",
    f"""WITH h AS (SELECT doc_id, pos FROM ({_SAID}) WHERE contains(lower(w), 'the') ORDER BY 1, 2 LIMIT 501)
    SELECT doc_id, pos::INTEGER AS first_pos, (SELECT count(*) > 500 FROM h) AS truncated FROM h ORDER BY 1, 2 LIMIT 500""",
)
def search_report(spark, d):
    return T.phrase_report(T.word_rows(read(spark, d, "documents"), ["doc_id"], "text"), "the", "doc_id", "pos", "word")


# ---------------------------------------------------------------- files


@REGISTER("wb_csv_rows", "SELECT p_partkey, 4::INTEGER AS n, p_name || ', \"' || p_brand || '\"' || chr(10) || p_type AS second, '' AS third FROM part")
def csv(spark, d):
    quoted = F.concat(F.lit('"'), "p_name", F.lit(', ""'), "p_brand", F.lit('""\r\n'), "p_type", F.lit('"'))
    text = F.concat(F.lit("\r\na,"), quoted, F.lit(',,"x"\r\n'))
    rows = read(spark, d, "part").select("p_partkey", F.explode(quoted_rows(text)).alias("f"))
    return rows.select("p_partkey", F.size("f").alias("n"), F.replace(F.col("f")[1], F.lit("\r\n"), F.lit("\n")).alias("second"), F.col("f")[2].alias("third"))


def _dealt(spark, rows, key):
    """Rows dealt over all shuffle partitions: small as they are read, often by one task, and long to work on."""
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


@REGISTER("wb_rtf_runs", "SELECT p_partkey::VARCHAR AS path, i AS run, CASE i WHEN 0 THEN p_name || ' ' WHEN 1 THEN p_brand ELSE p_type END AS text, i = 1 AND p_size % 2 = 0 AS bold, CASE WHEN i = 1 THEN p_size / 2.0::DOUBLE ELSE 12.0 END AS size, CASE WHEN i = 1 THEN '00FF10' END AS colour, CASE WHEN i = 2 THEN 'http://x.org/' || p_partkey END AS link FROM part, (VALUES (0), (1), (2)) v(i) WHERE p_size > 0")
def rtf_runs(spark, d):
    head, i = r"{\rtf1\ansi{\colortbl;\red0\green255\blue16;}", F.col("p_partkey").cast("string")
    bold = F.when(F.col("p_size") % 2 == 0, r"{\b").otherwise("{")
    text = F.concat(F.lit(head), "p_name", F.lit(" "), bold, F.lit(r"\cf1\fs"), F.col("p_size").cast("string"), F.lit(" "), "p_brand", F.lit(r'}{\field{\*\fldinst{HYPERLINK "http://x.org/'), i, F.lit(r'"}}{\fldrslt{'), "p_type", F.lit("}}}}"))
    files = _dealt(spark, read(spark, d, "part").where("p_size > 0"), "p_partkey").select(i.alias("path"), F.encode(text, "UTF-8").alias("content"))
    return parsed(files, rtf.RUNS, rtf.read_runs).select("path", "run", "text", "bold", "size", "colour", "link")


_NS = 'xmlns:w="w" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="a" xmlns:p="p"'
_RELS = '<Relationships xmlns="x">{}</Relationships>'


def _zipped(files, parts):
    """Rows of ``path, name, brand, size`` as packages, 500 a frame; ``parts`` gives a row's parts by name."""
    import io
    import zipfile

    def packed(row) -> bytes:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for part, text in parts(*row).items():
                z.writestr(part, text)
        return held.getvalue()

    def made(frames):
        for frame in frames:
            for i in range(0, len(frame), 500):
                part = frame.iloc[i : i + 500]
                yield pd.DataFrame({"path": part["path"], "content": [packed(row) for row in part[["path", "name", "brand", "size"]].itertuples(index=False, name=None)]})

    return files.mapInPandas(made, "path string, content binary")


def _files(spark, d):
    return _dealt(spark, read(spark, d, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("path"), F.regexp_replace("p_name", "[&<>]", "").alias("name"), F.regexp_replace("p_brand", "[&<>]", "").alias("brand"), F.col("p_size").cast("int").alias("size"))


def _docx_parts(path, name, brand, size):
    rel = '<Relationship Id="{}" Type="t/{}" Target="{}"/>'.format
    styles = (
        f'<w:styles {_NS}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="20"/><w:color w:val="111111"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:rPr><w:i/></w:rPr></w:style>'
        '<w:style w:type="paragraph" w:styleId="H"><w:basedOn w:val="N"/><w:rPr><w:b/><w:sz w:val="40"/></w:rPr></w:style><w:style w:type="character" w:styleId="C"><w:rPr><w:u/><w:i w:val="0"/></w:rPr></w:style></w:styles>'
    )
    style = '<w:pPr><w:pStyle w:val="H"/></w:pPr>' if size % 2 else ""
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> HYPERLINK "u:{}" </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>{}</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'.format(size, brand)
    body = f'<w:document {_NS}><w:body><w:p>{style}<w:r><w:t>{name}</w:t></w:r><w:r><w:rPr><w:rStyle w:val="C"/><w:sz w:val="{size}"/><w:vanish w:val="0"/></w:rPr><w:t>{path}</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>gone</w:t></w:r>{field}</w:p></w:body></w:document>'
    return {"_rels/.rels": _RELS.format(rel("a", "officeDocument", "word/document.xml")), "word/document.xml": body, "word/_rels/document.xml.rels": _RELS.format(rel("s", "styles", "styles.xml")), "word/styles.xml": styles}


@REGISTER(
    "wb_docx_runs",
    """SELECT p_partkey::VARCHAR AS path, i AS run, CASE i WHEN 0 THEN p_name WHEN 1 THEN p_partkey::VARCHAR ELSE p_brand END AS text, p_size % 2 = 1 AS bold, i <> 1 AS italic, CASE WHEN i = 1 THEN 'single' END AS underline,
      CASE WHEN i = 1 THEN p_size / 2.0::DOUBLE WHEN p_size % 2 = 1 THEN 20.0 ELSE 10.0 END AS size, '111111' AS colour, CASE WHEN i = 2 THEN 'u:' || p_size END AS link FROM part, (VALUES (0), (1), (2)) v(i)""",
)
def docx_runs(spark, d):
    return parsed(_zipped(_files(spark, d), _docx_parts), docx.RUNS, docx.read_runs).select("path", "run", "text", "bold", "italic", "underline", "size", "colour", "link")


def _pptx_parts(path, name, brand, size):
    rel = '<Relationship Id="{}" Type="t/{}" Target="{}"/>'.format

    def sp(ph: str, text: str, at: int | None = None) -> str:
        box = "" if at is None else f'<a:xfrm><a:off x="{at}" y="{at + 1}"/><a:ext cx="100" cy="50"/></a:xfrm>'
        return f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{box}</p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"

    def tree(kind: str, shapes: str) -> str:
        return f"<p:{kind} {_NS}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:{kind}>"

    slide = sp('<p:ph type="ctrTitle"/>', name) + sp('<p:ph idx="7"/>', brand) + sp("", path, size)
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc rowSpan=\"2\"><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></a:tc><a:tc/></a:tr><a:tr><a:tc vMerge=\"1\"/><a:tc/></a:tr></a:tbl></p:graphicFrame>".format(name)
    return {
        "_rels/.rels": _RELS.format(rel("a", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation {_NS}><p:sldIdLst><p:sldId id="1" r:id="s1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _RELS.format(rel("s1", "slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": tree("sld", slide + table),
        "ppt/slides/_rels/slide1.xml.rels": _RELS.format(rel("l", "slideLayout", "../slideLayouts/l.xml")),
        "ppt/slideLayouts/l.xml": tree("sldLayout", sp('<p:ph type="body" idx="7"/>', "", 1000 + size)),
        "ppt/slideLayouts/_rels/l.xml.rels": _RELS.format(rel("m", "slideMaster", "../slideMasters/m.xml")),
        "ppt/slideMasters/m.xml": tree("sldMaster", sp('<p:ph type="title"/>', "", 2000 + size) + sp('<p:ph type="body"/>', "", 3000)),
    }


@REGISTER(
    "wb_pptx_placed",
    """SELECT p_partkey::VARCHAR AS path, i AS pos, CASE WHEN i = 0 THEN 'TITLE' ELSE 'BODY' END AS type, CASE i WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_partkey::VARCHAR END AS text,
      (CASE i WHEN 0 THEN 2000 WHEN 1 THEN 1000 ELSE 0 END + p_size)::BIGINT AS x, CASE i WHEN 0 THEN 'master' WHEN 1 THEN 'layout' ELSE 'slide' END AS placed_by FROM part, (VALUES (0), (1), (2)) v(i)""",
)
def pptx_placed(spark, d):
    return parsed(_zipped(_files(spark, d), _pptx_parts), pptx.PLACED, pptx.read_placed).select("path", "pos", "type", "text", "x", "placed_by")


@REGISTER("wb_pptx_tables", "SELECT p_partkey::VARCHAR AS path, r, c, CASE WHEN r = 0 AND c = 0 THEN 2 ELSE 1 END AS rowspan, CASE WHEN r = 0 AND c = 0 THEN p_name ELSE '' END AS text FROM part, (VALUES (0, 0), (0, 1), (1, 1)) v(r, c)")
def pptx_tables(spark, d):
    return parsed(_zipped(_files(spark, d), _pptx_parts), pptx.TABLES, pptx.read_tables).select("path", "r", "c", "rowspan", "text")


@REGISTER(
    "fn_registered",
    "SELECT p_partkey, p_retailprice - 7 * floor(p_retailprice / 7) AS m, upper(left(p_type, 1)) || lower(substr(p_type, 2, 2)) AS t, CASE WHEN p_size % 5 >= 1 THEN substr(p_name, p_size % 5, 4) END AS part, p_size || ' kilograms' AS said FROM part",
)
def registered(spark, d):
    from ..registry import register

    register(spark)
    read(spark, d, "part").createOrReplaceTempView("folio_parts")
    return spark.sql("SELECT p_partkey, xl_mod(p_retailprice, 7) AS m, xl_proper(xl_left(p_type, 3)) AS t, xl_mid(p_name, cast(p_size % 5 AS INT), 4) AS part, sp_form(concat(p_size, 'kg')) AS said FROM folio_parts")


@REGISTER("fn_table_functions", "SELECT p_partkey::VARCHAR AS path, 'BODY' AS type, p_brand AS text FROM part WHERE p_size % 3 = 0")
def table_functions(spark, d):
    from ..registry import register

    register(spark)
    _zipped(_files(spark, d).where("size % 3 = 0"), _pptx_parts).createOrReplaceTempView("folio_decks")
    return spark.sql("SELECT path, t.type, t.text FROM folio_decks, LATERAL pptx_placed(content) t WHERE t.placed_by = 'layout'")


@REGISTER(
    "ly_word_at_documents",
    rf"""WITH w AS (SELECT doc_id AS page, pos, w AS text, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(w) - 1)::INTEGER AS start FROM ({_SAID})),
    a AS (SELECT doc_id AS page, (doc_id * 31 % 1000 * k)::INTEGER AS "offset", k FROM documents, (VALUES (0), (1), (3)) v(k))
    SELECT a.page, a.k, text AS word, start FROM a ASOF LEFT JOIN w ON a.page = w.page AND a."offset" >= w.start""",
)
def word_at(spark, d):
    docs = _dealt(spark, read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    words = T.word_rows(docs, [F.col("doc_id").alias("page")], "text").select("page", "pos", F.lit(0).alias("line"), F.col("word").alias("text"), F.lit(False).alias("starts"))
    asked = docs.select(F.col("doc_id").alias("page"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("k"))
    asked = asked.withColumn("offset", (F.col("page") * 31 % 1000 * F.col("k")).cast("int"))
    return layout.word_at(layout.page_words(words), asked).select("page", "k", "word", "start")


@REGISTER("in_json_accessors", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.5' WHEN 2 THEN 'true' ELSE p_name END AS t,
  CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 0.5 WHEN 2 THEN 1 ELSE -1 END::DOUBLE AS n, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 WHEN 2 THEN 1 ELSE -1 END::INTEGER AS i,
  CASE p_partkey % 4 WHEN 0 THEN p_size <> 0 ELSE true END AS f, p_size::DOUBLE AS s FROM part""")
def json_accessors(spark, d):
    from ..functions import json

    i, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    member = F.when(i == 0, size).when(i == 1, F.concat(size, F.lit(".5"))).when(i == 2, "true").otherwise(F.concat(F.lit('"'), F.regexp_replace("p_name", '["\\\\]', ""), F.lit('"')))
    v = F.parse_json(F.concat(F.lit('{"m": '), member, F.lit(', "s": " '), size, F.lit('"}')))
    t = read(spark, d, "part").select("p_partkey", v.alias("v"))
    c = F.col("v")
    return t.select("p_partkey", json.text(c, "m").alias("t"), json.number(c, "m", -1).alias("n"), json.integer(c, "m", -1).alias("i"), json.flag(c, "m").alias("f"), json.number(c, "s").alias("s"))


@REGISTER("dc_usable_packs", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey)::INTEGER AS priority FROM (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0 AND abs(s_acctbal) * 10000 <= 62914560 ORDER BY 1 LIMIT 12)")
def usable_packs(spark, d):
    t = read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3 > 0).alias("enabled"), F.col("s_suppkey").alias("position"), (F.abs("s_acctbal") * 10000).alias("bytes"))
    return Dict.usable(t).select("s_suppkey", "priority")


@REGISTER("st_generations", "SELECT event_id FROM (SELECT event_id, event_id // 100 AS g, max(event_id // 100) OVER (PARTITION BY user_id) AS newest FROM events) WHERE g = newest")
def generations(spark, d):
    from ..operators import state

    t = read(spark, d, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 100).alias("generation"))
    return state.latest_generation(t, "user_id", "generation").select("event_id")


@REGISTER("st_kept_statistics", "SELECT p_partkey::VARCHAR AS key, list_value('N', 'D', 'H')[p_partkey % 3 + 1] AS tag, p_retailprice AS first, (p_size % 5)::DOUBLE AS second FROM part WHERE p_partkey % 4 < 3 AND (p_partkey % 3 = 2 OR (p_retailprice > 5 AND p_retailprice < 600 AND p_size % 5 > 0))")
def kept_statistics(spark, d):
    from ..operators import state

    i = F.col("p_partkey")
    tag = F.when(i % 4 == 3, "X").otherwise(F.element_at(F.array(F.lit("N"), F.lit("D"), F.lit("H")), (i % 3 + 1).cast("int")))
    t = read(spark, d, "part").select(tag.alias("tag"), F.array(i.cast("string"), F.col("p_retailprice").cast("string"), (F.col("p_size") % 5).cast("string")).alias("fields"))
    return state.kept_statistics(t).select("key", "tag", "first", "second")
