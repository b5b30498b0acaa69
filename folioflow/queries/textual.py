"""Text operators over documents, conversations and literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as Dict
from ..operators import ngram, ranking
from ..operators import textops as T
from .register import Register, read

REGISTER = Register()

_ARABIC = [(1, "الْكِتَابُ"), (2, "أحمد وإبراهيم وآدم"), (3, "مدرسة على"), (4, "كـــتاب"), (5, "Plain TEXT"), (6, "گل یک")]


@REGISTER("tx_normalize", "SELECT * FROM (VALUES (1, 'الكتاب'), (2, 'احمد وابراهيم وادم'), (3, 'مدرسه علي'), (4, 'كتاب'), (5, 'plain text'), (6, 'گل یک')) t(id, k)")
def normalize(spark, d):
    t = spark.createDataFrame(_ARABIC, "id int, s string")
    return t.select("id", T.search_key(F.col("s")).alias("k"))


@REGISTER("tx_dictionary_key", "SELECT * FROM (VALUES (1, 'الكتاب'), (2, 'احمد وابراهيم وادم'), (3, 'مدرسة على'), (4, 'كتاب'), (5, 'Plain TEXT'), (6, 'كل يك')) t(id, k)")
def dictionary_key(spark, d):
    t = spark.createDataFrame(_ARABIC, "id int, s string")
    return t.select("id", T.dictionary_key(F.col("s")).alias("k"))


@REGISTER(
    "tx_search_phrase",
    r"""WITH w AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, lower(unnest(ws)) AS k FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\s   ]+'), lambda x: x <> '') AS ws FROM documents)),
    h AS (SELECT doc_id, pos, contains(k, 'the') AND coalesce(contains(lead(k) OVER o, 'of'), false) AS hit FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    s AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) AS n FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM h WHERE hit))
    SELECT doc_id, pos::INTEGER AS first_pos FROM s WHERE n % 2 = 1""",
)
def phrase(spark, d):
    return T.find_phrase(T.word_rows(read(spark, d, "documents"), ["doc_id"], "text"), "the of", "doc_id", "pos", "word", limit=None)


_EN, _FR, _TR = (", ".join(f"'{w}'" for w in T.STOP_WORDS[k]) for k in ("en", "fr", "tr"))


@REGISTER(
    "tx_langid",
    rf"""WITH t AS (SELECT doc_id, lower(text) AS low FROM documents),
    s AS (SELECT doc_id, length(regexp_replace(low, '[^\p{{L}}]', '', 'g')) AS letters, string_split_regex(low, '[^\p{{L}}]+') AS ws,
      length(regexp_replace(low, '[^éèêàùçœ]', '', 'g')) AS fm, length(regexp_replace(low, '[^ğışİ]', '', 'g')) AS tm FROM t),
    c AS (SELECT doc_id, letters, len(list_filter(ws, lambda w: w IN ({_EN}))) AS en, 2 * len(list_filter(ws, lambda w: w IN ({_FR}))) + fm AS fr, 2 * len(list_filter(ws, lambda w: w IN ({_TR}))) + tm AS tr FROM s)
    SELECT doc_id, CASE WHEN greatest(en, fr, tr) * 400 > letters AND tr > en AND tr > fr THEN 'tr' WHEN greatest(en, fr, tr) * 400 > letters AND fr > en AND fr >= tr THEN 'fr' ELSE 'en' END AS lang FROM c""",
)
def langid(spark, d):
    return read(spark, d, "documents").select("doc_id", T.latin_language(F.col("text")).alias("lang"))


@REGISTER("tx_script_language", "SELECT * FROM (VALUES (1, 'ar'), (2, 'ar'), (3, 'ar'), (4, 'ar'), (5, 'en'), (6, 'ar')) t(id, lang)")
def script(spark, d):
    return spark.createDataFrame(_ARABIC, "id int, s string").select("id", T.script_language(F.col("s")).alias("lang"))


_CLASS_SQL = " ".join(f"WHEN regexp_matches(w, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in T.TOKEN_CLASSES)


@REGISTER(
    "tx_token_class",
    rf"SELECT kind, count(*)::BIGINT AS n FROM (SELECT CASE {_CLASS_SQL} ELSE 'other' END AS kind FROM (SELECT unnest(list_filter(string_split_regex(text, '[\s   ]+'), lambda x: x <> '')) AS w FROM documents)) GROUP BY 1",
)
def token_class(spark, d):
    words = T.word_rows(read(spark, d, "documents"), [], "text")
    return words.select(T.token_class(F.col("word")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@REGISTER("tx_token_class_literals", "SELECT * FROM (VALUES ('a@b.org','email'),('https://x.y','url'),('[12,13].','citation'),('3-5','range'),('20°C','degree'),('1)','list_mark'),('2.3.1','section'),('1,234.5','number'),('5kg','number_unit'),('word,','word'),('--','other')) t(w, kind)")
def token_literals(spark, d):
    t = spark.createDataFrame([(x,) for x in ("a@b.org", "https://x.y", "[12,13].", "3-5", "20°C", "1)", "2.3.1", "1,234.5", "5kg", "word,", "--")], "w string")
    return t.select("w", T.token_class(F.col("w")).alias("kind"))


_ABBR = "(?i)(^|[^\\p{L}])(" + "|".join(a.replace(".", "\\.") for a in T.ABBREVIATIONS) + ")\\.(\\s)"


@REGISTER(
    "tx_sentences",
    rf"""SELECT doc_id, count(*)::BIGINT AS n, max(length(s))::INTEGER AS longest FROM (SELECT doc_id, trim(replace(unnest(string_split(regexp_replace(regexp_replace(text, '{_ABBR}', '\1\2' || chr(1) || '\3', 'g'), '([.!?؟…]+["''”’)]*)\s+', '\1' || chr(2), 'g'), chr(2))), chr(1), '.')) AS s FROM documents) WHERE s <> '' GROUP BY 1""",
)
def sentences(spark, d):
    s = T.sentences(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.explode(s).alias("s")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).alias("longest"))


@REGISTER(
    "tx_paragraphs",
    r"SELECT doc_id, count(*)::BIGINT AS n, sum(length(p))::BIGINT AS chars FROM (SELECT doc_id, regexp_replace(unnest(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{2,}')), '^\s+|\s+$', '', 'g') AS p FROM documents) WHERE p <> '' GROUP BY 1",
)
def paragraphs(spark, d):
    p = read(spark, d, "documents").select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"))


@REGISTER("tx_clean", "SELECT * FROM (VALUES (1, '123'), (2, '4.5'), (3, 'item'), (4, 'ab')) t(id, t)")
def clean(spark, d):
    t = spark.createDataFrame([(1, "١٢٣"), (2, "۴٫۵"), (3, "• item".replace(" ", "")), (4, "a​b")], "id int, s string")
    return t.select("id", T.clean_token(F.col("s")).alias("t"))


@REGISTER("tx_bidi", "SELECT n_nationkey, chr(8207) || chr(8206) || n_name || chr(8206) || chr(8207) AS wrapped, n_name AS bare FROM nation")
def bidi(spark, d):
    w = T.bidi_wrap(F.col("n_name"))
    return read(spark, d, "nation").select("n_nationkey", w.alias("wrapped"), T.bidi_strip(w).alias("bare"))


@REGISTER("tx_first_strong", "SELECT * FROM (VALUES (1, 'rtl'), (2, 'rtl'), (3, 'rtl'), (4, 'rtl'), (5, 'ltr'), (6, 'rtl'), (7, NULL)) t(id, dir)")
def first_strong(spark, d):
    return spark.createDataFrame([*_ARABIC, (7, "123 !")], "id int, s string").select("id", T.first_strong(F.col("s")).alias("dir"))


@REGISTER("tx_html_escape", "SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'))::INTEGER AS n, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS h FROM pages")
def html_escape(spark, d):
    e = T.html_escape(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.length(e).alias("n"), F.md5(e).alias("h"))


@REGISTER("tx_safe_link", "SELECT page_id, regexp_matches(lower(trim(url)), '^(https?://|mailto:|tel:|#)') AS safe FROM pages")
def safe_link(spark, d):
    return read(spark, d, "pages").select("page_id", T.safe_link(F.col("url")).alias("safe"))


@REGISTER("tx_garbled_sanitized", "SELECT * FROM (VALUES (1, true, 'a      b'), (2, false, 'plain words'), (3, false, '')) t(id, bad, s)")
def garbled(spark, d):
    t = spark.createDataFrame([(1, "a\x01\x02\x03\x04b"), (2, "plain words"), (3, "")], "id int, s string")
    return t.select("id", T.garbled(F.col("s")).alias("bad"), T.sanitized(F.col("s")).alias("s"))


@REGISTER("tx_split_size", None)
def split_size(spark, d):
    parts = read(spark, d, "documents").select("doc_id", F.posexplode(T.split_to_size(F.col("text"), 1800)).alias("part", "t"))
    return parts.select("doc_id", "part", F.length("t").alias("n"))


@REGISTER("tx_top_words", r"SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '[\s   ]+'), lambda x: x <> '')) AS word FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_words(spark, d):
    return ranking.top_words(T.word_rows(read(spark, d, "documents"), [], "text"), 10)


# ---------------------------------------------------------------- dictionaries

_LINES = [
    ("base", 1, 1, "كتب\tكَتَبَ"), ("base", 1, 2, "عَلِمَ=علم"), ("base", 1, 3, "# note"), ("base", 1, 4, "مدرسة,مَدْرَسَة"), ("base", 1, 5, ""), ("base", 1, 6, "قلم\tكَلَم"),
    ("own", 2, 1, "علم\tعِلْم"), ("own", 2, 2, "أحمد\tأَحْمَد"), ("own", 2, 3, "احمد\tاحْمَدْ"), ("own", 2, 4, "من\tمِن"),
]


def _packs(spark):
    t = spark.createDataFrame(_LINES, "pack string, priority int, line_no int, line string")
    parsed = Dict.parse_lines(t)
    return parsed, parsed.where(Dict.valid_entry(F.col("plain"), F.col("shaped")))


@REGISTER("dc_parse", "SELECT * FROM (VALUES ('base', 1, 'كتب', 'كَتَبَ'), ('base', 2, 'علم', 'عَلِمَ'), ('base', 4, 'مدرسة', 'مَدْرَسَة'), ('base', 6, 'قلم', 'كَلَم'), ('own', 1, 'علم', 'عِلْم'), ('own', 2, 'أحمد', 'أَحْمَد'), ('own', 3, 'احمد', 'احْمَدْ'), ('own', 4, 'من', 'مِن')) t(pack, line_no, plain, shaped)")
def parse(spark, d):
    return _packs(spark)[0].select("pack", "line_no", "plain", "shaped")


@REGISTER("dc_merge", "SELECT * FROM (VALUES ('كتب', 'كَتَبَ', 1), ('علم', 'عِلْم', 2), ('مدرسة', 'مَدْرَسَة', 1), ('أحمد', 'أَحْمَد', 2), ('احمد', 'احْمَدْ', 2)) t(plain, shaped, priority)")
def merge(spark, d):
    return Dict.merge(_packs(spark)[1])


@REGISTER("dc_ambiguous", "SELECT * FROM (VALUES ('كتب', 'كَتَبَ', false), ('علم', 'عِلْم', false), ('مدرسة', 'مَدْرَسَة', false), ('احمد', NULL, true)) t(key, shaped, ambiguous)")
def ambiguous(spark, d):
    return Dict.keys(Dict.merge(_packs(spark)[1]))


def _cascade(spark):
    words = spark.createDataFrame([("كتب",), ("وكتب",), ("علمهم",), ("جديد",), ("شمس",), ("كتب",), ("مـدرسة",)], "word string")
    learned = spark.createDataFrame([("شمس", "شَمْس")], "plain string, shaped string")
    return Dict.cascade(words, learned, Dict.merge(_packs(spark)[1]))


@REGISTER("dc_cascade", "SELECT * FROM (VALUES ('كتب', 'كَتَبَ', 'EXACT'), ('وكتب', 'وكَتَبَ', 'CLITIC'), ('علمهم', 'عِلْمهم', 'SUFFIX'), ('جديد', NULL, 'UNKNOWN'), ('شمس', 'شَمْس', 'LEARNED'), ('مـدرسة', 'مَدْرَسَة', 'NORMALIZED')) t(word, shaped, kind)")
def cascade(spark, d):
    return _cascade(spark)


@REGISTER("dc_coverage", "SELECT 6::BIGINT AS words, 5::BIGINT AS known, 83::BIGINT AS percent")
def coverage(spark, d):
    return Dict.coverage(_cascade(spark))


@REGISTER("dc_pack_stats", "SELECT * FROM (VALUES ('base', 4::BIGINT, 3::BIGINT, 1::BIGINT, 1::BIGINT), ('own', 4::BIGINT, 3::BIGINT, 1::BIGINT, 0::BIGINT)) t(pack, lines, accepted, rejected, overridden)")
def pack_stats(spark, d):
    return Dict.pack_stats(_packs(spark)[0])


@REGISTER("dc_suggest", "SELECT DISTINCT a.w AS word, lower(n_name) AS entry FROM (VALUES ('chinna'), ('frence'), ('peruu'), ('iraq')) a(w), nation WHERE levenshtein(a.w, lower(n_name)) = 1")
def suggest(spark, d):
    words = spark.createDataFrame([("chinna",), ("frence",), ("peruu",), ("iraq",)], "word string")
    return Dict.suggestions(words, read(spark, d, "nation").select(F.lower("n_name").alias("plain")))


_NGRAM_SQL = """SELECT level, context, next, count(*)::BIGINT AS n FROM (
  SELECT l AS level, substr(t, i - l, l) AS context, substr(t, i, 1) AS next FROM (SELECT t, unnest(range(4, length(t) + 1)) AS i FROM (SELECT '^^^' || lower(p_name) AS t FROM part)), (VALUES (0), (1), (2), (3)) v(l)) GROUP BY 1, 2, 3"""


@REGISTER("dc_ngram_counts", _NGRAM_SQL)
def ngram_counts(spark, d):
    return ngram.contexts(read(spark, d, "part"), "p_name", longest=3)


@REGISTER("dc_ngram_top", f"SELECT level, context, next, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY level, context ORDER BY n DESC, next) AS rank FROM ({_NGRAM_SQL})) WHERE rank <= 3")
def ngram_top(spark, d):
    return ngram.top_classes(ngram.contexts(read(spark, d, "part"), "p_name", longest=3)).select("level", "context", "next", "n", "rank")


@REGISTER("dc_ngram_predict", None)
def ngram_predict(spark, d):
    fitted = ngram.model(ngram.contexts(read(spark, d, "part"), "p_name"))
    return ngram.predict(read(spark, d, "part").select("p_partkey", F.left("p_name", F.lit(6)).alias("prefix")), fitted, "prefix")
