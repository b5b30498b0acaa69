"""Text operators as native expressions: normalising, phrase search, language, tokens, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Arabic marks, the stretching letter and direction marks that search ignores.
MARKS = "ً-ٰٟـ‎‏‪-‮⁦-⁩"
RLM, LRM = "‏", "‎"

# Stop words by language, French and Turkish ones counting double.
STOP_WORDS = {
    "en": "the and of to in is that for it with as was on are by this be from".split(),
    "fr": "le la les des une est et dans pour que qui sur avec par pas au du".split(),
    "tr": "ve bir bu için ile olarak daha çok gibi ancak kadar olan".split(),
}
MARKERS = {"fr": "éèêàùçœ", "tr": "ğışİ"}


def search_key(s: Column) -> Column:
    """What search compares: no marks, hamza forms as bare alef, final forms as their neighbours, lower case."""
    bare = F.regexp_replace(s, f"[{MARKS}]", "")
    return F.lower(F.translate(bare, "أإآٱةى", "ااااهي"))


def unify_letters(s: Column) -> Column:
    """Persian and Urdu kaf and yeh as the Arabic letters."""
    return F.translate(s, "کڪګڬڭڮگڰڱیېۍ", "كككككككككييي")


def dictionary_key(s: Column) -> Column:
    return F.translate(F.regexp_replace(unify_letters(s), f"[{MARKS}]", ""), "أإآٱ", "اااا")


def find_phrase(words: DataFrame, phrase: str, page: str, position: str, word: str, limit: int | None = 500) -> DataFrame:
    """Places where consecutive words of a page each contain the words of ``phrase``: ``page, first_pos``, apart from each other.

    ``limit`` is the report's length, as a search box has one.
    """
    from pyspark.sql import Window

    parts = [p for p in phrase.split() if p]
    key = Window.partitionBy(page).orderBy(position)
    keyed = words.withColumn("__k", search_key(F.col(word)))
    hit = F.lit(bool(parts))
    for i, p in enumerate(parts):
        want = search_key(F.lit(p))
        hit = hit & F.coalesce((F.lead("__k", i).over(key) if i else F.col("__k")).contains(want), F.lit(False))
    hits = keyed.withColumn("__hit", hit).where("__hit").select(page, F.col(position).alias("first_pos"))
    if len(parts) > 1:
        # Only a run of hits closer than the phrase is long can overlap; within one the first is taken, and then each that starts after its end.
        gap = F.col("first_pos") - F.lag("first_pos").over(Window.partitionBy(page).orderBy("first_pos"))
        runs = hits.withColumn("__run", F.sum(F.when(gap < len(parts), 0).otherwise(1)).over(Window.partitionBy(page).orderBy("first_pos")))
        grouped = runs.groupBy(page, "__run").agg(F.sort_array(F.collect_list("first_pos")).alias("p"))
        taken = F.aggregate(
            "p",
            F.array().cast(grouped.schema["p"].dataType),
            lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(F.concat(F.array(x - len(parts)), a), -1) >= len(parts)), F.concat(a, F.array(x))).otherwise(a),
        )
        hits = grouped.select(page, F.explode(taken).alias("first_pos"))
    return hits.orderBy(page, "first_pos").limit(limit) if limit else hits


def phrase_report(words: DataFrame, phrase: str, page: str, position: str, word: str, limit: int = 500) -> DataFrame:
    """The first ``limit`` hits of a search box, each with whether there were more (``truncated``)."""
    first = find_phrase(words, phrase, page, position, word, limit + 1).persist()
    return first.orderBy(page, "first_pos").limit(limit).withColumn("truncated", F.lit(first.count() > limit))


def word_rows(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """One row a word, with its position."""
    return df.select(*keep, F.posexplode(F.filter(F.split(text, r"[\s   ]+"), lambda w: w != "")).alias("pos", "word"))


def latin_language(s: Column) -> Column:
    """English, French or Turkish by stop words and marker letters; English unless another scores more and enough."""
    low = F.lower(s)
    letters = F.length(F.regexp_replace(low, r"[^\p{L}]", ""))
    tokens = F.split(low, r"[^\p{L}]+")
    score = {}
    for lang, stops in STOP_WORDS.items():
        score[lang] = _stop_count(tokens, stops) * (1 if lang == "en" else 2)
        if lang in MARKERS:
            score[lang] = score[lang] + F.length(low) - F.length(F.translate(low, MARKERS[lang], ""))
    best = F.greatest(*score.values())
    enough = best * 400 > letters
    return F.when(enough & (score["tr"] == best) & (score["tr"] > score["en"]) & (score["tr"] > score["fr"]), "tr").when(enough & (score["fr"] == best) & (score["fr"] > score["en"]), "fr").otherwise("en")


def _stop_count(tokens: Column, stops: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(stops)))


def script_language(s: Column, default: str = "en") -> Column:
    """``ar`` if Arabic letters outnumber Latin ones."""
    arabic = F.length(F.regexp_replace(s, r"[^ؠ-يٱ-ۓ]", ""))
    latin = F.length(F.regexp_replace(s, r"[^A-Za-zÀ-ɏ]", ""))
    return F.when(arabic > latin, "ar").otherwise(default)


# Token classes by pattern, the first that fits.
TOKEN_CLASSES = (
    ("email", r"^[\w.+-]+@[\w-]+(\.[\w-]+)+[.,;:]?$"),
    ("url", r"(?i)^(https?://|www\.)\S+$"),
    ("citation", r"^\[\d+([,-]\d+)*\][.,;]?$"),
    ("range", r"^\d+(\.\d+)?[-–]\d+(\.\d+)?[.,;]?$"),
    ("degree", r"^-?\d+(\.\d+)?°[CF]?[.,;]?$"),
    ("list_mark", r"^(\d{1,2}|[A-Za-z])[.)]$"),
    ("section", r"^\d+(\.\d+){1,}[.]?$"),
    ("number", r"^[+-]?\d{1,3}(,\d{3})*(\.\d+)?[.,;:!?]?$|^[+-]?\d+(\.\d+)?[.,;:!?]?$"),
    ("number_unit", r"^\d+(\.\d+)?(kg|g|mg|km|m|cm|mm|ml|l|s|ms|h|hz|kb|mb|gb|%)[.,;]?$"),
    ("word", r"^[\p{L}][\p{L}\p{M}'’-]*[.,;:!?]*$"),
)


def token_class(t: Column) -> Column:
    chain = None
    for name, pattern in TOKEN_CLASSES:
        chain = F.when(t.rlike(pattern), name) if chain is None else chain.when(t.rlike(pattern), name)
    return chain.otherwise("other")


# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "mr mrs ms dr prof sr jr st vs etc e.g i.e fig no vol pp al".split()


def sentences(s: Column) -> Column:
    """Sentences of a text: cut after a stop and white space, not after an abbreviation."""
    guard = "(?i)(^|[^\\p{L}])(" + "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS) + ")\\.(\\s)"
    held = F.regexp_replace(s, guard, "$1$2\u0001$3")
    cut = F.split(F.regexp_replace(held, r"([.!?؟…]+[\"'”’)]*)\s+", "$1\u0002"), "\u0002")
    return F.filter(F.transform(cut, lambda x: F.trim(F.replace(x, F.lit("\u0001"), F.lit(".")))), lambda x: x != "")


def paragraphs(s: Column) -> Column:
    """Paragraphs: line ends made one, cut at blank lines, trimmed, empty ones dropped."""
    parts = F.split(F.regexp_replace(s, "\r\n?", "\n"), "\n{2,}")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def clean_token(t: Column) -> Column:
    """Invisible characters, private-use characters and bullets out; Arabic and Persian digits as ASCII."""
    bare = F.regexp_replace(t, r"[​-‏‪-‮⁠-⁤﻿-•▪●◦‣·]", "")
    return F.translate(bare, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬", "01234567890123456789.,")


def bidi_wrap(s: Column) -> Column:
    """Latin and digit runs wrapped so that they keep their place in right-to-left text."""
    return F.regexp_replace(s, r"([A-Za-z0-9][A-Za-z0-9 .,:/@_-]*[A-Za-z0-9]|[A-Za-z0-9])", f"{RLM}{LRM}$1{LRM}{RLM}")


def bidi_strip(s: Column) -> Column:
    return F.translate(s, RLM + LRM, "")


def first_strong(s: Column) -> Column:
    """Direction of the first letter: ``rtl``, ``ltr``, or null without one."""
    letter = F.regexp_extract(s, r"(\p{L})", 1)
    return F.when(letter == "", None).when(letter.rlike(r"[֐-ࣿיִ-﷿ﹰ-﻿]"), "rtl").otherwise("ltr")


def html_escape(s: Column) -> Column:
    out = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_link(url: Column) -> Column:
    return F.coalesce(F.lower(F.trim(url)).rlike(r"^(https?://|mailto:|tel:|#)"), F.lit(False))


def garbled(s: Column, share: float = 0.08) -> Column:
    """Whether replacement, private-use or control characters make up so large a share."""
    bad = F.length(s) - F.length(F.regexp_replace(s, r"[�-\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    return (F.length(s) > 0) & (bad >= F.length(s) * share)


def sanitized(s: Column) -> Column:
    """The same length, with controls, private-use characters and non-characters as blanks."""
    return F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f-﷐-﷯￾￿]", " ")


def split_to_size(s: Column, size: int = 1800) -> Column:
    """Paragraphs packed into batches of at most ``size`` characters, longer ones cut hard."""
    pieces = F.flatten(
        F.transform(
            paragraphs(s),
            lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda k: F.substring(p, k * size + 1, F.lit(size))),
        )
    )
    return F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.length(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))) + 1 + F.length(x) <= size),
            F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")), F.lit("\n"), x))),
        ).otherwise(F.concat(a, F.array(x))),
    )
