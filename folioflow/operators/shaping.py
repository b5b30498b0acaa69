"""Vowel marks of whole words, learned from a dictionary: counts of marks in contexts of letters and marks, joined to the windows of plain words.

Training is counting: every letter of every marked word says in six contexts, from the most to the least particular, which mark it bears.
A context gives each mark a share, and a word's confidence is the product of the shares of its marks; the shares of all ways to mark a
word sum to one.  A word is shaped whole or not at all, with over ``sure`` of that sum on one way.  As ``sure`` is over a half, the way
wanted is at every letter the one with most of the sum so far, so a context is asked for its commonest mark only: a row a context, no model
in the driver, no bound on contexts.  The letters of a context are known before any mark is, so all windows of a word meet the
contexts in one join; what they say about marks said before comes as a small map (at most the square of ``MARKS``), and a fold reads the marks off.

A shaped word must be sayable, which is one pattern, and keep its letters.  The last letter bears no mark, as its mark depends on the sentence.

Defined results
    null, empty, other scripts, under 3 or over 15 letters     not shaped; in training passed over
    repeated rows                                              asked once, one result row each; in training they count as often
    ties                                                       no mark has over half of the sum: not shaped
    empty tables                                               no word is shaped
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may stand after a letter.
SHADDA, SUKUN, SHORT, DOUBLE = "ّ", "ْ", "َُِ", "ًٌٍ"
MARKS = ("", *SHORT, SUKUN, SHADDA, *(SHADDA + v for v in SHORT), *DOUBLE)
# What each context sees, the most particular first (letters from and to, seen from the letter itself; whether it sees that the letter
# is the first or last to bear a mark; how many marks said before), and the examples it needs.
CONTEXTS = ((-1, 2, False, 2), (-1, 2, True, 1), (-1, 2, False, 0), (-1, 1, True, 1), (-1, 1, True, 0), (0, 1, True, 0))
SUPPORT = (3, 3, 4, 5, 10, 40)
LEAST, MOST = 3, 13
SURE, OWN_WEIGHT, SMOOTH = 0.80, 6, 0.02
_SUN = "تثدذرزسشصضطظلن"
_EDGE, _LETTER, _MARK = "^", "[ء-ي]", "[ً-ْ]"
_SILENT = f"(?:{_LETTER}{SUKUN}|[ء-ي&&[^اويى]](?!{_MARK}))"
#: A silent first letter; a marked bare alef; two silent letters in turn; a long vowel, not first, without its short one before it.
UNSAYABLE = "|".join([f"^[^ا](?:{SUKUN}|(?!{_MARK}))", f"ا{_MARK}", _SILENT + _SILENT, f"(?<=.)(?<![ًَ])ا(?!{_MARK})", f"(?<=.)(?<!ُ)و(?!{_MARK})", f"(?<=.)(?<!ِ)ي(?!{_MARK})"])


def _composed(word: Column) -> Column:
    """Letters with hamza or madda as one character each, stretching dropped."""
    for letter, sign, whole in (("ا", "ٓ", "آ"), ("ا", "ٔ", "أ"), ("ا", "ٕ", "إ"), ("و", "ٔ", "ؤ"), ("ي", "ٔ", "ئ")):
        word = F.regexp_replace(word, f"{letter}([ً-ْ]*){sign}", f"{whole}$1")
    return F.replace(word, F.lit("ـ"), F.lit(""))


def _kind(marks: Column) -> Column:
    """One of ``MARKS``: doubling and the first vowel sign, in the order of their code points."""
    vowel = F.coalesce(F.array_min(F.regexp_extract_all(marks, F.lit(f"[{DOUBLE}{SHORT}{SUKUN}]"), F.lit(0))), F.lit(""))
    return F.when(~marks.contains(SHADDA), vowel).when(vowel.isin(*SHORT), F.concat(F.lit(SHADDA), vowel)).otherwise(SHADDA)


def parted(shaped: Column) -> Column:
    """Letters of a word with the mark after each, the article taken off; null for what is no marked Arabic word of enough letters."""
    plain = _composed(shaped)
    units = F.regexp_extract_all(plain, F.lit(f"{_LETTER}[ً-ْٰ]*"), F.lit(0))
    found = F.transform(units, lambda u: F.struct(F.left(u, F.lit(1)).alias("letter"), _kind(u).alias("mark")))
    article = (F.size(found) >= 5) & (F.get(found, F.lit(0))["letter"] == "ا") & (F.get(found, F.lit(1))["letter"] == "ل")
    # The doubling of a sun letter is the article's.
    bared = F.transform(F.slice(found, 3, F.size(found)), lambda u, i: F.when((i == 0) & u["letter"].isin(*_SUN), u.withField("mark", F.replace(u["mark"], F.lit(SHADDA), F.lit("")))).otherwise(u))
    rest = F.when(article, bared).otherwise(found)
    return F.when(plain.rlike(f"^(?:{_LETTER}[ً-ْٰ]*)+$") & (F.size(rest) >= LEAST), rest)


def _windows(letters: Column, i: Column) -> list[Column]:
    """What each context sees of the letters around the ``i``-th."""
    padded = F.concat(F.array(F.lit(_EDGE)), letters, F.array(F.lit(_EDGE), F.lit(_EDGE)))
    place = F.concat(F.when(i == 0, "s").otherwise(""), F.when(i == F.size(letters) - 2, "e").otherwise(""))
    seen = [F.array_join(F.slice(padded, i + (2 + a), F.lit(b - a + 1)), "") for a, b, _, _ in CONTEXTS]
    return [F.concat(F.lit(f"{level}|"), s, F.lit("|"), place if placed else F.lit("")) for level, (s, (_, _, placed, _)) in enumerate(zip(seen, CONTEXTS, strict=True))]


def _said(last: Column, before: Column) -> list[Column]:
    """What each context sees of the marks said before."""
    return [F.concat_ws("|", *(last, before)[:marks]) for *_, marks in CONTEXTS]


def counts(words: DataFrame, shaped: str = "shaped") -> DataFrame:
    """``window, said, mark, n`` over all marked words."""
    parts = words.select(parted(F.col(shaped)).alias("u")).where(F.size("u") <= MOST + 2)
    rows = parts.select(F.col("u.letter").alias("letters"), F.concat(F.array(F.lit(_EDGE), F.lit(_EDGE)), F.col("u.mark")).alias("marks"))
    rows = rows.select("letters", "marks", F.explode(F.sequence(F.lit(0), F.size("letters") - 2)).alias("i"))
    last, before = F.get("marks", F.col("i") + 1), F.get("marks", F.col("i"))
    seen = F.array(*(F.struct(w.alias("window"), s.alias("said")) for w, s in zip(_windows(F.col("letters"), F.col("i")), _said(last, before), strict=True)))
    return rows.select(F.get("marks", F.col("i") + 2).alias("mark"), F.inline(seen)).groupBy("window", "said", "mark").agg(F.count("*").alias("n"))


def table(found: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``window, marks``: of every context that has its support, by the marks said before, the commonest mark and its share.  A user's ``own`` counts weigh ``OWN_WEIGHT`` times."""
    if own is not None:
        found = found.unionByName(own.withColumn("n", F.col("n") * OWN_WEIGHT)).groupBy("window", "said", "mark").agg(F.sum("n").alias("n"))
    need = F.element_at(F.array(*map(F.lit, SUPPORT)), F.substring("window", 1, 1).cast("int") + 1)
    held = found.groupBy("window", "said").agg(F.sum("n").alias("total"), F.max(F.struct("n", "mark")).alias("top")).where(F.col("total") >= need)
    share = (F.col("top.n") + SMOOTH) / (F.col("total") + SMOOTH * len(MARKS))
    return held.groupBy("window").agg(F.map_from_entries(F.collect_list(F.struct("said", F.struct(F.col("top.mark").alias("mark"), share.alias("share"))))).alias("marks"))


def sayable(spelled: Column) -> Column:
    """Whether a marked word, its last letter bare and left out of account, can be said: see ``UNSAYABLE``."""
    return ~F.substring(spelled, F.lit(1), F.length(spelled) - 1).rlike(UNSAYABLE)


def guesses(words: DataFrame, known: DataFrame, word: str = "word", sure: float = SURE) -> DataFrame:
    """``word, guess, confidence`` of every distinct word that is shaped; ``sure`` is over a half."""
    if not 0.5 < sure <= 1:
        raise ValueError("sure must be over a half: only then is there one way at most to mark a word")
    name, levels = F.col("word"), len(CONTEXTS)
    article = (F.length(name) >= 5) & name.startswith("ال")
    letters = F.regexp_extract_all(F.when(article, F.substring(name, F.lit(3), F.length(name))).otherwise(name), F.lit("."), F.lit(0))
    asked = words.select(F.col(word).alias("word")).where(name.rlike(f"^[ء-غف-ي]{{{LEAST},{MOST + 2}}}$")).distinct()
    placed = asked.select("word", letters.alias("letters")).select("word", "letters", F.explode(F.sequence(F.lit(0), F.size("letters") - 2)).alias("i"))
    placed = placed.select("word", F.col("i"), F.posexplode(F.array(*_windows(F.col("letters"), F.col("i")))).alias("level", "window"))
    met = placed.join(known, "window").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") * levels + F.col("level")).alias("k"), "marks"))).alias("held"))  # at most 6 a letter

    def step(said: Column, i: Column) -> Column:
        marks = said["marks"]
        keys = _said(F.element_at(marks, -1), F.element_at(marks, -2))
        best = F.coalesce(*(F.try_element_at(F.try_element_at(F.col("held"), i * levels + level), k) for level, k in enumerate(keys)))
        return F.struct((said["share"] * F.coalesce(best["share"], F.lit(0.0))).alias("share"), F.concat(marks, F.array(F.coalesce(best["mark"], F.lit("")))).alias("marks"))

    start = F.struct(F.lit(1.0).alias("share"), F.array(F.lit(_EDGE), F.lit(_EDGE)).alias("marks"))
    read = met.select("word", article.alias("article"), letters.alias("letters"), F.aggregate(F.sequence(F.lit(0), F.size(letters) - 2), start, step).alias("way"))
    read = read.where(F.col("way.share") >= sure)
    units = F.zip_with("letters", F.slice("way.marks", 3, MOST + 2), lambda c, m: F.concat(c, F.coalesce(m, F.lit(""))))
    read = read.select("word", "article", F.get("letters", F.lit(0)).alias("head"), F.get("way.marks", F.lit(2)).alias("mark"), F.array_join(units, "").alias("spelled"), F.col("way.share").alias("confidence"))
    sun = F.col("head").isin(*_SUN)
    # A sun letter is doubled after the article, which only a letter with a short vowel can be.
    doubled = F.when(F.col("mark").contains(SHADDA), F.col("spelled")).when(F.col("mark").isin(*SHORT), F.concat("head", F.lit(SHADDA), F.substring("spelled", F.lit(2), F.length("spelled"))))
    whole = F.when(~F.col("article"), F.col("spelled")).when(sun, F.concat(F.lit("ال"), doubled)).otherwise(F.concat(F.lit("ال" + SUKUN), F.col("spelled")))
    return read.where(sayable(F.col("spelled"))).select("word", whole.alias("guess"), "confidence").where("guess is not null")


def predicted(words: DataFrame, known: DataFrame, word: str = "word", sure: float = SURE) -> DataFrame:
    """``words`` with ``guess`` and ``confidence``, null where a word is left as it is."""
    found = guesses(words, known, word, sure).withColumnRenamed("word", "__w")
    return words.drop("guess", "confidence").join(found, F.col(word) == F.col("__w"), "left").drop("__w")
