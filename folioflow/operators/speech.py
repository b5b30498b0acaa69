"""Preparing text to be read aloud: marks in order, scripts apart, tokens rewritten, pieces of bounded size.

What needs only the text itself is native.  Unicode normalisation and folds over
neighbouring tokens run in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .running import running_sums

# Vowel marks in the order they are written after a letter, doubling first.
MARK_ORDER = "ّٰٕٓٔ" + "ًٌٍَُِ" + "ْ"
_RANK = {c: i for i, c in enumerate(MARK_ORDER)}
_MARK_RUN = re.compile(f"[{MARK_ORDER}]{{2,}}")
# Letters of neighbouring alphabets and the Arabic letters nearest to them.
FOREIGN = dict(zip("پچژگڤڨٹڈڑںھہۂۃےیک", "بجزكفقتدرنههههييك", strict=True))
# Letters that a skeleton leaves out.
WEAK = "اوىيءأإآؤئةه"
# Units and what is said for them.
UNITS = {
    "kg": "kilograms", "g": "grams", "mg": "milligrams", "km": "kilometres", "m": "metres", "cm": "centimetres", "mm": "millimetres", "l": "litres", "ml": "millilitres", "s": "seconds", "ms": "milliseconds",
    "h": "hours", "min": "minutes", "hz": "hertz", "khz": "kilohertz", "mhz": "megahertz", "ghz": "gigahertz", "kb": "kilobytes", "mb": "megabytes", "gb": "gigabytes", "w": "watts", "kw": "kilowatts", "v": "volts", "%": "percent",
}
GREEK = dict(zip("αβγδεθλμπσφω", "alpha beta gamma delta epsilon theta lambda mu pi sigma phi omega".split(), strict=True))
SHORT = {"e.g.": "for example", "i.e.": "that is", "etc.": "and so on", "vs.": "versus", "fig.": "figure", "no.": "number", "dr.": "doctor", "prof.": "professor"}


def order_marks(s: str) -> str:
    """Marks of each letter in written order, once each."""
    return _MARK_RUN.sub(lambda m: "".join(sorted(set(m[0]), key=_RANK.__getitem__)), s)


def normalised(s: str | None) -> str | None:
    """Composed form, marks in order."""
    return None if s is None else order_marks(unicodedata.normalize("NFC", s))


def tanween_before_alef(s: str) -> str:
    """A double vowel written after a closing alef goes before it."""
    return re.sub("ا(ً)(?=\\W|$)", "\\1ا", s)


_SUN = "تثدذرزسشصضطظلن"


def article(s: str) -> str:
    """After the article a sun letter is doubled and the article's lam is silent; before a moon letter it has a sukun."""

    def fix(m: re.Match) -> str:
        head, letter, marks = m[1], m[2], m[3]
        if letter in _SUN:
            return f"{head}ل{letter}" + ("" if "ّ" in marks else "ّ") + marks
        return f"{head}لْ{letter}{marks}"

    return re.sub(f"(?<!\\w)(ا|وا|بِا|كا|فا)لْ?([ء-ي])([{MARK_ORDER}]*)(?=\\w)", fix, s)


def pausal(word: str) -> str:
    """A word as said before a pause: final short vowels fall, a final ta marbuta is said as ha, a final an is kept as a."""
    if word.endswith("ًا"):
        return word[:-2] + "َا"
    bare = re.sub("[ًٌٍَُِْ]+$", "", word)
    return bare[:-1] + "ه" if bare.endswith("ة") else bare + "ْ" if bare and bare != word and bare[-1] not in "اوي" else bare


def skeleton(s: str) -> str:
    """Sorted consonants without weak letters and marks."""
    return "".join(sorted(c for c in s if c.isalpha() and c not in WEAK))


def lost_letters(original: str, shaped: str) -> str:
    """Consonants of the original that the shaped form lacks, however often."""
    rest = list(skeleton(shaped))
    out = []
    for c in skeleton(original):
        if c in rest:
            rest.remove(c)
        else:
            out.append(c)
    return "".join(out)


def glyph_text(s: str) -> str:
    """Presentation forms as plain letters; zero-width, direction and stretching characters out; no blank before a mark."""
    plain = "".join(unicodedata.normalize("NFKC", c) if "ﭐ" <= c <= "﻿" else c for c in s)
    plain = re.sub("[​-‏‪-‮⁦-⁩﻿ـ\x00-\x08\x0b\x0c\x0e-\x1f]", "", plain)
    return re.sub(f" (?=[{MARK_ORDER}])", "", plain)


def logical_word(visual: str) -> str:
    """A right-to-left word from its visual order: units (a letter with its marks) reversed, left-to-right runs kept."""
    if not re.search("[֐-ࣿ]", visual):
        return visual
    units = re.findall(f"[A-Za-z0-9][A-Za-z0-9.,:/%-]*[A-Za-z0-9]|.[{MARK_ORDER}]*", visual, re.S)
    return "".join(reversed(units))


def scripts(s: str) -> list[tuple[int, int, str]]:
    """``(start, end, script)`` of Arabic, Latin and digit runs; a lone Arabic letter does not split a token."""
    runs = [(m.start(), m.end(), "ar" if "؀" <= m[0][0] <= "ۿ" and not m[0][0].isdigit() else "num" if m[0][0].isdigit() else "lat") for m in re.finditer("[؀-ٟ٪-ۯ]+|[A-Za-zÀ-ɏ]+|[0-9٠-٩]+", s)]
    arabic = sum(e - b for b, e, k in runs if k == "ar")
    return runs if arabic >= 2 else [(b, e, "lat" if k == "ar" else k) for b, e, k in runs]


def speech_form(token: str) -> str:
    """What is said for a token: addresses and citations nothing, ranges, units, Greek letters, short forms and initials in words."""
    low = token.lower()
    if re.fullmatch(r"(https?://|www\.)\S+|[\w.+-]+@[\w-]+(\.[\w-]+)+[.,;:]?", low) or re.fullmatch(r"\[\d+([,–-]\d+)*\][.,;]?", low):
        return ""
    if low in SHORT:
        return SHORT[low]
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)[-–](\d+(?:\.\d+)?)([a-z%]*)", low):
        return f"{m[1]} to {m[2]}" + (f" {UNITS[m[3]]}" if m[3] in UNITS else m[3])
    if (m := re.fullmatch(r"([±+-]?)(\d+(?:\.\d+)?)([a-z%]+)", low)) and m[3] in UNITS:
        return {"±": "plus or minus ", "+": "plus ", "-": "minus ", "": ""}[m[1]] + f"{m[2]} {UNITS[m[3]]}"
    if m := re.fullmatch(r"([^\W\d]+)/([^\W\d]+)", token):
        return f"{m[1]} per {m[2]}" if m[2].lower() in UNITS else f"{m[1]} or {m[2]}"
    if len(token) == 1 and low in GREEK:
        return GREEK[low]
    if re.fullmatch("[A-Z]{2,5}", token) and not re.search("[AEIOUY]", token):
        return " ".join(token)
    return token


#: Characters of texts whose results a task's Python holds at once; a longer text stands alone.
HELD = 1 << 20


def _udf(f, kind):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            for part in _slices(b):
                yield pd.Series([None if x is None else f(x) for x in part], dtype=object)

    return F.pandas_udf(run, kind)


def _slices(texts: pd.Series, most: int | None = None) -> Iterator[pd.Series]:
    """A batch in pieces of at most ``most`` characters or one text: results are many times as large as the texts, and a batch is bounded in rows alone."""
    first, size, most = 0, 0, most or HELD
    for i, x in enumerate(texts):
        n = 0 if x is None else len(x)
        if i > first and size + n > most:
            yield texts.iloc[first:i]
            first, size = i, 0
        size += n
    yield texts.iloc[first:]


def applied(name: str, column: Column) -> Column:
    """One of the word functions above over a column."""
    return _udf(_WORDS[name], StringType())(column)


_WORDS = {"normalised": normalised, "tanween": tanween_before_alef, "article": article, "pausal": pausal, "skeleton": skeleton, "glyph": glyph_text, "logical": logical_word, "speech": speech_form}


def series_function(name: str, kind):
    """The same as a function that can be registered for SQL."""
    f = _WORDS[name]

    def run(words: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in words], dtype=object)

    return F.pandas_udf(run, kind)


def script_runs(column: Column) -> Column:
    kind = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("script", StringType())]))
    return _udf(scripts, kind)(column)


def foreign_letters(s: Column) -> Column:
    return F.translate(s, "".join(FOREIGN), "".join(FOREIGN.values()))


_TOKEN = re.compile("[^\\s\u00a0\u202f\u2007]+")
_BLANKS = [i for i in range(0x10000) if not _TOKEN.match(chr(i))]  # there is none beyond
_OFFSETS = ArrayType(StructType([StructField("token", StringType()), StructField("start", IntegerType())]))


def with_offsets(s: Column) -> Column:
    """Tokens and where each starts in the text, blanks of all kinds between them."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for part in _slices(pd.Series(b.to_pylist(), dtype=object)):
                yield _tokens(part.tolist())

    return F.arrow_udf(run, _OFFSETS)(s)


def _tokens(texts: list[str | None]) -> pa.Array:
    """Tokens of all the texts at once, as arrays: a token is what is left between blanks, in letters and in bytes."""
    sizes = np.array([0 if x is None else len(x) for x in texts], dtype=np.int64)
    ends, whole = np.cumsum(sizes), "".join(x for x in texts if x)
    begins, code = ends - sizes, np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    blank = np.zeros(0x10001, dtype=bool)
    blank[_BLANKS] = True
    word = ~blank[np.minimum(code, 0x10000)]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[begins[sizes > 0]] = word[begins[sizes > 0]]
    starts = np.flatnonzero(first)
    of = np.searchsorted(ends, starts, side="right")
    width = (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)).astype(np.int8)
    letters = np.frombuffer(whole.encode(), np.uint8)[np.repeat(word, width)]
    upto = np.cumsum(width * word, dtype=np.int64)
    cuts = np.append(upto[starts] - width[starts], len(letters)).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(letters))
    rows = pa.StructArray.from_arrays([tokens, pa.array((starts - begins[of]).astype(np.int32))], ["token", "start"])
    counts = np.bincount(of, minlength=len(texts)) if len(texts) else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), rows)


#: Characters of a block, as a power of two.
_BLOCK = 8


def text_blocks(s: Column) -> Column:
    """A text in blocks, in which ``text_at`` finds a place without a walk through all before it."""
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{1 << _BLOCK}}}"), F.lit(0))


def text_at(blocks: Column, start: Column, length: Column) -> Column:
    """So many characters from a place on, of at least one."""
    rest = start.bitwiseAND((1 << _BLOCK) - 1)
    held = F.slice(blocks, F.shiftright(start, _BLOCK) + 1, F.shiftright(rest + length - 1, _BLOCK) + 1)
    return F.substring(F.array_join(held, ""), rest + 1, length)


def language_runs(tokens: DataFrame, doc: str = "doc_id", pos: str = "pos", token: str = "word") -> DataFrame:
    """Runs of one language: numbers take that of the token before, or the first one after at the start.

    No window looks from each token to the end of its text, which would take the square of the text's length.
    """
    t = F.col(token)
    own = F.when(t.rlike("[ء-ي]"), True).when(t.rlike("[A-Za-zÀ-ɏ]"), False)  # whether it is Arabic; null if neither
    w = Window.partitionBy(doc).orderBy("first")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = tokens.select(doc, F.col(pos).alias("first"), own.alias("__own"))
    last, opening = F.last("__own", ignorenulls=True).over(before), F.first("__own", ignorenulls=True).over(whole)
    rows = rows.select("*", F.coalesce(last, opening, F.lit(False)).alias("__last"), F.row_number().over(w).alias("__at"), F.count("*").over(whole).alias("__all"))
    arabic = F.coalesce("__own", "__last")
    starts = rows.where((F.col("__at") == 1) | (arabic != F.col("__last"))).withColumn("lang", F.when(arabic, "ar").otherwise("en"))
    by = Window.partitionBy(doc).orderBy("__at")
    end = F.coalesce(F.lead("__at").over(by), F.col("__all") + 1)
    return starts.select(doc, (F.row_number().over(by) - 1).cast("long").alias("run"), "lang", "first", (end - F.col("__at")).alias("n"))


_CUTS = [re.compile(p) for p in (r"[.!?؟]\s", r"[,;:،؛]\s", r"\s")]


def halved(s: str, most: int = 3300) -> list[str]:
    """Pieces of at most ``most`` bytes, each cut at the stop, clause or blank nearest to the middle."""
    out, rest = [], [s]
    while rest:
        held = rest.pop()
        if len(held.encode()) <= most:
            out += [held] if held.strip() else []
            continue
        middle = len(held) // 2
        for pattern in _CUTS:
            if cuts := [m.end() for m in pattern.finditer(held) if 0 < m.end() < len(held)]:
                at = min(cuts, key=lambda c: (abs(c - middle), c))
                rest += [held[at:].lstrip(), held[:at].rstrip()]
                break
        else:
            rest += [held[middle:], held[:middle]]
    return out


def speech_pieces(column: Column, most: int = 3300) -> Column:
    return _udf(lambda s: halved(s, most), ArrayType(StringType()))(column)


def joined_timeline(marks: DataFrame, part: str = "part", at: str = "at_ms", duration: str = "ms", chars: str = "chars") -> DataFrame:
    """Marks of consecutive parts on one line: each part moves by what the parts before last and hold."""
    ends = marks.groupBy(part).agg(F.max(F.col(at) + F.col(duration)).alias("__d"), F.sum(chars).alias("__c"))
    sums = running_sums(ends, part, {"__at": "__d", "__chars": "__c"})
    shift = sums.select(part, (F.col("__at") - F.col("__d")).alias("__at"), (F.col("__chars") - F.col("__c")).alias("char_shift"))
    return marks.join(shift, part).withColumn(at, F.col(at) + F.col("__at")).drop("__at")


def lexicon(lines: DataFrame, line: str = "line") -> DataFrame:
    """Entries ``word=>spoken`` or ``word=spoken`` of a user's list, the last of equal words first."""
    cut = F.when(F.col(line).contains("=>"), F.split(line, "=>", 2)).when(F.col(line).contains("="), F.split(line, "=", 2))
    rows = lines.select(F.lower(F.trim(F.get(cut, 0))).alias("word"), F.trim(F.get(cut, 1)).alias("spoken"))
    return rows.where("word is not null and word != '' and spoken != ''")


def changed_lines(lines: DataFrame, source: str = "source", translation: str = "translation") -> DataFrame:
    """Lines whose translation differs from the source by more than case."""
    return lines.where(F.lower(F.trim(translation)) != F.lower(F.trim(source)))
