"""Line-first cleaning: rules judge each line, and a document that loses too much text goes.

Everything is a native expression over one row: no shuffle, no Python.

Defined results
    null or empty text   no words; ``base_failed`` is true and ``kept`` false
    null doc_id          kept as null
    repeated rows, ties  each row is judged alone
    very long texts      cost grows as n log n in the number of words
    empty table          empty result
    clashing columns     the operator returns its own columns and, of the input, only the id
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\f\r"
#: Words in a repeated-words window.
WINDOW = 5

#: Phrases of page furniture, matched anywhere in a lower-cased line; those of other languages go into ``LineRules``.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "enable javascript", "lorem ipsum", "subscribe to our newsletter", "sign up for our", "click here to",
    "powered by", "share this page", "skip to content", "back to top",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren",
    "newsletter abonnieren", "hier klicken", "seite teilen", "zum inhalt springen", "nach oben scrollen",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "conditions d'utilisation", "activer javascript",
    "abonnez-vous à notre", "cliquez ici", "partager cette page", "aller au contenu", "haut de page",
    "todos los derechos reservados", "aceptar cookies", "política de privacidad", "términos de uso", "activar javascript",
    "suscríbete a nuestro", "haz clic aquí", "compartir esta página", "saltar al contenido", "volver arriba",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document verdict.

    symbols_per_word     a line fails at this many symbols a word
    separators           a line fails at this many ``|``, ``»``, ``•`` or ``·``
    shouts               a line fails at this many ``!!``
    short_line           a line of fewer words fails unless it ends in ``. ! ? … : ;`` or a closing mark
    phrases              a line fails if it holds one of these, both in lower case
    max_loss             a document fails if it loses a larger share of its word characters
    """

    symbols_per_word: float = 0.3
    separators: int = 3
    shouts: int = 3
    short_line: int = 4
    phrases: tuple[str, ...] = BOILERPLATE
    max_loss: float = 0.5


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), ""))


def symbols_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


_SEPARATORS = "[|»•·]"
_LAST = list(".!?…:;\"')]»”")


def _literal(phrase: str) -> str:
    """A pattern that both engines read as the phrase itself."""
    return re.sub(r"([^\w\s'-])", r"\\\1", phrase)


def suspicions(text: Column, low: Column | None = None, phrases: tuple[str, ...] = BOILERPLATE) -> dict[str, Column]:
    """What a text must hold for any of its lines to break a rule; cheap beside asking every line.  ``low`` is the text in lower case."""
    low = F.lower(text) if low is None else low
    phrase = F.lit(False)
    for p in phrases:
        phrase = phrase | low.contains(p)
    return {"symbols": symbols_in(text) > 0, "separators": text.rlike(_SEPARATORS), "shouts": text.contains("!!"), "boilerplate": phrase}


def line_fails(line: Column, rules: LineRules, may: dict[str, Column] | None = None) -> Column:
    """Whether a line that has a word breaks the punctuation, navigation or boilerplate rules.

    ``may`` has the suspicions of the whole text; a rule without one is not asked.
    """
    may = may or suspicions(line, phrases=rules.phrases)
    n_words = F.size(words(line))
    n_symbols = symbols_in(line)
    n_separators = F.regexp_count(line, F.lit(_SEPARATORS))
    n_shouts = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    ends = F.right(F.rtrim(line, F.lit(_BLANKS)), F.lit(1)).isin(_LAST)
    return (
        (may["symbols"] & (n_symbols > 0) & (n_symbols >= rules.symbols_per_word * n_words))
        | (may["separators"] & (n_separators >= rules.separators))
        | (may["shouts"] & (n_shouts >= rules.shouts))
        | (~ends & (n_words < rules.short_line))
        | (may["boilerplate"] & F.lower(line).rlike("|".join(map(_literal, rules.phrases))))
    )


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that the text has twice or more, the first one included.

    Windows are compared by 64-bit hashes.  Only texts in which two hashes are
    equal pay for the sort that finds their places.
    """
    heads = F.slice(w, F.lit(1), F.size(w) - (WINDOW - 1))
    hashes = F.when(
        F.size(w) > WINDOW,
        F.transform(heads, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def places(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda s, k: (s.h == F.get(pairs, k - 1).h) | (s.h == F.get(pairs, k + 1).h))
        return F.sort_array(F.transform(twice, lambda s: s.i))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, lambda p: _let(places(p), covered)))

    return _let(hashes, count)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None) -> DataFrame:
    """One row per document: counts, the text of the lines that stay, and the verdict.

    Returns ``id_col``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``n_lines``, ``n_lines_removed``, ``lost_share``,
    ``clean_text``, ``base_failed`` and ``kept``.
    """
    rules = rules or LineRules()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    rows = rows.withColumns({"w": words(F.col("text")), "lines": F.split("text", "\n"), "n_symbols": symbols_in(F.col("text")), **{f"may_{k}": v for k, v in suspicions(F.col("text"), F.col("low"), rules.phrases).items()}})
    may = {k: F.col(f"may_{k}") for k in ("symbols", "separators", "shouts", "boilerplate")}
    rows = rows.withColumn("full", F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("good", F.filter("full", lambda x: ~line_fails(x, rules, may)))
    chars = F.length(F.array_join("w", ""))
    left = word_chars(F.array_join("good", " "))
    n, repeats = F.size("w"), F.col("n_repeat_words")
    out = rows.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size("full").cast("long").alias("n_lines"),
        (F.size("full") - F.size("good")).cast("long").alias("n_lines_removed"),
        F.when(F.size("good") < F.size("full"), 1 - left / chars).otherwise(0.0).alias("lost_share"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * repeats > 20 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= rules.max_loss))
