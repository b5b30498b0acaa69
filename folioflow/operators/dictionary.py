"""Dictionaries: packs merged by priority, ambiguous keys, a cascade of lookups, coverage, edit-distance suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shaping import guesses
from .textops import dictionary_key, unify_letters

#: One-letter particles that may stand before a word, and endings that may follow.
PREFIXES = ("و", "ف", "ب", "ل", "ك")
SUFFIXES = ("ها", "هم", "هن", "كم", "نا", "ه", "ك", "ي")
_MARKED = r"[ً-ْٰ]"


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Entries of a dictionary text: ``plain<TAB>shaped``, ``plain=shaped`` or ``plain,shaped``, sides swapped if the left is the marked one; ``#`` starts a comment."""
    bare = F.trim(F.regexp_replace(F.col(line), "^﻿", ""))
    cut = F.when(bare.contains("\t"), F.split(bare, "\t")).when(bare.contains("="), F.split(bare, "=")).when(F.size(F.split(bare, ",")) == 2, F.split(bare, ","))
    left, right = F.trim(F.get(cut, 0)), F.trim(F.get(cut, 1))
    swap = left.rlike(_MARKED) & ~right.rlike(_MARKED)
    keep = lines.where((bare != "") & ~bare.startswith("#"))
    found = keep.withColumns({"plain": F.when(swap, right).otherwise(left), "shaped": F.when(swap, left).otherwise(right)})
    return found.where("plain is not null and shaped is not null and plain != '' and shaped != ''")


def valid_entry(plain: Column, shaped: Column) -> Column:
    """At least three letters, and the same letters without marks."""
    letters = F.regexp_replace(shaped, f"{_MARKED[:-1]}ـ]", "")
    return (F.length(F.regexp_replace(plain, r"[^\p{L}]", "")) >= 3) & (dictionary_key(plain) == dictionary_key(letters))


def merge(packs: DataFrame) -> DataFrame:
    """One shaped form a word: that of the pack with the highest priority, the last line among equals."""
    return packs.groupBy("plain").agg(F.max_by("shaped", F.struct("priority", "line_no")).alias("shaped"), F.max("priority").alias("priority"))


#: How many packs may be in use, and how large a pack may be in bytes.
MOST_PACKS, MOST_BYTES = 12, 60 << 20


def usable(packs: DataFrame, enabled: str = "enabled", order: str = "position", size: str = "bytes") -> DataFrame:
    """Packs in use with their priority in merging, the later the higher: those switched on and not too large, the first ``MOST_PACKS`` of them in order."""
    first = packs.where(F.col(enabled) & (F.col(size) <= MOST_BYTES)).orderBy(order).limit(MOST_PACKS)
    return first.withColumn("priority", F.row_number().over(Window.orderBy(order)))  # at most MOST_PACKS rows


def keys(merged: DataFrame) -> DataFrame:
    """Normalised keys: the shaped form, or null where several words disagree."""
    g = merged.groupBy(dictionary_key(F.col("plain")).alias("key")).agg(F.count_distinct("shaped").alias("n"), F.min("shaped").alias("shaped"))
    return g.select("key", F.when(F.col("n") == 1, F.col("shaped")).alias("shaped"), (F.col("n") > 1).alias("ambiguous"))


def cascade(words: DataFrame, learned: DataFrame, merged: DataFrame, word: str = "word", known: DataFrame | None = None) -> DataFrame:
    """Each distinct word's shaped form and how it was found: learned, exact, normalised, without a prefix, without a suffix, predicted.

    Distinct words meet the dictionary once a stage, however often they occur.  ``known`` are the contexts of ``shaping``, asked last
    for what no pack holds; without them nothing is predicted.
    """
    norm = keys(merged).where("shaped is not null").select("key", F.col("shaped").alias("by_key"))
    rows = words.select(F.col(word).alias("word")).distinct()
    out = rows.join(learned.select(F.col("plain").alias("word"), F.col("shaped").alias("by_learned")), "word", "left")
    out = out.join(merged.select(F.col("plain").alias("word"), F.col("shaped").alias("by_word")), "word", "left")
    out = out.withColumn("key", dictionary_key(F.col("word"))).join(norm, "key", "left")
    head = F.substring("key", 1, 1)
    stem = F.when(head.isin(*PREFIXES) & (F.length("key") > 3), F.substring(F.col("key"), F.lit(2), F.length("key")))
    out = out.withColumn("stem", stem).join(norm.select(F.col("key").alias("stem"), F.col("by_key").alias("by_stem")), "stem", "left")
    tail = F.lit(None).cast("string")
    for s in sorted(SUFFIXES, key=len):
        tail = F.when(F.col("key").endswith(s) & (F.length("key") >= 3 + len(s)), F.substring(F.col("key"), F.lit(1), F.length("key") - len(s))).otherwise(tail)
    out = out.withColumn("base", tail).join(norm.select(F.col("key").alias("base"), F.col("by_key").alias("by_base")), "base", "left")
    kind = (
        F.when(F.col("by_learned").isNotNull(), "LEARNED").when(F.col("by_word").isNotNull(), "EXACT").when(F.col("by_key").isNotNull(), "NORMALIZED")
        .when(F.col("by_stem").isNotNull(), "CLITIC").when(F.col("by_base").isNotNull(), "SUFFIX").otherwise("UNKNOWN")
    )
    shaped = F.coalesce("by_learned", "by_word", "by_key", F.concat(head, F.col("by_stem")), F.concat(F.col("by_base"), F.expr("substring(key, length(base) + 1)")))
    out = out.select("word", shaped.alias("shaped"), kind.alias("kind"))
    if known is None:
        return out
    asked = rows.join(merged.select(F.col("plain").alias("word")), "word", "left_anti")
    took = (F.col("kind") == "UNKNOWN") & F.col("guess").isNotNull()
    guessed = out.join(guesses(asked, known), "word", "left")
    return guessed.select("word", F.when(took, F.col("guess")).otherwise(F.col("shaped")).alias("shaped"), F.when(took, "PREDICTED").otherwise(F.col("kind")).alias("kind"))


def coverage(found: DataFrame) -> DataFrame:
    """Words by kind of match, and the share known in per cent."""
    total = F.count("*")
    known = F.count_if(~F.col("kind").isin("UNKNOWN", "PREDICTED"))
    return found.agg(total.alias("words"), known.alias("known"), F.when(total > 0, F.floor(known * 100 / total)).otherwise(0).cast("long").alias("percent"))


def words_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """Every Arabic word of the texts, as often as it occurs: ``word`` without marks and stretching, and whether it was ``marked``."""
    runs = F.regexp_extract_all(unify_letters(F.col(text)), F.lit(r"[ء-غف-ي][ء-ْٰ]*"), F.lit(0))
    found = texts.select(F.explode(runs).alias("__w"))
    return found.select(F.regexp_replace("__w", f"{_MARKED[:-1]}ـ]", "").alias("word"), F.col("__w").rlike(_MARKED).alias("marked"))


def coverage_by_kind(texts: DataFrame, learned: DataFrame, merged: DataFrame, text: str = "text") -> DataFrame:
    """How many words of the texts each stage of the cascade finds: ``kind, n``.

    Every occurrence counts.  Words that are marked already are ``marked``, those under three letters ``short``; neither is looked
    up.  Distinct words meet the dictionary once.
    """
    counted = words_of(texts, text).groupBy("word", "marked").agg(F.count("*").alias("n"))
    asked = ~F.col("marked") & (F.length("word") >= 3)
    found = cascade(counted.where(asked), learned, merged).select("word", "kind")
    kind = F.when(F.col("marked"), "marked").when(F.length("word") < 3, "short").otherwise(F.col("kind"))
    return counted.join(found, "word", "left").groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"))


def pack_stats(lines: DataFrame) -> DataFrame:
    """Lines, accepted and rejected entries of every pack, and how many a later pack overrides."""
    good = valid_entry(F.col("plain"), F.col("shaped"))
    best = lines.where(good).groupBy("plain").agg(F.max("priority").alias("__top"))
    joined = lines.join(best, "plain", "left")
    return joined.groupBy("pack").agg(F.count("*").alias("lines"), F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"), F.count_if(good & (F.col("priority") < F.col("__top"))).alias("overridden"))


def suggestions(words: DataFrame, dictionary: DataFrame, word: str = "word", entry: str = "plain") -> DataFrame:
    """Entries one edit away.  Both sides emit their deletions, so the join is on equal strings and never a product."""

    def deletions(c: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return F.array_distinct(F.concat(F.array(c), cut))

    a = words.select(F.col(word).alias("word")).where("word != ''").distinct().select("word", F.explode(deletions(F.col("word"))).alias("__d"))
    b = dictionary.select(F.col(entry).alias("entry")).where("entry != ''").distinct().select("entry", F.explode(deletions(F.col("entry"))).alias("__d"))
    return a.join(b, "__d").where(F.levenshtein("word", "entry") == 1).select("word", "entry").distinct()
