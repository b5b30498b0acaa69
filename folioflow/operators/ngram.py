"""A back-off character model: exact context counts, then prediction from the longest context with support."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Support that a context of so many characters needs, the longest first.
SUPPORT = {5: 3, 4: 3, 3: 4, 2: 5, 1: 10, 0: 40}


def contexts(df: DataFrame, text: str, longest: int = 5) -> DataFrame:
    """Counts of each next character after each context: ``level, context, next, n``."""
    padded = F.concat(F.lit("^" * longest), F.lower(F.col(text)))
    rows = df.where(F.length(text) > 0).select(padded.alias("t"))
    at = rows.select("t", F.explode(F.sequence(F.lit(longest + 1), F.length("t"))).alias("i"))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.expr(f"substring(t, i - {k}, {k})").alias("context")) for k in range(longest + 1)))
    return at.select(F.expr("substring(t, i, 1)").alias("next"), F.inline(levels)).groupBy("level", "context", "next").agg(F.count("*").alias("n"))


def model(counts: DataFrame) -> DataFrame:
    """The likeliest next character of each context with support, its share, ties by character."""
    totals = counts.groupBy("level", "context").agg(F.sum("n").alias("total"), F.max(F.struct("n", F.negative(F.ascii("next")).alias("o"), "next")).alias("b"))
    need = F.element_at(F.create_map(*(x for k, v in SUPPORT.items() for x in (F.lit(k), F.lit(v)))), F.col("level"))
    return totals.where(F.col("total") >= need).select("level", "context", "total", F.col("b.next").alias("next"), (F.col("b.n") / F.col("total")).alias("share"))


def predict(rows: DataFrame, fitted: DataFrame, prefix: str, longest: int = 5, confidence: float = 0.8) -> DataFrame:
    """``rows`` with the next character from the longest supported context, null under ``confidence``."""
    key = F.concat(F.lit("^" * longest), F.lower(F.col(prefix)))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.expr(f"right(__k, {k})").alias("context")) for k in range(longest + 1)))
    asked = rows.select(F.col(prefix)).distinct().withColumn("__k", key).select(prefix, F.inline(levels))
    best = asked.join(fitted, ["level", "context"]).groupBy(prefix).agg(F.max_by(F.struct("next", "share", "level"), "level").alias("p"))
    return rows.join(best, prefix, "left").select(rows["*"], F.when(F.col("p.share") >= confidence, F.col("p.next")).alias("next"), F.col("p.share").alias("share"), F.col("p.level").alias("level"))


def top_classes(counts: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` commonest next characters of every context."""
    w = Window.partitionBy("level", "context").orderBy(F.col("n").desc(), "next")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def beam(prefix: str, table: dict[str, list[tuple[str, float]]], steps: int, longest: int = 5, width: int = 6, least: float = 0.04) -> list[tuple[str, float]]:
    """Likeliest continuations of a prefix: at each step the ``width`` best paths go on, unlikely letters left out.

    ``table`` maps a context to its next characters and their shares.
    """
    paths = [(("^" * longest + prefix.lower()), 1.0)]
    for _ in range(steps):
        grown = []
        for text, p in paths:
            options = next((table[text[len(text) - k :]] for k in range(longest, -1, -1) if text[len(text) - k :] in table), [])
            grown += [(text + c, p * share) for c, share in options if share >= least]
        if not grown:
            break
        paths = sorted(grown, key=lambda x: (-x[1], x[0]))[:width]
    return [(t[longest:], p) for t, p in paths]


def context_table(counts: DataFrame, most: int = 200_000) -> dict[str, list[tuple[str, float]]]:
    """Supported contexts with their next characters, for ``beam``; refused above ``most`` rows, as it lives on one machine."""
    totals = counts.groupBy("level", "context").agg(F.sum("n").alias("total"))
    need = F.element_at(F.create_map(*(x for k, v in SUPPORT.items() for x in (F.lit(k), F.lit(v)))), F.col("level"))
    rows = counts.join(totals.where(F.col("total") >= need), ["level", "context"]).select("context", "next", (F.col("n") / F.col("total")).alias("share"))
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} contexts: raise the support or the bound")
    out: dict[str, list[tuple[str, float]]] = {}
    for r in sorted(found, key=lambda r: (r.context, -r.share, r.next)):
        out.setdefault(r.context, []).append((r.next, r.share))
    return out
