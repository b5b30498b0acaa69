"""Language identification by prediction by partial matching.

Each language has byte context trees of orders 0 to ``ORDER``.  A byte's code
length is that of PPM with method C escapes: from the longest context known to
the language, an escape of ``distinct / (total + distinct)`` leads to the next
shorter one until the byte is found there with ``count / (total + distinct)``; below
order 0 all 256 bytes are alike.  Statistics are frozen, so the code length of a
byte depends on its last ``ORDER`` bytes alone and is exact from two tables: the
grams that some language has seen, and the escapes of contexts.  A text goes to
the language that codes it in fewest bits.

Training takes at most ``SAMPLE_ROWS`` texts a language, those of smallest id hash,
and of each at most ``SAMPLE_CHARS`` characters, of a longer text as pieces from all over it;
``SAMPLE_TOTAL`` bounds the characters of all languages together.  Everything else covers
all rows and whole texts.  The size of the model is bounded by the sample, so it is broadcast.

Defined results
    null text, or none with a letter   ``und`` with score 0
    nothing to learn from              ``und`` with score 0 for every text
    null doc_id                        checksum of the empty text decides ``held_out``
    null lang                          never learned from, predicted like others
    ties                               the first language in order of name
    repeated rows                      one result row each
    very long texts                    scored whole, in pieces of ``PIECE`` bytes that overlap by the context
    empty table                        empty result
    clashing columns                   ``identify`` keeps all and writes ``out``; ``language_id`` reads only the named columns
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import PIECES, crc_of_id, excerpt, shared, spare

ORDER = 3
#: Bound of the training sample: texts a language.
SAMPLE_ROWS = 400
#: Characters learned from a text, and from all; a longer text gives pieces from evenly spread places.
SAMPLE_CHARS, SAMPLE_TOTAL = 1 << 15, 1 << 27
#: Bytes scored at once.
PIECE = 1 << 19

_LETTER = re.compile(r"[^\W\d_]")
_RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def has_letter(text: str) -> bool:
    """Whether a text has a letter; the pattern also meets a few numerals such as superscripts."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def normal_bytes(text: str) -> np.ndarray:
    """The bytes that are coded: the text in lower case, as UTF-8."""
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Every run of ``n`` bytes as a number, the last byte lowest; row i ends at byte i + n - 1."""
    out = np.zeros(len(data) - n + 1, np.uint32)
    for k in range(n):
        out = (out << np.uint32(8)) | data[k : len(data) - n + 1 + k]
    return out


@dataclass
class Model:
    """``keys[n]``: sorted grams of n+1 bytes seen in any language; ``cost[n]``: their code lengths by language.

    ``contexts[n]`` and ``escape[n]``: sorted contexts of n bytes and the bits their escapes cost.
    """

    langs: list[str]
    order: int = ORDER
    keys: list[np.ndarray] = field(default_factory=list)
    cost: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escape: list[np.ndarray] = field(default_factory=list)

    def code_lengths(self, data: np.ndarray, at: int) -> np.ndarray:
        """Bits of each byte from ``at`` on, by language; the bytes before serve as context."""
        out = np.zeros((len(data) - at, len(self.langs)), np.float32)
        if at < self.order and len(data):  # the first bytes have shorter contexts
            for i in range(at, min(self.order, len(data))):
                out[i - at] = self._bits(grams(data[: i + 1], i + 1), i)[0]
        first = max(at, self.order)
        if first < len(data):
            out[first - at :] = self._bits(grams(data[first - self.order :], self.order + 1), self.order)
        return out

    def _bits(self, gram: np.ndarray, n: int) -> np.ndarray:
        slot = np.minimum(np.searchsorted(self.keys[n], gram), len(self.keys[n]) - 1)
        missed = np.nonzero(self.keys[n][slot] != gram)[0]
        out = self.cost[n][slot]
        if len(missed):
            out[missed] = self._unseen(gram[missed], n)
        return out

    def _unseen(self, gram: np.ndarray, n: int) -> np.ndarray:
        """Grams that no language has: all escape from the context."""
        if n == 0:
            return self.escape[0][0] + np.full((len(gram), len(self.langs)), 8, np.float32)
        context = gram >> np.uint32(8)
        slot = np.minimum(np.searchsorted(self.contexts[n], context), len(self.contexts[n]) - 1)
        out = np.where((self.contexts[n][slot] == context)[:, None], self.escape[n][slot], np.float32(0))
        return out + self._bits(gram & np.uint32((1 << 8 * n) - 1), n - 1)


def train(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Context trees of each language from its texts."""
    model = Model(sorted(texts), order)
    bodies = {lang: [normal_bytes(t) for t in texts[lang]] for lang in model.langs}
    for n in range(order + 1):
        counts = []
        for lang in model.langs:
            parts = [grams(b, n + 1) for b in bodies[lang] if len(b) > n]
            counts.append(np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint32), return_counts=True))
        keys = np.unique(np.concatenate([k for k, _ in counts]))
        contexts = np.unique(keys >> np.uint32(8)) if n else np.zeros(1, np.uint32)
        escape, cost = np.zeros((len(contexts), len(counts)), np.float32), np.zeros((len(keys), len(counts)), np.float32)
        for i, (seen, times) in enumerate(counts):
            where = np.searchsorted(contexts, seen >> np.uint32(8)) if n else np.zeros(len(seen), np.int64)
            total = np.bincount(where, times, len(contexts))
            kinds = np.bincount(where, minlength=len(contexts)).astype(float)
            known = total > 0
            escape[known, i] = np.log2((total + kinds)[known] / kinds[known])
            at = np.searchsorted(keys, seen)
            # What the language lacks: its escape from the context, if it knows that, and the shorter context.
            back = escape[np.searchsorted(contexts, keys >> np.uint32(8)) if n else np.zeros(len(keys), np.int64), i]
            cost[:, i] = back + (model._bits(keys & np.uint32((1 << 8 * n) - 1), n - 1)[:, i] if n else 8)
            cost[at, i] = np.log2((total + kinds)[where] / times)
        if not len(keys):
            keys, cost = np.zeros(1, np.uint32), np.full((1, len(counts)), 8, np.float32)
        if not len(contexts):
            contexts, escape = np.zeros(1, np.uint32), np.zeros((1, len(counts)), np.float32)
        model.keys.append(keys)
        model.cost.append(cost)
        model.contexts.append(contexts)
        model.escape.append(escape)
    return model


def total_bits(model: Model, texts: list[str]) -> np.ndarray:
    """Bits of every whole text by language."""
    out = np.zeros((len(texts), len(model.langs)))
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if rows:
            # Short texts go together: lookups run over all of them, then each text sums its own bytes.
            data = np.concatenate(held)
            bits = model.code_lengths(data, 0)
            starts = np.cumsum([0, *map(len, held[:-1])])
            for i, start in enumerate(starts[1:], 1):  # the first bytes must not see the text before
                n = min(model.order, len(held[i]))
                bits[start : start + n] = model.code_lengths(held[i][:n], 0)
            out[rows] += np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
        held.clear()
        rows.clear()
        size = 0

    for i, text in enumerate(texts):
        data = normal_bytes(text)
        if not len(data):
            continue
        if len(data) > PIECE:
            for at in range(0, len(data), PIECE):
                lead = min(at, model.order)
                out[i] += model.code_lengths(data[at - lead : at + PIECE], lead).sum(axis=0, dtype=np.float64)
            continue
        held.append(data)
        rows.append(i)
        size += len(data)
        if size >= PIECE:
            flush()
    flush()
    return out


def predict(model: Model | None, texts: list[str | None]) -> pd.DataFrame:
    """``lang_pred`` and ``score``, the share of the best language among all when each byte's average code length is a likelihood of ten bytes."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    live = [i for i, t in enumerate(texts) if t and has_letter(t)] if model and model.langs else []
    if live:
        bits = total_bits(model, [texts[i] for i in live])
        sizes = np.array([max(1, len(normal_bytes(texts[i]))) for i in live], float)
        best = bits.argmin(axis=1)
        gap = (bits - bits.min(axis=1, keepdims=True)) / sizes[:, None] * np.minimum(sizes, 10)[:, None]
        for i, b, s in zip(live, best, 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1), strict=True):
            lang[i], score[i] = model.langs[b], s
    return pd.DataFrame({"lang_pred": lang, "score": score})


def sample(docs: DataFrame, lang_col: str, text_col: str, id_col: str, learnable: Column, rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """At most ``rows`` texts a language, of smallest id hash, long ones as excerpts."""
    able = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = able.groupBy(lang_col).count().collect()  # one row a language
    chars = min(SAMPLE_CHARS, max(PIECES, SAMPLE_TOTAL // (rows * max(1, len(sizes)))))
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("langid"))
    # The hash is uniform: a threshold with room to spare leaves few rows, and the exact cut is made on those.
    cut = F.lit(False)
    for r in sizes:
        share = min(1.0, 1.5 * rows / r["count"] + 20 / r["count"])
        cut = cut | ((F.col(lang_col) == r[lang_col]) & (order <= F.lit(int(min((1 << 63) - 1, -(1 << 63) + share * (1 << 64))))))
    picked = able.where(cut).select(F.col(lang_col).alias("lang"), order.alias("h"), excerpt(F.col(text_col), chars).alias("text"))
    # The hash says nothing of rows that repeat an id: the bound is kept by rank, among the few rows the threshold left.
    first = picked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= rows)
    out: dict[str, list[tuple[int, str]]] = {}
    for r in first.collect():
        out.setdefault(r.lang, []).append((r.h, r.text))
    return {lang: [t for _, t in sorted(found)] for lang, found in out.items()}


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score."""
    fitted = shared(docs, model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(fitted(), [t if isinstance(t, str) else None for t in batch])

    udf = F.pandas_udf(score, _RESULT)
    (both,) = spare(docs, "found")
    found = docs.withColumn(both, udf(F.col(text_col)))
    return found.withColumns({out[0]: F.col(f"{both}.lang_pred"), out[1]: F.col(f"{both}.score")}).drop(both)


def language_id(docs: DataFrame, held_out_rest: int = 2, parts: int = 4) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row; learns from the rows that are not held out."""
    docs = docs.select("doc_id", "text", "lang")
    held = crc_of_id(F.col("doc_id")) % parts == held_out_rest
    texts = sample(docs, "lang", "text", "doc_id", ~held)
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return identify(rows, train(texts) if texts else None).select("doc_id", "held_out", "lang_pred", "score")
