"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character
n-grams; a linear layer and softmax give the class.  Vectors and layer are trained
together by stochastic gradient descent in numpy.  Averaging and the layer are
linear, so once training ends each bucket's vector is folded into one number, its
share of the log-odds, and scoring a text averages those: the same score at one
lookup a feature.

Training takes at most ``SAMPLE_ROWS`` labelled texts, those of smallest id hash among the
labels that have a document, and of each at most ``SAMPLE_CHARS`` characters, of a longer text
as pieces from all over it.  Scoring covers all rows and whole texts.  The model is one float
a bucket, a fixed size.

Defined results
    null or empty text     the score of a text without features: the layer's bias alone
    no labels, or one class  the share of label 1 among those learned from (0.5 if none)
    null doc_id            checksum of the empty text decides ``held_out``; never learned from
    several labels of an id  each counts as a row
    null label             not learned from
    repeated rows          one result row each
    very long texts        scored whole, in pieces of ``PIECE`` characters cut at word ends where there are any; n-grams and
                           pairs that cross a cut count
    empty table            empty result
    clashing columns       ignored; only the named columns are read
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import crc_of_id, excerpt, shared

#: Bound of the training sample, in labelled rows.
SAMPLE_ROWS = 3000
#: Characters learned from a text; a longer one gives pieces from evenly spread places.
SAMPLE_CHARS = 1 << 15
BUCKETS = 1 << 17
DIM = 8
#: Characters (code points) in an n-gram.
NGRAMS = (2, 3, 4)
#: Characters scored at once.
PIECE = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_powers: dict = {}


def _bucket(codes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (codes ^ np.uint64(salt * 0x51_7C_C1B7)) * _MIX
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if _powers.get("n", 0) < n:
        size = max(n, PIECE * 2)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"][:n], _powers["down"][:n]


def ngrams(data: np.ndarray, sizes: tuple[int, ...] = NGRAMS) -> list[np.ndarray]:
    """For each size, ascending, the buckets of the so many characters from each place on."""
    wide = data.astype(np.uint64)
    code, out = wide, []
    for n in range(1, max(sizes) + 1):
        if n > 1:  # 21 bits hold any code point, so three fit in a word; more are mixed in
            code = (code[:-1] << np.uint64(21) if n <= 3 else code[:-1] * _BASE) + wide[n - 1 :]
        if n in sizes:
            out.append(_bucket(code, n))
    return out


def word_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and where it starts: differences of one running sum, shifted back by the word's place."""
    blank = (data == 32) | ((data >= 9) & (data <= 13)) | (data == 0)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    up, down = _power_table(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        return (sums[last] - sums[first]) * down[first], first


def word_buckets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, and of pairs of neighbours in their order; a word beside itself is one bucket whatever the word, so repeating shows."""
    a, b = codes[:-1], codes[1:]
    return _bucket(codes, 99), _bucket(np.where(a == b, np.uint64(0), (a << np.uint64(17) | a >> np.uint64(47)) + b), 98)


@dataclass
class Model:
    """``weight``: each bucket's share of the log-odds; without it the score is ``prior`` for every text."""

    prior: float
    weight: np.ndarray | None = None
    bias: float = 0.0


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").replace("\0", " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in pieces of bounded size, cut after a blank where a piece has one."""
    at = 0
    while len(data) - at > PIECE:
        blanks = np.flatnonzero(data[at : at + PIECE] <= 32)
        end = at + (int(blanks[-1]) + 1 if len(blanks) else PIECE)
        yield data[at:end]
        at = end
    if len(data) > at:
        yield data[at:]


def features(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a whole text, repeats included, array by array."""
    lead, word, reach = np.zeros(0, np.uint32), np.zeros(0, np.uint64), max(NGRAMS) - 1
    for piece in pieces(code_points(text)):
        joined = np.concatenate([lead, piece])
        for n, found in zip(NGRAMS, ngrams(joined), strict=True):  # those that end in this piece
            yield found[max(0, len(lead) - n + 1) :]
        codes = word_codes(piece)[0]
        yield word_buckets(codes)[0]
        yield word_buckets(np.concatenate([word, codes]))[1]
        lead, word = joined[-reach:], np.concatenate([word, codes])[-1:]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and each one's share of the features."""
    ids, n = np.unique(np.concatenate([np.zeros(0, np.int32), *features(text)]), return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = 8, least_steps: int = 800, rate: float = 1.0, batch: int = 16, seed: int = 7) -> Model:
    """Vectors and layer by stochastic gradient descent on the softmax loss, the rate falling to zero.

    A small sample is gone over more often than ``epochs`` times, until ``least_steps`` batches.
    """
    y = np.array(labels, np.int64)
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return Model(prior)
    rng = np.random.default_rng(seed)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, len(texts), 64):  # views of few large arrays, whose memory goes back when training ends
        found = [bag(t) for t in texts[k : k + 64]]
        bounds = np.cumsum([0, *(len(ids) for ids, _ in found)])
        ids, share = (np.concatenate([x[j] for x in found]) for j in (0, 1))
        bags += [(ids[a:b], share[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.log(np.array([1 - prior, prior], np.float32))
    batches = -(-len(y) // batch)
    epochs = max(epochs, -(-least_steps // batches))
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            step = rate * (1 - done / steps)
            done += 1
            ids = np.concatenate([bags[i][0] for i in rows])
            share = np.concatenate([bags[i][1] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
            bounds = np.cumsum([0, *(len(bags[i][0]) for i in rows)])
            held = vectors[ids]
            mean = np.zeros((len(rows), DIM), np.float32)
            for i in range(len(rows)):
                a, b = bounds[i], bounds[i + 1]
                mean[i] = share[a:b] @ held[a:b]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = p
            error[np.arange(len(rows)), y[rows]] -= 1
            to_mean = error @ layer.T
            layer -= step * mean.T @ error
            bias -= step / len(rows) * error.sum(axis=0)
            # A feature's gradient is its share of the document's; the sum over its documents follows by bucket.
            where, slot = np.unique(ids, return_inverse=True)
            for d in range(DIM):
                vectors[where, d] -= step * DIM * np.bincount(slot, share * to_mean[owner, d], len(where)).astype(np.float32)
    odds = layer[:, 1] - layer[:, 0]
    return Model(prior, (vectors @ odds).astype(np.float32), float(bias[1] - bias[0]))


def predict(model: Model, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for every whole text."""
    if model.weight is None:
        return np.full(len(texts), model.prior)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0
    gap = np.zeros(max(NGRAMS), np.uint32)  # n-grams across texts are told apart by their place

    def flush() -> None:
        nonlocal size
        if not rows:
            return
        data = np.concatenate([x for d in held for x in (d, gap)])
        starts = np.cumsum([0, *(len(d) + len(gap) for d in held)])
        at_row = np.array(rows)
        for n, found in zip(NGRAMS, ngrams(data), strict=True):
            value = np.concatenate(([0.0], np.cumsum(model.weight[found], dtype=np.float64)))
            for i, d in enumerate(held):
                if len(d) >= n:
                    a, b = starts[i], starts[i] + len(d) - n + 1
                    total[rows[i]] += value[b] - value[a]
                    count[rows[i]] += b - a
        codes, first = word_codes(data)
        owner = np.searchsorted(starts, first, side="right") - 1
        alone, pair = word_buckets(codes)
        for bucket, of in ((alone, owner), (pair[owner[1:] == owner[:-1]], owner[1:][owner[1:] == owner[:-1]])):
            np.add.at(total, at_row[of], model.weight[bucket])
            np.add.at(count, at_row[of], 1)
        held.clear()
        rows.clear()
        size = 0

    for i, text in enumerate(texts):
        data = code_points(text)
        if len(data) > PIECE:
            for found in features(text):
                total[i] += model.weight[found].sum(dtype=np.float64)
                count[i] += len(found)
            continue
        if len(data):  # short texts go together
            held.append(data)
            rows.append(i)
            size += len(data)
        if size >= PIECE:
            flush()
    flush()
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + model.bias)))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learnable, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """At most ``rows`` labelled texts, those of smallest id hash among the labels that have a document."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    able = labels.where(learnable & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = able.select("doc_id", F.col(label_col).cast("int").alias("label"), order.alias("h")).orderBy("h", "label").limit(rows)  # the bound of the broadcast
    found = docs.select("doc_id", excerpt(F.col("text"), SAMPLE_CHARS).alias("text")).join(F.broadcast(picked), "doc_id")
    # Ids that repeat in ``docs`` could pass the bound again: the first rows in order of hash are taken.
    found = found.orderBy("h", "label", "text").limit(rows)
    got = [(r.h, r.label, r.text) for r in found.collect()]
    return [t for _, _, t in got], [y for _, y, _ in got]


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""
    fitted = shared(docs, model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(predict(fitted(), [t if isinstance(t, str) else None for t in batch]))

    return docs.withColumn(out, F.pandas_udf(score, DoubleType())(F.col(text_col)))


def held_out(doc_id: Column, parts: int = 5) -> Column:
    return crc_of_id(doc_id) % parts == 0


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """A model from the labels that are not held out."""
    texts, marks = sample(docs, labels, label_col, ~held_out(F.col("doc_id")))
    return train(texts, marks)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    scored = score_quality(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fit(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
