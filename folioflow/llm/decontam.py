"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts and items are sequences of lower-cased words; in scripts written without spaces
every character is a word.  An item of n words is found in a text if some run of words is
within ``floor(max_rate * n)`` word edits of it; at the usual rate items under 5 words
must stand there exactly.

1. A window of n words is embedded by a CGK random walk of 3n steps: a step copies
   the word under the pointer, and a random function of step and word says whether
   the pointer moves on.  Strings at small edit distance walk together again soon
   after each edit, so they agree in most places of the walk.
2. ``WALKS`` walks of ``SAMPLES`` samples of ``PLACES`` places each give keys; a window that
   shares one with an item of its size is a candidate.  At an agreement of half the
   places a pair is missed with chance (1 - 1/8)^(WALKS*SAMPLES) < 0.3 %.
3. Candidates are verified by bit-parallel approximate matching of the whole item.

To embed the windows of every size at every word would cost hundreds of times as much as
all the rest, so an exact filter first leaves out windows that cannot match.  e edits
spoil at most 2e of the n-1 neighbouring word pairs of an item, so a match holds n-1-2e of
them, and one of the item's 2e+1 rarest.  Where n-1-2e is not positive nothing is left
out.  Windows are embedded so many at once that their words are at most ``WINDOW_WORDS``, or one, so what is held grows with
the text and with one item, not with items times text.  Items come in
blocks of ``BLOCK``; a worker holds the index of one block at a time, and every block is
matched against all rows.

Defined results
    null or empty text       no match
    null or empty item       never matched; nor is one without a word
    null doc_id              reported as null
    repeated items           each is reported under its own id
    ties                     the least distance, then the first place
    repeated rows            one result each
    very long texts          read whole
    empty tables             empty result
    clashing columns         kept by ``with_matches``, which writes its ``out``; ``contaminated`` reads only the named columns
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import shared

MAX_RATE = 0.2
WALKS, SAMPLES, PLACES = 8, 6, 3
#: Items matched at once.
BLOCK = 5000
#: Words of windows embedded, and pairs of windows and items compared, at once.
WINDOW_WORDS, PAIRS = 1 << 18, 1 << 20

# Scripts without spaces: Thai, Lao, Burmese, Khmer, kana and ideographs go by character.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_MATCH = ArrayType(StructType([StructField("item_id", LongType()), StructField("distance", IntegerType()), StructField("start", IntegerType()), StructField("item_words", IntegerType())]))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def tokenize(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


_drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _draws(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of n words: salts by step and walk, and the sampled places by walk and sample."""
    if n in _drawn:
        return _drawn[n]
    rng = np.random.default_rng(n)
    salts = rng.integers(1, 1 << 63, (3 * n, WALKS), dtype=np.uint64)
    places = np.array([[rng.choice(3 * n, PLACES, replace=False) for _ in range(SAMPLES)] for _ in range(WALKS)])
    _drawn[n] = salts, places
    return salts, places


def walk(windows: np.ndarray) -> np.ndarray:
    """CGK embeddings of each row of word numbers: step by walk by row; past its end a row gives 0."""
    m, n = windows.shape
    salts, _ = _draws(n)
    padded = np.concatenate([windows, np.zeros((m, 1), windows.dtype)], axis=1).astype(np.uint64).ravel()
    row, end = np.tile(np.arange(m) * (n + 1), (WALKS, 1)), np.tile(np.arange(m) * (n + 1) + n, (WALKS, 1))
    at, out = row.copy(), np.zeros((3 * n, WALKS, m), np.uint64)
    for step in range(3 * n):
        here = padded[at]
        out[step] = here
        at = np.minimum(at + ((_mixed(here * _MIX + salts[step][:, None]) >> np.uint64(40)) & np.uint64(1)).astype(np.int64), end)
    return out


def keys(windows: np.ndarray) -> np.ndarray:
    """The LSH keys of each row, one column a sample."""
    m, n = windows.shape
    path, (_, places) = walk(windows), _draws(n)
    which = np.arange(WALKS)[:, None]
    code = np.arange(1, WALKS * SAMPLES + 1, dtype=np.uint64).reshape(WALKS, SAMPLES, 1)
    for p in range(PLACES):
        at = places[:, :, p]
        code = _mixed(code * np.uint64(31) + path[at, which] + (at[:, :, None] + 1).astype(np.uint64))
    return code.reshape(WALKS * SAMPLES, m).T


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to any run of the text's words, and the last word of the first such run."""
    n, where = len(item), {}
    for i, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = mask, 0, n, (n, -1)
    for j, x in enumerate(text):
        eq = where.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & mask
        down = plus & xh
        score += 1 if up & top else -1 if down & top else 0
        best = min(best, (score, j))
        up, down = up << 1 & mask, down << 1 & mask
        plus, minus = down | ~(xv | up) & mask, up & xv
    return best


@dataclass
class Index:
    """A block of items ready for matching: ``items`` are distinct word sequences in order, ``ids`` who bears them."""

    vocabulary: dict[str, int]
    items: list[tuple[int, ...]]
    ids: list[list[int]]
    rare: np.ndarray
    rare_owner: np.ndarray
    pairs: list[np.ndarray]
    every: np.ndarray
    always: list[int]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    max_rate: float

    def edits(self, n: int) -> int:
        return int(self.max_rate * n + 1e-9)

    def need(self, n: int) -> int:
        """Pairs of an item that a match holds at least; none if not positive."""
        return n - 1 - 2 * self.edits(n)


def build(rows: list[tuple[int, str | None]], max_rate: float = MAX_RATE) -> Index:
    vocabulary: dict[str, int] = {}
    borne: dict[tuple[int, ...], list[int]] = {}
    for item_id, text in sorted((r for r in rows if r[1] and r[0] is not None), key=lambda r: r[0]):
        found = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokenize(text))
        if found:
            borne.setdefault(found, []).append(item_id)
    items, none = sorted(borne), np.zeros(0, np.int64)
    index = Index(vocabulary, items, [borne[x] for x in items], none, none, [], none, [], {}, max_rate)
    width = np.int64(len(vocabulary) + 1)
    index.pairs = [np.unique([a * width + b for a, b in zip(x, x[1:], strict=False)]).astype(np.int64) for x in items]
    index.every = np.unique(np.concatenate([*index.pairs, none]))
    index.always = [i for i, x in enumerate(items) if index.need(len(x)) <= 0]
    held = Counter(c for own in index.pairs for c in own.tolist())
    loose, rare = set(index.always), []
    for i, x in enumerate(items):
        if i not in loose:
            places = [a * int(width) + b for a, b in zip(x, x[1:], strict=False)]
            rare += [(c, i) for c in set(sorted(places, key=lambda c: (held[c], c))[: 2 * index.edits(len(x)) + 1])]
    rare.sort()
    index.rare, index.rare_owner = np.array([c for c, _ in rare], np.int64), np.array([i for _, i in rare], np.int64)
    for n in sorted({len(x) for x in items}):
        own = np.array([i for i, x in enumerate(items) if len(x) == n])
        some = max(1, WINDOW_WORDS // n)
        code = np.concatenate([keys(np.array([items[i] for i in own[k : k + some]])) for k in range(0, len(own), some)])
        flat, owner = code.ravel(), np.repeat(own, code.shape[1])
        order = np.argsort(flat, kind="stable")
        index.tables[n] = flat[order], owner[order]
    return index


def _starts(index: Index, code: np.ndarray) -> dict[int, tuple[np.ndarray, list[int]]]:
    """By window size, the places at which a window passes the filter, and the items that it passes it for."""
    n_words = len(code) + 1
    open_at: dict[int, np.ndarray] = {}
    passes: dict[int, list[int]] = {}

    def marks(n: int) -> np.ndarray:
        """Where runs of open places begin (+) and end (-)."""
        return open_at.setdefault(n, np.zeros(n_words + 1, np.int64))

    for i in index.always:
        marks(len(index.items[i]))[[0, n_words]] += (1, -1)
        passes.setdefault(len(index.items[i]), []).append(i)
    slot = np.minimum(np.searchsorted(index.every, code), max(0, len(index.every) - 1))
    at = np.flatnonzero(index.every[slot] == code) if len(index.every) else np.zeros(0, np.int64)
    met = code[at]
    seen = np.unique(met)
    left, right = np.searchsorted(index.rare, seen, "left"), np.searchsorted(index.rare, seen, "right")
    live = {int(i) for a, b in zip(left[right > left], right[right > left], strict=True) for i in index.rare_owner[a:b]}
    for i in sorted(live):
        own, n = index.pairs[i], len(index.items[i])
        need, span = index.need(n), n + index.edits(n) - 1
        if len(at) < need:
            continue
        where = at[own[np.minimum(np.searchsorted(own, met), len(own) - 1)] == met]
        if len(where) < need:
            continue
        # Runs of ``need`` pairs that fit a match: it begins between the place that still reaches the last and the first.
        first, last = where[: len(where) - need + 1], where[need - 1 :]
        fits = last - first < span
        if fits.any():
            np.add.at(marks(n), np.maximum(last[fits] - span + 1, 0), 1)
            np.add.at(marks(n), first[fits] + 1, -1)
            passes.setdefault(n, []).append(i)
    return {n: (np.flatnonzero(np.cumsum(m[:-1]) > 0), passes[n]) for n, m in open_at.items()}


def _candidates(index: Index, n: int, windows: np.ndarray) -> list[tuple[int, int]]:
    """Items of n words and rows of ``windows`` that share a key."""
    table, owner = index.tables[n]
    mine = keys(windows)
    flat = mine.ravel()
    left, right = np.searchsorted(table, flat, "left"), np.searchsorted(table, flat, "right")
    rows = np.flatnonzero(right > left)
    many = (right - left)[rows]
    parts = np.searchsorted(np.cumsum(many), np.arange(PAIRS, many.sum() + PAIRS, PAIRS))
    found = np.zeros(0, np.int64)
    for part in np.split(np.arange(len(rows)), np.unique(parts[parts < len(rows)] + 1)):
        k = many[part]
        hit = np.repeat(left[rows[part]] - np.cumsum(k) + k, k) + np.arange(k.sum())
        found = np.unique(np.concatenate([found, owner[hit] * len(windows) + np.repeat(rows[part] // mine.shape[1], k)]))
    return [divmod(int(x), len(windows)) for x in found]


def match(index: Index, text: str | None) -> list[tuple[int, int, int, int]]:
    """``(item_id, distance, first word, item words)`` of every item in the text, each at its best place."""
    if not text or not index.tables:
        return []
    get = index.vocabulary.get
    found = tokenize(text)
    if not found:
        return []
    ids = np.fromiter(map(get, found, repeat(0)), np.int64, len(found))
    code = ids[:-1] * np.int64(len(index.vocabulary) + 1) + ids[1:]
    code[(ids[:-1] == 0) | (ids[1:] == 0)] = -1
    open_at = _starts(index, code)
    if not open_at:
        return []
    padded = np.concatenate([ids, np.zeros(max(open_at), np.int64)])
    best: dict[int, tuple[int, int]] = {}
    for n, (starts, passes) in open_at.items():
        e, read, some = index.edits(n), {}, max(1, WINDOW_WORDS // n)
        while len(starts):
            part, starts = starts[:some], starts[some:]
            windows = padded[part[:, None] + np.arange(n)]
            if index.always:
                held = (windows > 0).sum(axis=1) >= n - e  # others share too few words with any item
                part, windows = part[held], windows[held]
            for o, r in _candidates(index, n, windows) if len(part) else ():
                start = int(part[r])
                if start <= read.get(o, -1):
                    continue  # the region already read has it
                first, read[o] = max(0, start - e), start + n - 1
                d, end = best_match(list(index.items[o]), ids[first : start + 2 * n + e].tolist())
                if d <= e:
                    place = (d, max(0, first + end - n + 1))
                    best[o] = min(best.get(o, place), place)
            # Where every item that is looked for has been read already no window is needed.
            starts = starts[starts > min(read.get(o, -1) for o in passes)]
    return sorted((i, d, at, len(index.items[o])) for o, (d, at) in best.items() for i in index.ids[o])


def with_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "matches", max_rate: float = MAX_RATE, block: int = BLOCK) -> DataFrame:
    """``docs`` with an array of the benchmark items found in each text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null")
    n = items.count()
    blocks, index = max(1, -(-n // block)), []
    for k in range(blocks if n else 0):
        rows = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        index.append(shared(docs, build(rows, max_rate)))
    if not index:
        return docs.withColumn(out, F.array().cast(_MATCH))
    # Marked so that a filter on the result, such as explode brings, does not run it a second time.
    return docs.withColumn(out, F.pandas_udf(_finder(index), _MATCH).asNondeterministic()(F.col(text_col)))


def _finder(index):
    """Matches every block in turn; of several, only the one at work is kept unpacked."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            found: list[list] = [[] for _ in texts]
            for get in index:
                block = get()
                for own, t in zip(found, texts, strict=True):
                    own += match(block, t)
                if len(index) > 1:
                    block = None
                    get.forget()
            yield pd.Series(found)

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, distance, start, item_words``."""
    found = with_matches(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.distance", "m.start", "m.item_words")
