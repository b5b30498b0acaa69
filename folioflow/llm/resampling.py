"""Importance resampling towards a target: a draw of the documents whose hashed n-grams are likelier in the target.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.  Features are all runs of
1 to ``n`` words joined by a space, counted into ``buckets`` by the crc32 of their bytes.  A bucket's gain is 1000 times
the logarithm of its smoothed share in the target over that in the documents; a document's weight is the mean gain of its
features.  Gumbel noise, keyed by the id, is added, and the highest scores are drawn: a draw without replacement in
proportion to the exponential of the weights.

Bytes are never walked in Python: a lookup table classifies a whole Arrow buffer, words begin and end where classes
differ, and the table-driven CRCs of all words of a piece advance together, one byte a step, the longest first, so that
those still running are a prefix.  A feature of two words goes on from the state of the first.

Two passes read the texts: one counts, one weighs.  Between them at most ``buckets`` numbers meet on the driver.  Ranks
come from a sort by ranges of the few numbers a document has; texts are not shuffled.

Defined results
    null or empty text     no word: weight 0, never drawn (unless ``least_words`` is 0)
    null doc_id            noise as of the empty text
    repeated rows          one result row each, with a rank of its own; counted as often as they occur
    ties                   to the smaller id, null first; among rows that agree in both the order is open
    very long texts        whole; memory is that of a piece of ``PIECE`` words, time is linear
    empty tables           no documents: empty result; no target: every gain compares with none
    clashing columns       ignored; only the two named columns are read
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, shared, utf8

BUCKETS, WORDS, SEED, PERCENT, LEAST_WORDS, SCALE = 10_000, 2, 7, 25, 20, 1000
#: Words whose CRCs advance together; bytes that are classified at once; steps after which the few longer words are finished one by one.
PIECE, BYTES, STEPS = 1 << 18, 1 << 22, 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def _crc_table() -> np.ndarray:
    """What each byte does to a reflected CRC of the polynomial that zip files use."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes where the words of a lower-cased buffer start and end, and the words before each text's end: text i has words ``upto[i]`` to ``upto[i + 1]``."""
    starts, ends = [], []
    first = np.zeros(0, np.int64)
    cut = np.unique(offsets)
    for lo in range(int(offsets[0]), int(offsets[-1]), BYTES):
        hi = min(lo + BYTES, int(offsets[-1]))
        inside = _IN_WORD[data[lo:hi]]
        before = np.concatenate(([lo > offsets[0] and bool(_IN_WORD[data[lo - 1]])], inside[:-1]))
        heads = cut[np.searchsorted(cut, lo) : np.searchsorted(cut, hi)] - lo
        begins, stops = inside & ~before, ~inside & before
        # A text's first byte goes on with no word of the text before.
        stops[heads] |= before[heads]
        begins[heads] |= inside[heads]
        starts.append(np.flatnonzero(begins) + lo)
        ends.append(np.flatnonzero(stops) + lo)
    starts = np.concatenate(starts) if starts else first
    ends = np.concatenate([*ends, [offsets[-1]]]) if ends else first
    ends = ends[: len(starts)]
    return starts, ends, np.searchsorted(starts, offsets)


def advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states after the bytes from each start to its end, all starts advancing together."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, STEPS + 1), kind="stable")
    crc, at = state[order], starts[order]
    # Of the words in order, those longer than k are the first running[k].
    running = len(sizes) - np.cumsum(np.bincount(np.minimum(sizes, STEPS + 1), minlength=STEPS + 2))
    for k in range(STEPS):
        m = running[k]
        if not m:
            break
        now = crc[:m]
        crc[:m] = _TABLE[(now ^ data[at[:m] + k]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc
    for i in order[: running[STEPS]]:
        out[i] = zlib.crc32(data[starts[i] + STEPS : ends[i]], int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Features of so many words, piece by piece: their number of words, the crc32 of each and the text it is of.  ``data`` is lower-cased."""
    starts, ends, upto = word_bounds(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(upto))
    for k in range(0, len(starts), PIECE):
        stop = min(k + PIECE, len(starts))
        at, state = np.arange(k, stop), np.full(stop - k, 0xFFFFFFFF, np.uint32)
        for size in range(n):
            if size:
                stays = at + size < upto[text[at] + 1]
                at, state = at[stays], state[stays]
                state = _TABLE[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> np.uint32(8))
            if not len(at):
                break
            state = advanced(state, data, starts[at + size], ends[at + size])
            yield size + 1, state ^ np.uint32(0xFFFFFFFF), text[at]


def _counts(buckets: int, n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                data, offsets = utf8(batch.column(0))
                for _, crc, _ in features(_LOWER[data], offsets, n):
                    total += np.bincount(crc % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["bucket", "n"])

    return count


def histogram(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, n: int = WORDS) -> DataFrame:
    """``bucket`` and ``n``, the features of all texts in it; each task sends its own sums."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return texts.mapInArrow(_counts(buckets, n), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, n: int = WORDS) -> np.ndarray:
    """Each bucket's gain; ``buckets`` numbers of either table meet here."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for held, df, column in ((s, docs, text_col), (t, target, target_col)):
        for row in histogram(df, column, buckets, n).collect():
            held[row.bucket] = row.n
    all_s, all_t = int(s.sum()), int(t.sum())
    ratio = lambda a, b: float(b + 1) * float(all_s + buckets) / (float(a + 1) * float(all_t + buckets))
    return np.array([math.floor(SCALE * math.log(ratio(a, b))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _weighed(gain, buckets: int, n: int):
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = utf8(texts)
            words, count, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for size, crc, text in features(_LOWER[data], offsets, n):
                each = np.bincount(text, minlength=len(texts))
                words, count = words + each * (size == 1), count + each
                # Sums of whole numbers under 2^53 are exact as doubles.
                total += np.bincount(text, gain()[crc % buckets], len(texts)).astype(np.int64)
            weight = total // np.maximum(count, 1)
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (words, count, weight)], ["n_words", "n_features", "weight"])

    return weigh


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, n: int = WORDS, seed: int = SEED) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every document."""
    gain = shared(docs, gains(docs, target, text_col, target_col, buckets, n))
    weigh = F.arrow_udf(_weighed(gain, buckets, n), "n_words long, n_features long, weight long")
    rows = docs.select(F.col(id_col).alias("id"), weigh(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).select("id", "w.*")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise.cast("long"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """``id_col``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document; ``rank`` is null unless it is drawn.

    ``percent`` of the documents of at least ``least_words`` words are drawn, from the highest score down.
    """
    rows = importance_weights(docs, target, id_col, text_col, target_col, **options)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Numbers of a document alone are dealt by ranges; rows that agree in all else are told apart by their place.
    keys = [F.col("score").desc(), F.col("id").asc(), F.col("row").asc()]
    rows = checkpointed(rows).withColumn("row", F.monotonically_increasing_id())
    able = checkpointed(rows.where(F.col("n_words") >= least_words).repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))
    sizes = able.groupBy("part").agg(F.count("*").alias("rows"))  # one row a partition
    upto = Window.orderBy("part")
    sizes = sizes.select("part", (F.sum("rows").over(upto) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("all"))
    placed = able.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*keys))).join(F.broadcast(sizes), "part")
    rank = (F.col("before") + F.col("k")).cast("long")
    drawn = F.when(rank <= F.floor(F.col("all") * percent / 100), rank)
    placed = placed.select("id", "n_features", "weight", "score", drawn.alias("rank"))
    rest = rows.where(F.col("n_words") < least_words).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return placed.unionByName(rest).withColumnRenamed("id", id_col)
