"""Fill-in-the-middle rows, cut at token boundaries by succinct rank and select.

A token is a word with the blanks before it; blanks at the end of a text are one more.  A batch of texts is one
buffer of UTF-8 bytes, and ``Boundaries`` holds one bit a byte of it: set where a token ends.  The bits are packed into
64-bit words with a directory of the set bits before every block of ``BLOCK_WORDS`` words, an eighth of the text and
little more.  Set bits between the ends of a text give its count of tokens n; a cut after k tokens is one select.

A keyed hash of the id chooses two cuts, whether the row is changed and which form it takes.  Python gives two byte
cuts a text; Spark cuts and joins texts, which never leave it as Python strings.

Defined results
    null or empty text     counts as empty: no token, form plain, output empty
    text with a sentinel   form plain: what is not cut needs no escape
    null doc_id            hashed as the empty text
    repeated rows, ties    one result row each; rows of the same id and text are cut alike
    very long texts        cost and memory are linear in the text
    empty table            empty result
    clashing columns       ignored; only the two named columns are read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: 64-bit words a block of the directory; bytes that are classified at once.
BLOCK_WORDS, PIECE = 8, 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Boundaries:
    """Rank and select over the token ends of a buffer of texts, text i being bytes ``offsets[i]`` to ``offsets[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        data = data[base : base + size]
        blocks = size // (64 * BLOCK_WORDS) + 1
        packed = np.zeros(blocks * BLOCK_WORDS * 8, np.uint8)
        for k in range(0, size, PIECE):  # PIECE is whole bytes of bits
            blank = _BLANK[data[k : k + PIECE + 1]]
            ends = ~blank[:PIECE]
            ends[: len(blank) - 1] &= blank[1:]
            if len(blank) <= PIECE:
                ends[-1] = True
            packed[k // 8 : k // 8 + (len(ends) + 7) // 8] = np.packbits(ends, bitorder="little")
        # A text's last byte ends a token whatever follows.
        last = (offsets[1:] - base - 1)[offsets[1:] > offsets[:-1]]
        np.bitwise_or.at(packed, last >> 3, (1 << (last & 7)).astype(np.uint8))
        self.base, self.words = base, packed.view("<u8")
        self.directory = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64))))

    def _counts(self, block: np.ndarray) -> np.ndarray:
        """Set bits of each word of some blocks."""
        return np.bitwise_count(self.words.reshape(-1, BLOCK_WORDS)[block]).astype(np.int64)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Set bits before each byte of the buffer."""
        place = place - self.base
        word = place >> 6
        block, inside = word // BLOCK_WORDS, word % BLOCK_WORDS
        before = np.where(np.arange(BLOCK_WORDS) < inside[:, None], self._counts(block), 0).sum(axis=1)
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.directory[block] + before + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte after that of the k-th set bit, counted from 1."""
        block = np.searchsorted(self.directory, k, "left") - 1
        rest, upto = k - self.directory[block], np.cumsum(self._counts(block), axis=1)
        inside = (upto < rest[:, None]).sum(axis=1)
        rest = rest - np.where(inside > 0, upto[np.arange(len(k)), inside - 1], 0)
        word = block * BLOCK_WORDS + inside
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").cumsum(axis=1, dtype=np.int64)
        return self.base + word * 64 + (bits < rest[:, None]).sum(axis=1) + 1


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text and the bytes of it before the first and the second cut."""
    ends = Boundaries(data, offsets)
    ranks = ends.rank(offsets)
    n = np.diff(ranks)
    a, b = h1 % (n + 1), h2 % (n + 1)
    out = [n]
    for k in (np.minimum(a, b), np.maximum(a, b)):
        at, some = np.zeros(len(n), np.int64), k > 0
        at[some] = ends.select(ranks[:-1][some] + k[some]) - offsets[:-1][some]
        out.append(at)
    return tuple(out)


def _cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, h1, h2 in batches:
        data, offsets = utf8(texts)
        found = cuts(data, offsets, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)) if len(texts) else [np.zeros(0, np.int64)] * 3
        yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["n", "first", "second"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``id_col``, ``n`` (tokens), ``form``, ``output`` and, unless ``form`` is plain, ``prefix``, ``middle`` and ``suffix``.

    Of a hundred rows some ``rate`` are changed, and of these some ``spm`` take the form suffix, prefix, middle; others prefix, suffix, middle.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), digest.alias("digest"))
    rows = rows.select("id", "t", *(h(k).alias(f"h{k}") for k in (1, 2, 3, 4)))
    plain = (F.col("t") == "") | F.col("t").contains(PREFIX) | F.col("t").contains(SUFFIX) | F.col("t").contains(MIDDLE) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("id", "t", form.alias("form"), F.arrow_udf(_cut, "n long, first long, second long")("t", "h1", "h2").alias("cut"))
    raw, first, second = F.col("t").cast("binary"), F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    part = lambda start, length: F.when(F.col("form") != "plain", F.substring(raw, start + 1, length).cast("string"))
    rows = rows.select("id", "t", "form", F.col("cut.n").alias("n"), part(F.lit(0), first).alias("prefix"), part(first, second - first).alias("middle"), part(second, F.octet_length("t") - second).alias("suffix"))
    p, m, s = (F.concat(F.lit(mark), F.col(name)) for mark, name in ((PREFIX, "prefix"), (MIDDLE, "middle"), (SUFFIX, "suffix")))
    output = F.when(F.col("form") == "spm", F.concat(s, p, m)).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.col("t"))
    return rows.select(F.col("id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.  Changed texts hold no sentinel, so the three of an output part it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    at = lambda k: F.element_at(parts, k)
    return F.when(form == "spm", F.concat(at(3), at(4), at(2))).when(form == "psm", F.concat(at(2), at(4), at(3))).otherwise(output)
