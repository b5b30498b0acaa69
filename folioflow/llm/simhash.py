"""SimHash near-duplicates by ball hashing that meets in the middle.

Two fingerprints at distance 3 or less meet at a point at most 2 bits from one and
1 bit from the other.  Every fingerprint emits all points within half the radius that a
meeting can need: itself, all 64 points one flip away and, if its weight is even, the
992 points two flips away whose flips lie in one half of the word.  That loses nothing:
of any three differing bits two lie in one half, and of a pair at odd distance one end
has even weight.  The points are shuffled and sorted; all that share one are tied to the
one nearest to it, within 1 bit, so each tie is a real link, and verified.  At most 2081
distinct fingerprints lie within 2 bits of a point, so a group is bounded whatever the
data.  Exact copies are folded first.

Three bits of 64 are a narrow rule: edited copies often differ by more.  With
``similarity`` texts are linked as well whose sets of ``words``-word shingles have at
least that Jaccard similarity.  No radius that balls can afford reaches such pairs (at 0.8
some 10 of 64 bits differ), so their candidates are texts that share a band of least
hashes; every candidate is verified on its whole texts.  First each text meets the first
text of its bands, which connects most of any group of copies.  Whatever is still apart then
meets all others of its band in bands of up to ``BAND_PAIRS`` texts, and in larger ones ``HUBS``
others a band, those that a sketch of ``SKETCH`` least hashes shows to be near, in up to ``TURNS``
turns.  Then texts of larger bands that are still apart meet in full: every pair whose sketches
show it to be near is verified, unless links found before connect it.

Defined results
    null or empty text     no words: fingerprint zero, linked like any other
    null doc_id            has its fingerprint and its component's smallest id; never an id of a component unless no other exists (then null)
    repeated rows          one result row each
    ties                   the smallest id names a component, whatever the order of rows
    very long texts        cost is linear in the text
    empty table            empty result
    clashing columns       ignored; only the two named columns are read
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, ShortType, StructField, StructType

from .common import checkpointed, release, sent, spread
from .components import FEW, components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: A pair of Jaccard similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 20, or 0.9996; one of 0.3 with 0.05.
BANDS, BAND_ROWS, BAND_PAIRS, HUBS = 20, 5, 16, 16
#: Turns in which texts of large bands meet some others; texts in a block when they meet all.
TURNS, BLOCK = 2, 1024
#: At similarity 0.8 the places in which two sketches agree are under ``NEAR`` with probability 0.0002.
SKETCH, NEAR = 64, 39
_HALF = BITS // 2
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text's three-word shingles."""
    import xxhash

    if not text:
        return 0
    found = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return 0
    if len(found) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    digest, line = xxhash.xxh64_intdigest, b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints as signed longs with the same bits."""
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64), dtype="int64")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_ONE = [_signed(1 << i) for i in range(BITS)]
_TWO = [_signed(1 << i | 1 << j) for h in (0, _HALF) for i in range(h, h + _HALF) for j in range(i + 1, h + _HALF)]


def _points(fp: Column) -> Column:
    """The points that a fingerprint emits."""
    masks = F.array(*map(F.lit, [0, *_ONE, *_TWO]))
    sent = F.slice(masks, F.lit(1), F.when(F.bit_count(fp) % 2 == 0, 1 + len(_ONE) + len(_TWO)).otherwise(1 + len(_ONE)))
    return F.transform(sent, lambda m: fp.bitwiseXOR(m))


def links(prints: DataFrame) -> DataFrame:
    """Verified links ``a``, ``b`` that connect whatever distinct fingerprints ``fp`` lie within the radius of each other."""
    points = spread(prints.select("fp"), "fp").select("fp", F.explode(_points(F.col("fp"))).alias("point"))
    # A window sorts what it gathers and spills; unlike an aggregation it does not hash every point before the shuffle in vain.
    nearest = Window.partitionBy("point").orderBy(distance(F.col("point"), F.col("fp")), "fp")
    met = points.select("point", F.col("fp").alias("a"), F.first("fp").over(nearest).alias("b"))
    a, b = F.col("a"), F.col("b")
    return met.where((a != b) & (distance(F.col("point"), b) <= 1) & (distance(a, b) <= RADIUS)).select("a", "b").distinct()


def shingles(text: str | None, words: int) -> set[bytes]:
    """The runs of so many words of a text; all its words where there are fewer."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def codes(text: str, words: int) -> np.ndarray:
    """A number for every distinct shingle, in order."""
    import xxhash

    found = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(found)}
    word = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    runs = max(1, len(word) - words + 1) if len(word) else 0
    code = np.zeros(runs, np.uint64)
    for k in range(min(words, len(word))):
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[k : k + runs]
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(code ^ (code >> np.uint64(32)))


_KEYS = StructType([StructField("bands", ArrayType(LongType())), StructField("sketch", ArrayType(ShortType()))])


def _bands(words: int):
    """``BANDS`` keys of each text, each of ``BAND_ROWS`` least hashes of its shingles, and 16 bits of the first ``SKETCH``; none without a word."""
    n = BANDS * BAND_ROWS
    draw = np.random.default_rng(SEED)
    mul, add = draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, np.uint64)

    def keys(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in texts:
            out = []
            for text in batch:
                hashes = codes(text, words) if isinstance(text, str) else np.zeros(0, np.uint64)
                least = np.full(n, (1 << 64) - 1, np.uint64)
                for k in range(0, len(hashes), 1024):
                    least = np.minimum(least, (hashes[k : k + 1024, None] * mul + add).min(axis=0))
                bands = [_signed(xxhash.xxh64_intdigest(r.tobytes(), i)) for i, r in enumerate(least.reshape(BANDS, BAND_ROWS))]
                sketch = (least[:SKETCH] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16).view(np.int16).tolist()
                out.append((bands, sketch) if len(hashes) else ([], []))
            yield pd.DataFrame(out, columns=["bands", "sketch"])

    return keys


def _verified(docs: DataFrame, pairs: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` of the labels of those pairs of texts (``x``, ``y``: digests) that are similar."""
    pairs = checkpointed(pairs)
    ends = pairs.select(F.col("x").alias("d")).unionByName(pairs.select(F.col("y").alias("d"))).distinct()
    # Few digests go to the texts, so that only the texts asked for move.
    texts = docs.select(F.xxhash64(text_col).alias("d"), F.col(text_col).alias("text")).join(sent(ends), "d", "left_semi")
    texts = checkpointed(texts.dropDuplicates(["d"]))
    both = pairs.join(texts.select(F.col("d").alias("x"), F.col("text").alias("s")), "x").join(texts.select(F.col("d").alias("y"), F.col("text").alias("t")), "y")

    def close(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(lefts, rights, strict=True):
            u, v = shingles(s, words), shingles(t, words)
            out.append(bool(u) and len(u & v) >= similarity * len(u | v))
        return pd.Series(out, dtype=bool)

    return both.where(F.pandas_udf(close, BooleanType())("s", "t")).select("a", "b").distinct()


def _relabelled(held: DataFrame, found: DataFrame, few: int = 0) -> DataFrame:
    """``held`` with each ``label`` replaced by that of the component the links put it in; up to ``few`` links are followed in one task."""
    new = components(found, few=few).withColumnRenamed("label", "to")
    return held.join(new, F.col("label") == F.col("node"), "left").withColumn("label", F.coalesce("to", "label")).drop("node", "to")


def _pairs(rows: DataFrame, me: Column, other: Column) -> DataFrame:
    """Pairs of texts (``x``, ``y``) and of what they are known by (``a``, ``b``), the lesser first, each once."""
    low, high = F.least(me, other), F.greatest(me, other)
    pairs = rows.where(me.label != other.label).select(low.alias("l"), high.alias("h"))
    return pairs.select(F.col("l.digest").alias("x"), F.col("l.label").alias("a"), F.col("h.digest").alias("y"), F.col("h.label").alias("b")).distinct()


def _cells(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` of groups of ``n``, cut into blocks of some ``BLOCK`` by their ``digest``: a copy for each pair of blocks (``i``, ``j``) that holds the row's own ``block``."""
    blocks = F.ceil(F.col("n") / BLOCK)
    cut = rows.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("digest", F.lit("block")), blocks)})
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    return cut.withColumn("cell", F.explode(cells)).select(*rows.columns, "block", "cell.i", "cell.j").groupBy(group, "i", "j")


def _linked(frame: pd.DataFrame, verified: Callable[[int, int], bool]) -> pd.DataFrame:
    """Links ``a``, ``b`` that connect the labels of a cell: all pairs of texts from its two blocks whose sketches agree in ``NEAR`` places are ``verified`` unless they are connected already."""
    label, block = frame["label"].to_numpy(np.int64), frame["block"].to_numpy()
    out, i, j = [], frame["i"].iloc[0], frame["j"].iloc[0]
    if (label != label[0]).any():
        sketch, root = np.array(frame["sketch"].tolist(), np.int16), label.copy()
        place = np.arange(len(label))
        for k in np.flatnonzero(block == i):
            others = np.flatnonzero((root != root[k]) & ((place > k) if i == j else (block == j)))
            alike = (sketch[others] == sketch[k]).sum(axis=1)
            for o in others[np.argsort(-alike, kind="stable")[: (alike >= NEAR).sum()]]:
                if root[o] != root[k] and verified(k, o):
                    out.append((label[k], label[o]))
                    root[root == root[o]] = root[k]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _whole(docs: DataFrame, large: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Links ``a``, ``b`` of labels by the similar texts in bands of ``large``, every pair of a band that looks near compared.

    First sketches alone meet, band by band.  They tell the families of labels that links could connect; then the texts of
    a family meet, so a text moves once for every block of its family, not for every band.
    """
    some = checkpointed(_cells(large.select("band", "n", "digest", "label", "sketch"), "band").applyInPandas(lambda frame: _linked(frame, lambda k, o: True), "a long, b long"))
    family = components(some, few=FEW)
    members = large.select("digest", "label", "sketch").distinct().join(family.select(F.col("node").alias("label"), F.col("label").alias("family")), "label")
    members = checkpointed(members)
    members = members.join(members.groupBy("family").agg(F.count("*").alias("n")), "family")
    texts = docs.select(F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text")).join(sent(members.select("digest")), "digest", "left_semi")

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        text, held = frame["text"], {}

        def found(k: int) -> np.ndarray:
            if k not in held:
                held[k] = codes(text.iloc[k], words)
            return held[k]

        def verified(k: int, o: int) -> bool:
            u, v = found(k), found(o)
            if min(len(u), len(v)) < similarity * max(len(u), len(v)):
                return False
            both = len(np.intersect1d(u, v, assume_unique=True))
            if both < similarity * (len(u) + len(v) - both):
                return False
            u, v = shingles(text.iloc[k], words), shingles(text.iloc[o], words)
            return len(u & v) >= similarity * len(u | v)

        return _linked(frame, verified)

    return checkpointed(_cells(members.join(texts.dropDuplicates(["digest"]), "digest"), "family").applyInPandas(compared, "a long, b long"))


def similar(docs: DataFrame, texts: DataFrame, near: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """``fp`` and ``label`` of every fingerprint once similar texts are linked besides ``near``.

    ``texts``: the distinct ``digest``, ``fp``, ``bands`` and ``sketch``.
    """
    dealt = texts.select("digest", "fp", F.explode("bands").alias("band"))
    # Most bands are one text's own: what is kept is the rest.
    shared = dealt.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    held = checkpointed(dealt.join(shared, "band"))
    # Every text and the first text of each band it is in: the same text in many bands, so that few pairs arise.
    hubs = held.groupBy("band").agg(F.min(F.struct(F.xxhash64("digest", F.lit(0)).alias("o"), "digest", F.col("fp").alias("label"))).alias("h"))
    me = F.struct("digest", F.col("fp").alias("label"))
    found = _verified(docs, _pairs(held.join(hubs, "band"), me, F.struct("h.digest", "h.label")), text_col, words, similarity)
    labels = texts.select("fp").distinct().withColumn("label", F.col("fp"))
    labels = checkpointed(_relabelled(labels, near.unionByName(found), FEW))
    turn, me = 0, F.struct("digest", "label")
    while True:
        # Bands whose texts are all connected drop out for good.
        named = held.select("digest", "fp", "band", "n").join(labels, "fp")
        apart = named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band")
        held = checkpointed(named.join(apart, "band"))
        # Others of a large band in orders of its own, new in every turn.
        large = held.where(F.col("n") > BAND_PAIRS).join(texts.select("digest", "sketch"), "digest")
        others = [F.min(F.struct(F.xxhash64("digest", "band", F.lit(turn * HUBS + k)).alias("o"), "digest", "label", "sketch")).alias(f"h{k}") for k in range(HUBS)]
        hubs = large.groupBy("band").agg(*others).select("band", F.array_distinct(F.array(*(f"h{k}" for k in range(HUBS)))).alias("hubs"))
        alike = lambda h: F.aggregate(F.zip_with(h.sketch, "sketch", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
        close = F.filter(F.transform("hubs", lambda h: F.struct(alike(h).alias("alike"), h.digest.alias("digest"), h.label.alias("label"))), lambda h: (h.label != F.col("label")) & (h.alike >= NEAR))
        met = large.join(hubs, "band").select("digest", "label", F.explode(close).alias("h"))
        # One link ties a text to a component: of each component a text is compared with the nearest it met.
        met = met.groupBy("digest", "label", F.col("h.label").alias("to")).agg(F.max("h").alias("h"))
        met = met.select(me.alias("m"), F.struct("h.digest", "h.label").alias("h"))
        if turn == 0:
            small = held.where(F.col("n") <= BAND_PAIRS).groupBy("band").agg(F.collect_list(me).alias("all"))  # at most BAND_PAIRS
            met = met.unionByName(small.select(F.explode("all").alias("m"), "all").select("m", F.explode(F.filter("all", lambda o: o.digest > F.col("m.digest"))).alias("h")))
        found = checkpointed(_verified(docs, _pairs(met, F.col("m"), F.col("h")), text_col, words, similarity))
        last = found.isEmpty()
        if not last:
            labels = checkpointed(_relabelled(labels, found, FEW))
        turn += 1
        if last or turn == TURNS:
            break
    # Those turns connect most at little cost; what is still apart in the large bands is compared in full.
    large = held.where(F.col("n") > BAND_PAIRS).select("digest", "fp", "band", "n").join(labels, "fp").join(texts.select("digest", "sketch"), "digest")
    found = _whole(docs, checkpointed(large), text_col, words, similarity)
    return labels if found.isEmpty() else checkpointed(_relabelled(labels, found, FEW))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, words: int = 5) -> DataFrame:
    """``id``, ``digest`` (xxhash64 of the text), ``fp``, ``label`` (of the component) and ``component_id`` of every row; see ``near_duplicates``."""
    columns = [F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.pandas_udf(fingerprints, LongType())(text_col).alias("fp")]
    if similarity is not None:
        columns.append(F.pandas_udf(_bands(words), _KEYS)(text_col).alias("keys"))
    rows = checkpointed(docs.select(*columns))
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    near = links(prints)
    if similarity is None:
        labels = _relabelled(prints.withColumn("label", F.col("fp")), near)
    else:
        texts = rows.groupBy("digest").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")).select("digest", "fp", "keys.*")
        near, texts = checkpointed(near), checkpointed(texts)
        release(docs.sparkSession)  # the points that were dealt out
        found = similar(docs, texts, near, text_col, words, similarity)
        labels = prints.join(found, "fp")
    ids = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labels.join(ids, "label").select("fp", "label", "component_id")
    return rows.join(named, "fp").select("id", "digest", "fp", "label", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, words: int = 5) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` (smallest id reachable) of every row.

    With ``similarity`` texts whose Jaccard similarity of shingles of ``words`` words is at least that are linked as well.
    """
    rows = labelled(docs, id_col, text_col, similarity, words)
    return rows.select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id")
