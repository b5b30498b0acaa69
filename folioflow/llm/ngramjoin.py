"""Jaccard join of texts on sets of word n-grams: rare-first prefix filtering, each pair verified once.

Exact copies of a set are folded by a 128-bit digest; what follows is about the distinct sets.

Order.  All n-grams are ordered by how often they occur, rarest first, then by their hash.  Frequencies come from a
sketch of ``CELLS`` counters, a megabyte whatever the data: n-grams that share a counter count as equally frequent.  Any
order gives the same links; a good one keeps n-grams that many texts share out of the prefixes.
Prefix filter.  Of a set of n only the first n - ceil(t n) + 1 n-grams are joined on; sets as similar as t share one.
Length filter.  Sizes differ by a factor of t at most.  A group that shares an n-gram is sorted by size, so partners are
a run of it; groups of over ``BLOCK`` sets are cut into blocks, each pair of which meets in a task.
Positional filter.  Where the first shared n-gram is the i-th and j-th, it and what follows it are all that can be shared.
Suffix filter.  Pivots part the n-grams into ``PARTS`` ranges; sums of the differences of counts bound the symmetric
difference from below.  This takes the whole sets, prefixes too, so it stands whichever n-gram was met on.
Verification.  What is left is verified on the whole sets, once a pair.

Links only have to connect: turn by turn each set meets the nearest one, then some, then all of its run, and only those
that no link connects yet.  So a family of copies costs as many verifications as it has members, not pairs.

Defined results
    null or empty text     an empty set: linked with nothing
    null doc_id            has its component's smallest id; never an id of a component unless no other exists (then null)
    repeated rows          one result row each
    ties                   the smallest id names a component, whatever the order of rows
    very long texts        whole; cost is that of sorting the n-grams
    empty table            empty result
    clashing columns       ignored; only the two named columns are read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, sent, shared
from .components import FEW, components
from .simhash import codes

WORDS, PERCENT = 4, 85
#: Counters of the sketch and how many of them travel together; ranges that the suffix filter counts.
CELLS, RUN, PARTS = 1 << 20, 1 << 12, 64
#: Sets in a block of a group; those before it that a set meets in the first turns; pairs made at once.
BLOCK, NEAREST, PAIRS = 4096, (1, 16), 1 << 20


def _least(n, percent: int):
    """The least size of a set as similar to one of n."""
    return (n * percent + 99) // 100


def _frequencies(words: int):
    """Each task's counters, as rows of ``RUN`` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(cells, (codes(text.as_py(), words) % np.uint64(CELLS)).astype(np.int64), 1)
        runs = [r for r in range(CELLS // RUN) if cells[r * RUN : (r + 1) * RUN].any()]
        for r in runs:
            yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([cells[r * RUN : (r + 1) * RUN].tolist()], pa.list_(pa.int64()))], ["run", "counts"])

    return count


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        counts = batch.column("counts")
        for r, row in zip(batch.column("run").to_pylist(), counts.flatten().to_numpy(zero_copy_only=False).reshape(len(counts), -1), strict=True):
            total[r] = total[r] + row if r in total else row.copy()
    for r, row in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([row.tolist()], pa.list_(pa.int64()))], ["run", "counts"])


def rarity(texts: DataFrame, words: int) -> np.ndarray:
    """A class of frequency for each counter, four to a doubling; at most ``CELLS`` counters meet here."""
    schema = "run long, counts array<long>"
    runs = texts.mapInArrow(_frequencies(words), schema).repartition("run").mapInArrow(_summed, schema).collect()
    cells = np.zeros(CELLS, np.int64)
    for row in runs:
        cells[row.run * RUN : (row.run + 1) * RUN] += row.counts
    return np.floor(4 * np.log2(np.maximum(cells, 1))).astype(np.uint8)


_SET = "n long, digest binary, prefix array<long>, parts array<int>"


def _sets(classes, words: int, percent: int):
    """Size, digest, prefix and counts by range of the set of each text.  A set too small to resemble another has no prefix."""

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        for texts in batches:
            sizes, digests, prefixes, parts = [], [], [], []
            for text in texts:
                code = codes(text.as_py(), words)
                n = len(code)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(code.tobytes()) if n else None)
                if 100 * n < percent * (n + 1):
                    prefixes.append([])
                    parts.append([])
                    continue
                order = np.argsort(classes()[(code % np.uint64(CELLS)).astype(np.int64)], kind="stable")
                prefixes.append(code[order[: n - _least(n, percent) + 1]].view(np.int64))
                parts.append(np.bincount((code >> np.uint64(58)).astype(np.int64), minlength=PARTS))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))], ["n", "digest", "prefix", "parts"])

    return found


def _met(percent: int, nearest: int | None):
    """Pairs ``a``, ``b`` of sets of a group (``tok``, ``i``, ``j``) that pass the length and the positional filter and are of different labels; rows come sorted by group and size.

    With ``nearest`` a set meets only so many before it.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tok", "i", "j", "n", "s", "pos", "label", "block"]
        held = {c: np.zeros(0, np.int64) for c in names}
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(held["n"])
            held = {c: np.concatenate((held[c], batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64))) for c in names}
            n, pos, s, label, block = (held[c] for c in ("n", "pos", "s", "label", "block"))
            new = np.concatenate(([False], (np.diff(held["tok"]) != 0) | (np.diff(held["i"]) != 0) | (np.diff(held["j"]) != 0)))
            group = np.cumsum(new)
            key = group << 40 | n
            me = np.arange(old, len(n))
            low = np.searchsorted(key, group[me] << 40 | _least(n[me], percent))
            if nearest:
                low = np.maximum(low, me - nearest)
            before = np.cumsum(me - low)
            for start in range(0, int(before[-1]), PAIRS):
                place = np.arange(start, min(start + PAIRS, int(before[-1])))
                row = np.searchsorted(before, place, "right")
                x = me[row]
                y = x - (before[row] - place)
                # The pair's first shared n-gram passes if the pair is similar: it and what follows it on either side are all that can be shared.
                most = np.minimum(n[x] - pos[x], n[y] - pos[y])
                good = (label[x] != label[y]) & ((held["i"][x] == held["j"][x]) | (block[x] != block[y])) & (most * (100 + percent) >= percent * (n[x] + n[y]))
                ab = np.unique(np.stack((np.minimum(s[x], s[y])[good], np.maximum(s[x], s[y])[good]), axis=1), axis=0)
                if len(ab):
                    yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])
            # Of the last group those stay that a longer set may yet meet.
            stays = (group == group[-1]) & (n >= _least(n[-1], percent))
            held = {c: v[stays] for c, v in held.items()}

    return pairs


def _shared(held: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of n-grams that sets of different labels share, with the label."""
    named = held.join(labels, "s")
    apart = named.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("tok")
    return named.join(apart, "tok")


def _candidates(held: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    blocks = F.ceil(F.col("m") / BLOCK)
    cut = held.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("s"), "blocks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    rows = cut.withColumn("cell", F.explode(cells)).select("tok", "cell.i", "cell.j", "n", "s", "pos", "label", "block")
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tok", "i", "j").sortWithinPartitions("tok", "i", "j", "n", "s").mapInArrow(_met(percent, nearest), "a long, b long").distinct()


def _links(docs: DataFrame, sets: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs of sets that are similar: by counts first, then by the whole sets.  ``docs``: ``t``, the key of a text, and ``text``."""
    x, y = (sets.select(F.col("s").alias(c), F.col("n").alias(f"n_{c}"), F.col("parts").alias(f"parts_{c}"), F.col("t").alias(f"t_{c}")) for c in "ab")
    near = pairs.join(x, "a").join(y, "b")
    apart = F.aggregate(F.zip_with("parts_a", "parts_b", lambda u, v: F.abs(u - v)), F.lit(0), lambda u, v: u + v)
    # n + m less twice the overlap, which is percent (n + m) / (100 + percent) at least.
    near = near.where(apart * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    near = checkpointed(near.select("a", "b", "n_a", "n_b", "t_a", "t_b"))
    ends = near.select(F.col("t_a").alias("t")).unionByName(near.select(F.col("t_b").alias("t"))).distinct()
    code = F.arrow_udf(lambda texts: pa.array([codes(t.as_py(), words).view(np.int64) for t in texts], pa.list_(pa.int64())), "array<long>")
    # The hint to broadcast is there for short lists only: then no text moves that is not asked for.
    whole = docs.join(sent(ends), "t", "left_semi").dropDuplicates(["t"])
    whole = checkpointed(whole.select("t", code("text").alias("code")))
    both = near.join(whole.select(F.col("t").alias("t_a"), F.col("code").alias("u")), "t_a").join(whole.select(F.col("t").alias("t_b"), F.col("code").alias("v")), "t_b")
    overlap = F.size(F.array_intersect("u", "v"))
    return both.where(overlap * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``id_col``, ``n_shingles`` (size of the set) and ``component_id`` (smallest id reachable by links) of every row.

    Sets link whose intersection is at least ``percent`` hundredths of their union.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    classes = shared(docs, rarity(texts, words))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))
    found = F.arrow_udf(_sets(classes, words, percent), _SET)(text)
    rows = checkpointed(docs.select(F.col(id_col).cast("long").alias("id"), key.alias("t"), found.alias("set")).select("id", "t", "set.*"))
    # Of equal sets any text will do; copies meet map-side.
    sets = rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min("t").alias("t"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts"))
    sets = checkpointed(sets.withColumn("s", F.monotonically_increasing_id()))
    toks = sets.select("s", "n", F.posexplode("prefix").alias("pos", "tok"))
    held = toks.withColumn("m", F.count("*").over(Window.partitionBy("tok"))).where("m > 1")
    held = checkpointed(held)
    labels = sets.select("s", F.col("s").alias("label")).join(held.select("s").distinct(), "s", "left_semi")
    keyed = docs.select(key.alias("t"), text.alias("text"))
    of = None
    links = tried = sets.sparkSession.createDataFrame([], "a long, b long")
    for nearest in (*NEAREST, None):
        now = checkpointed(_shared(held, labels))
        if now.isEmpty():
            break
        held = now.drop("label")
        pairs = checkpointed(_candidates(now, percent, nearest).join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        tried = tried.unionByName(pairs)
        links = checkpointed(links.unionByName(_links(keyed, sets, pairs, words, percent)))
        of = components(links, few=FEW)
        labels = checkpointed(labels.select("s").join(of.select(F.col("node").alias("s"), "label"), "s", "left").select("s", F.coalesce("label", "s").alias("label")))
    if of is None:
        of = links.toDF("node", "label")
    linked = sets.join(of.select(F.col("node").alias("s"), "label"), "s")
    ids = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "label").select("digest", "component_id")
    alone = sets.where("copies > 1").join(of.select(F.col("node").alias("s")), "s", "left_anti").select("digest", F.col("least").alias("component_id"))
    # Sets of one document without a link need no look-up: their component is their own id.
    out = rows.select("id", "n", "digest").join(sent(named.unionByName(alone)).withColumn("known", F.lit(True)), "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
