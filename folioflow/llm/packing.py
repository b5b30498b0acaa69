"""Optimal length buckets: dynamic programming over the global histogram, then token-budget batches.

The histogram counts every length over all documents, so its size is the number of
different lengths, not of documents.  Dynamic programming picks the bucket boundaries that
minimise padding over it, exactly; a bucket pads to the longest document in it.  Each
level of the program is a lower envelope of lines, so its cost grows with buckets times
lengths.  Inside a bucket rows get consecutive places from counts by the part of the
table they come from, never from one sorted task, and ``budget // bucket length`` of them
form a batch.

Tokens are the pieces of a pre-tokenizer pattern: runs of letters, runs of digits,
other characters.  ``n_tokens`` may be given instead.

Defined results
    null or empty text     zero tokens; the shortest bucket holds it
    null id                kept; ids are only carried along, null or repeated
    ties                   of equal paddings the smaller boundaries
    repeated rows          each has its own place
    very long texts        a document longer than the budget is a batch of its own
    empty table            empty result
    clashing columns       ignored; the result has its own columns
"""

from __future__ import annotations

from collections import deque
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

PIECES = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


def piece_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PIECES)), F.lit(0)).cast("long")


def boundaries(lengths: list[int], counts: list[int], k: int) -> list[int]:
    """Indexes of the lengths that end a bucket, at most ``k``, for the least total padding.

    ``lengths`` ascend.  The tokens themselves are the same however they are cut, so the
    least padding is the least padded total.
    """
    n, many = len(lengths), [0, *accumulate(counts)]
    best = [length * many[j + 1] for j, length in enumerate(lengths)]  # one bucket: all pads to the last
    back: list[list[int]] = [[-1] * n]
    for _ in range(1, min(k, n)):
        # A last bucket from i + 1 to j costs best[i] + length[j] * (many[j+1] - many[i+1]): a line in length[j] for each i.
        new, cut = best.copy(), [-1] * n
        hull: deque[int] = deque()

        def height(i: int, j: int, best: list[int] = best) -> int:
            return best[i] - lengths[j] * many[i + 1]

        def hidden(a: int, b: int, c: int, best: list[int] = best) -> bool:
            """Whether line b is nowhere below both a and c, whose slopes fall from a to c."""
            return (best[c] - best[a]) * (many[b + 1] - many[a + 1]) <= (best[b] - best[a]) * (many[c + 1] - many[a + 1])

        for j in range(1, n):
            while len(hull) > 1 and hidden(hull[-2], hull[-1], j - 1):
                hull.pop()
            hull.append(j - 1)
            while len(hull) > 1 and height(hull[1], j) < height(hull[0], j):
                hull.popleft()
            cost = height(hull[0], j) + lengths[j] * many[j + 1]
            if cost < new[j]:
                new[j], cut[j] = cost, hull[0]
        best = new
        back.append(cut)
    ends, j = [n - 1], n - 1
    for level in range(len(back) - 1, 0, -1):
        if back[level][j] >= 0:
            j = back[level][j]
            ends.append(j)
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = 12, budget: int = 65536, id_col: str = "doc_id", text_col: str = "text", n_tokens: Column | None = None) -> DataFrame:
    """``id_col, n_tokens, bucket, bucket_len, batch_id, place, padding`` of every row."""
    count = piece_count(F.col(text_col)) if n_tokens is None else F.coalesce(n_tokens, F.lit(0)).cast("long")
    # Texts are counted once; ids and counts are all that is used from here on.
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), count.alias("n"), F.spark_partition_id().alias("part")))
    cells = rows.groupBy("n").agg(F.count("*").alias("rows")).orderBy("n").collect()  # one row a length
    ends = [cells[i].n for i in boundaries([r.n for r in cells], [r.rows for r in cells], buckets)] if cells else [0]
    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n") <= ends[i], i).otherwise(bucket)
    # A part of the table is as large as a task reads, so however many rows a bucket has, none numbers more.
    rows = rows.withColumn("bucket", bucket)
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("id", "n")))
    sizes = rows.groupBy("bucket", "part").agg(F.count("*").alias("rows"))
    offsets = sizes.withColumn("before", F.sum("rows").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    joined = placed.join(offsets.drop("rows"), ["bucket", "part"])
    length = F.element_at(F.array(*(F.lit(int(e)) for e in ends)), F.col("bucket") + 1).cast("long")
    at = F.coalesce("before", F.lit(0)) + F.col("k") - 1
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(length, F.lit(1))), F.lit(1)).cast("long")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        F.col("bucket").cast("int").alias("bucket"),
        length.alias("bucket_len"),
        F.concat_ws("-", F.col("bucket").cast("string"), F.floor(at / room).cast("string")).alias("batch_id"),
        (at % room).cast("long").alias("place"),
        (length - F.col("n")).alias("padding"),
    )
