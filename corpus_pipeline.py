"""From raw documents to padded batches: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes the documents that its predecessor kept and calls one operator of
``folioflow.llm``.  Stages are written as Parquet and read again in between.

Defined results
    null or empty text     judged like others: quality gives it the score of a text without features; all texts without
                           a word are near-duplicates of each other; no benchmark item, no personal data; zero tokens
    null doc_id            kept by near-duplicates, as nothing tells such rows apart; scored, cleaned and packed like others
    repeated rows          rows that repeat id and text become one in near-duplicates (which one, where other columns
                           differ, is open); rows that share an id but differ in text are documents of their own
    ties                   of a group the smallest id stays, of rows of that id the smallest text hash
    very long texts        read whole in every stage
    empty table            empty result of every stage
    other columns          returned as they came, whatever their names, by all stages but the last
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontam, packing, quality, simhash, surrogates
from folioflow.llm.common import checkpointed, files_removed, sent, small_batches, spare, stored, table
from folioflow.llm.queries import EXAMPLE_KEY

#: A document stays if its quality score is at least this.
QUALITY_FLOOR = 0.3
#: Texts of at least this Jaccard similarity of their 5-word shingles are near-duplicates.
SIMILARITY = 0.8


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the rows that are not held out."""
    small_batches(spark)
    (score,) = spare(docs, "quality_score")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, out=score).where(F.col(score) >= QUALITY_FLOOR).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: float | None = SIMILARITY) -> DataFrame:
    """The document of smallest id of every group of near-duplicates, once.

    Groups are connected by fingerprints at most 3 bits apart and, unless ``similarity`` is None, by that Jaccard
    similarity of 5-word shingles.  It is decided by row, as the head of this module says.
    """
    small_batches(spark)
    digest, key, mark = spare(docs, "text_digest", "key_id", "key_digest")
    with files_removed(spark):
        rows = simhash.labelled(docs, similarity=similarity).where("id is not null")
        keys = rows.groupBy("label", "id", "digest").agg(F.count("*").alias("n"))
        first = keys.groupBy("label").agg(F.min(F.struct("id", "digest")).alias("kept"))
        keys = keys.join(first, "label").select(F.col("id").alias(key), F.col("digest").alias(mark), "n", (F.struct("id", "digest") == F.col("kept")).alias("stays"))
        keys = checkpointed(keys.groupBy(key, mark).agg(F.sum("n").alias("n"), F.bool_or("stays").alias("stays")))
        # What goes is less than what stays, and what stays but repeats is less still: if these lists are short, no text moves but the repeated ones.
        gone, twice = sent(keys.where("not stays").select(key, mark)), sent(keys.where("stays and n > 1").select(key, mark))
    marked = docs.withColumn(digest, F.xxhash64("text"))

    def among(those: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        return rows.join(those, (rows["doc_id"] == those[key]) & (rows[digest] == those[mark]), how)

    kept = among(gone, "left_anti", marked)
    once = among(twice, "left_semi", kept).dropDuplicates(["doc_id", digest])
    return among(twice, "left_anti", kept).unionByName(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    small_batches(spark)
    (found,) = spare(docs, "benchmark_matches")
    return decontam.with_matches(docs, table(spark, sf_dir, "benchmark"), out=found).where(F.size(found) == 0).select(*docs.columns)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and ``n_chars`` as the text then has it."""
    small_batches(spark)
    (kinds,) = spare(docs, "kinds")
    out = surrogates.pseudonymize(docs, EXAMPLE_KEY, out=kinds)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and place of every document."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_surrogates),
    ("packing", packing_plan),
]

#: SQL expresses neither the trained classifier nor the keyed surrogates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
