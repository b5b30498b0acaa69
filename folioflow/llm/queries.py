"""One thin query per operator over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fim, langid, licenses, linerules, ngramjoin, oracles, packing, quality, resampling, revisits, simhash, surrogates
from .common import small_batches, table

#: Key of the example queries.  A real run passes its own secret.
EXAMPLE_KEY = b"folioflow example key"


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(licenses.document_paths(table(spark, sf_dir, "documents")), id_col="doc_id")


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.capture_log(table(spark, sf_dir, "pages")))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")
    return found.select("record_id", "canonical", "status", "base_id", F.unix_seconds("base_at").alias("base_s"), merged.alias("merged"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = surrogates.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), EXAMPLE_KEY)
    return docs.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_entities"), F.array_sort(F.array_distinct("pii_kinds")).alias("kinds"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.language_id(table(spark, sf_dir, "documents"))


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed"]
    return linerules.clean_lines(table(spark, sf_dir, "documents")).select(*columns)


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(turns.unionByName(extra)))


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    sizes = [F.length(name).cast("long").alias(f"{name}_chars") for name in ("prefix", "middle")]
    restored = F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", *sizes, F.sha2("output", 256).alias("output_sha256"), restored)


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_license_scan": license_scan,
    "op2_warc_revisits": warc_revisits,
    "op3_simhash_near_dedup": simhash_near_dedup,
    "op4_pii_surrogates": pii_surrogates,
    "op5_language_id": language_id,
    "op6_length_buckets": length_buckets,
    "op7_quality_classifier": quality_classifier,
    "op8_line_cleaning": line_cleaning,
    "op9_benchmark_decontamination": benchmark_decontamination,
    "op10_chat_windows": chat_windows,
    "op11_ngram_join": ngram_join,
    "op12_fill_in_middle": fill_in_middle,
    "op13_importance_resampling": importance_resampling,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": oracles.license_scan(),
    "op2_warc_revisits": oracles.warc_revisits(),
    "op8_line_cleaning": oracles.line_cleaning(),
    "op10_chat_windows": oracles.chat_windows(),
    "op11_ngram_join": oracles.ngram_join(),
    "op12_fill_in_middle": oracles.fill_in_middle(),
    "op13_importance_resampling": oracles.importance_resampling(),
}
