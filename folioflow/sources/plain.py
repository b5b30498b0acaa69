"""Plain formats: text, comma-separated lines, HTML, images, rich text, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.infer import data_uri, image_type
from ..operators.textops import paragraphs
from .office import files, parsed


def text_paragraphs(spark: SparkSession, path: str, glob: str = "*.{txt,md,log}") -> DataFrame:
    """``path, pos, text`` of the paragraphs of whole files."""
    whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(paragraphs(F.col("value"))).alias("pos", "text"))


def toggled_fields(line: Column) -> Column:
    """Fields of a line where a quote turns quoting on or off wherever it stands, so a doubled one vanishes."""
    parts = F.split(line, '"')
    # Commas outside quotes lie in the pieces of even place.
    marked = F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit("\u0001"))).otherwise(p))
    return F.split(F.array_join(marked, ""), "\u0001")


def quoted_rows(text: Column) -> Column:
    """Rows of fields of a whole text: commas and line ends inside quotes are text, a doubled quote there is one quote."""
    # Between quotes lie the pieces of odd place; what separates lies in the others.
    marked = F.transform(F.split(text, '"'), lambda p, i: F.when(i % 2 == 0, F.translate(F.regexp_replace(p, "\r\n?", "\n"), ",\n", "\u0001\u0002")).otherwise(p))
    rows = F.filter(F.split(F.array_join(marked, '"'), "\u0002"), lambda r: r != "")
    bare = lambda f: F.when(f.rlike('(?s)^".*"$'), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(rows, lambda r: F.transform(F.split(r, "\u0001"), bare))


def csv_rows(spark: SparkSession, path: str, glob: str = "*.csv", strict: bool = False) -> DataFrame:
    """``path, fields`` of every row.  ``strict`` reads line by line and quotes as the viewer does; else quoted fields may hold line ends and doubled quotes."""
    reader = spark.read.option("pathGlobFilter", glob)
    if strict:
        lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r$", "").alias("line"))
        return lines.select("path", toggled_fields(F.col("line")).alias("fields"))
    whole = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    return whole.select("path", F.explode(quoted_rows(F.col("text"))).alias("fields"))


def html_files(spark: SparkSession, path: str, glob: str = "*.htm*") -> DataFrame:
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def image_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, mime, uri`` of files that are images by their first bytes."""
    found = files(spark, path, glob).withColumn("mime", image_type(F.col("content"))).where("mime is not null")
    return found.select("path", "mime", data_uri(F.col("content")).alias("uri"))


def rtf_paragraphs(spark: SparkSession, path: str, glob: str = "*.rtf") -> DataFrame:
    from .rtf import read_paragraphs

    return parsed(files(spark, path, glob), "path string, pos int, type string, text string", lambda content: ((i, k, t) for i, (k, t) in enumerate(read_paragraphs(content))))


def json_values(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """``path, value`` of whole JSON files as variants; what cannot be read is null."""
    whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.try_parse_json(F.regexp_replace("value", "^\ufeff", "")).alias("value"))


def state_lines(spark: SparkSession, path: str) -> DataFrame:
    """``tag, fields`` of a state file of tab-parted lines that start with a one-letter tag; other lines are skipped."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.col("value").rlike(r"^[A-Z]\t")).select(parts[0].alias("tag"), F.slice(parts, F.lit(2), F.size(parts) - 1).alias("fields"))


def speech_marks(spark: SparkSession, path: str) -> DataFrame:
    """Word boundaries of speech metadata: ``text, at_ms, ms`` from ticks of 100 ns."""
    schema = "Metadata array<struct<Type:string,Data:struct<Offset:long,Duration:long,text:struct<Text:string>>>>"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("j")).select(F.explode("j.Metadata").alias("m"))
    return rows.where("m.Type = 'WordBoundary'").select(F.col("m.Data.text.Text").alias("text"), (F.col("m.Data.Offset") / 10000).alias("at_ms"), (F.col("m.Data.Duration") / 10000).alias("ms"))


def recognised_cache(spark: SparkSession, path: str) -> DataFrame:
    """Words of a cache of recognised pages: a head line, then six fields parted by tabs; the boxes are shares of the page."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) == 6))
    names = ("line", "l", "t", "r", "b")
    return rows.select(*(parts[i].try_cast("int" if i == 0 else "double").alias(n) for i, n in enumerate(names)), parts[5].alias("text"))
