"""The right reader for a path by its ending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import office, plain

READERS = {
    "xlsx": office.cells, "xlsm": office.cells, "docx": office.blocks, "pptx": office.slides, "rtf": plain.rtf_paragraphs, "csv": plain.csv_rows, "txt": plain.text_paragraphs,
    "md": plain.text_paragraphs, "log": plain.text_paragraphs, "html": plain.html_files, "htm": plain.html_files, "json": plain.json_values,
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file as the table that its format gives."""
    ending = path.rpartition(".")[2].lower()
    if ending not in READERS:
        raise ValueError(f"no reader for .{ending}; legacy formats are not supported")
    return READERS[ending](spark, path)
