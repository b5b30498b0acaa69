"""The library from SQL: functions, table functions and the source of workbooks registered in a session under names of their own.

Spreadsheet functions are SQL functions, so Catalyst inlines them into the plan.  Word functions of reading aloud are Arrow-batched.
Package readers are table functions over a file's bytes, to be joined laterally to ``binaryFile`` rows; any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType

from .operators import speech
from .sources import docx, office, pptx, rtf, workbook_source, xlsx

#: Name, parameters, type and body of the SQL functions.
SQL_FUNCTIONS = (
    ("xl_mod", "n DOUBLE, d DOUBLE", "DOUBLE", "CASE WHEN d <> 0 THEN n - d * floor(n / d) END"),
    ("xl_round", "x DOUBLE, digits INT", "DOUBLE", "sign(x) * floor(abs(x) * pow(10, digits) + 0.5 + 1e-12) / pow(10, digits)"),
    ("xl_quotient", "n DOUBLE, d DOUBLE", "DOUBLE", "try_divide(n, d)"),
    ("xl_trim", "s STRING", "STRING", r"regexp_replace(regexp_replace(s, r'^\s+|\s+$', ''), ' +', ' ')"),
    (
        "xl_proper", "s STRING", "STRING",
        "array_join(transform(split(regexp_replace(lower(s), '([A-Za-zÀ-ɏ]+)', concat(chr(1), '$1', chr(1))), chr(1)), p -> CASE WHEN p RLIKE '^[A-Za-zÀ-ɏ]' THEN concat(upper(left(p, 1)), substring(p, 2)) ELSE p END), '')",
    ),
    ("xl_left", "s STRING, n INT", "STRING", "left(s, n)"),
    ("xl_mid", "s STRING, start INT, n INT", "STRING", "CASE WHEN start >= 1 AND n >= 0 THEN substring(s, start, n) END"),
    ("xl_exact", "a STRING, b STRING", "BOOLEAN", "a <=> b"),
    ("xl_serial", "d DATE", "DOUBLE", "cast(datediff(d, DATE'1899-12-30') AS DOUBLE)"),
    ("xl_date", "n DOUBLE", "DATE", "date_add(DATE'1899-12-30', cast(floor(n) AS INT))"),
    ("tx_html_escape", "s STRING", "STRING", "replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\'', '&#39;')"),
    ("tx_safe_link", "url STRING", "BOOLEAN", "coalesce(lower(trim(url)) RLIKE '^(https?://|mailto:|tel:|#)', false)"),
)
#: Word functions by the name they get.
WORD_FUNCTIONS = {"sp_form": "speech", "sp_marks": "normalised", "sp_article": "article", "sp_pausal": "pausal", "sp_skeleton": "skeleton", "sp_glyphs": "glyph", "sp_logical": "logical", "sp_tanween": "tanween"}
#: Readers of packages: what yields the rows, and their columns but the path.
READERS = {
    "xlsx_cells": (xlsx.read_cells, office.CELLS), "docx_blocks": (docx.read_blocks, office.BLOCKS), "docx_runs": (docx.read_runs, docx.RUNS), "pptx_items": (pptx.read_items, office.SLIDES),
    "pptx_placed": (pptx.read_placed, pptx.PLACED), "pptx_tables": (pptx.read_tables, pptx.TABLES), "rtf_runs": (rtf.read_runs, rtf.RUNS),
}


def reader(read, schema: str):
    """A table function of a file's bytes; a file that cannot be read has no rows."""
    bad = (KeyError, ValueError, OSError, EOFError, AttributeError, office._bad_zip())

    class Reader:
        def eval(self, content: bytes):
            if content is not None:
                try:
                    yield from read(bytes(content))
                except bad:
                    return

    return udtf(Reader, returnType=schema.partition(", ")[2])


def register(spark: SparkSession) -> list[str]:
    """Registers everything in the session, for as long as it lasts; returns the names."""
    for name, parameters, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, word in WORD_FUNCTIONS.items():
        spark.udf.register(name, speech.series_function(word, StringType()))
    for name, (read, schema) in READERS.items():
        spark.udtf.register(name, reader(read, schema))
    workbook_source.register(spark)
    return [f[0] for f in SQL_FUNCTIONS] + [*WORD_FUNCTIONS, *READERS]


def files_view(spark: SparkSession, path: str, glob: str, name: str) -> None:
    """A view of files (``path``, ``content``) that the table functions can be joined to."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    found.select(F.col("path"), F.col("content")).createOrReplaceTempView(name)
