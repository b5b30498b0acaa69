"""Lines of text as one file that appears at once or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_lines(lines: DataFrame, path: str, column: str = "value", order: list[str] | None = None) -> None:
    """Writes the column's lines, in order if one is given, beside ``path`` and renames the file to it; an earlier one is replaced.

    For state and settings files, which are small: the lines pass through one task.  Any file system that Spark knows will do.
    """
    spark = lines.sparkSession
    kept = (lines.orderBy(*order) if order else lines).select(column)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    work = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    try:
        kept.coalesce(1).write.text(work.toString())
        parts = [s.getPath() for s in fs.listStatus(work) if s.getPath().getName().startswith("part-")]
        if not parts:
            fs.create(jvm.org.apache.hadoop.fs.Path(work, "part-none")).close()
            parts = [jvm.org.apache.hadoop.fs.Path(work, "part-none")]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf)
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(parts[0], target, options)
    finally:
        fs.delete(work, True)


def tagged(fields: DataFrame, tag: str = "tag", values: list[str] | None = None) -> DataFrame:
    """State rows as lines: a tag and its fields parted by tabs, as the readers of state files take them."""
    from pyspark.sql import functions as F

    names = values or [c for c in fields.columns if c != tag]
    return fields.select(F.concat_ws("\t", tag, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)).alias("value"))
