"""Workbooks through the source of Spark: partitions, pruning, filters, streams."""

import time

import pytest
from pyspark.sql import functions as F

from folioflow.sinks.xlsx import workbook
from folioflow.sources import office, workbook_source


def cells(sheet, rows, start=0):
    return [{"sheet": sheet, "r": r, "c": c, "f": f"A{r}*2" if c == 3 else None, "t": "n" if c != 2 else "s", "n": float(start + r) if c != 2 else None, "s": f"{sheet} {r}" if c == 2 else None, "b": None, "e": None, "format": None} for r in range(1, rows + 1) for c in (1, 2, 3)]


@pytest.fixture
def folder(spark, tmp_path):
    workbook_source.register(spark)
    (tmp_path / "a.xlsx").write_bytes(workbook(cells("One", 40) + cells("Two", 5)))
    (tmp_path / "b.xlsx").write_bytes(workbook(cells("One", 7, 100)))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    return tmp_path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rows_are_those_of_the_other_reader(spark, folder):
    got = spark.read.format("folio_xlsx").load(str(folder))
    want = office.cells(spark, str(folder)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "sheet_idx", "sheet", "r", "c", "f", "t", "n", "s", "b", "e")
    assert rows(got) == rows(want) and got.count() == 3 * 52


def test_a_task_a_sheet_and_ranges_of_large_ones(spark, folder):
    read = spark.read.format("folio_xlsx")
    whole = read.load(str(folder))
    assert whole.rdd.getNumPartitions() == 3
    parts = whole.withColumn("p", F.spark_partition_id()).groupBy("path", "sheet").agg(F.count_distinct("p").alias("n")).collect()
    assert {r.n for r in parts} == {1}
    cut = spark.read.format("folio_xlsx").option("partbytes", 2000).load(str(folder / "a.xlsx"))
    assert cut.rdd.getNumPartitions() > 3 and rows(cut) == rows(whole.where(F.col("path").endswith("a.xlsx")))
    sizes = cut.where("sheet = 'One'").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 120


def test_columns_and_filters_reach_the_source(spark, folder):
    read = spark.read.format("folio_xlsx").schema("sheet string, r int, n double").load(str(folder / "a.xlsx"))
    assert read.columns == ["sheet", "r", "n"] and read.where("n = 3").count() == 4
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        choosy = spark.read.format("folio_xlsx").option("filters", "true")
        some = choosy.load(str(folder)).where("sheet = 'Two' and r between 2 and 3 and c = 1")
        assert some.rdd.getNumPartitions() == 1
        assert [(r.sheet, r.r, r.n) for r in some.orderBy("r").collect()] == [("Two", 2, 2.0), ("Two", 3, 3.0)]
        assert choosy.load(str(folder)).where("sheet = 'None'").count() == 0
    finally:
        spark.conf.unset(key)


def test_a_stream_reads_each_file_once(spark, folder, tmp_path_factory):
    out, at = str(tmp_path_factory.mktemp("out")), str(tmp_path_factory.mktemp("cp"))

    def run():
        stream = spark.readStream.format("folio_xlsx").option("maxfilespertrigger", 1).load(str(folder))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(out)

    assert rows(run()) == rows(spark.read.format("folio_xlsx").load(str(folder)))
    time.sleep(0.05)
    (folder / "c.xlsx").write_bytes(workbook(cells("New", 4)))
    again = run()  # a new query from the same checkpoint
    assert rows(again) == rows(spark.read.format("folio_xlsx").load(str(folder))) and again.where("sheet = 'New'").count() == 12
