"""Conditional-format rules over a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import colour
from ..operators import condfmt as C
from .register import Register, read

REGISTER = Register()


def _suppliers(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")


@REGISTER("cf_top10", "SELECT s_suppkey, s_acctbal >= (SELECT s_acctbal FROM supplier ORDER BY 1 DESC LIMIT 1 OFFSET 9) AS hit FROM supplier")
def top10(spark, d):
    return C.top(_suppliers(spark, d), "s_acctbal", 10).select("s_suppkey", "hit")


@REGISTER("cf_top10pct", "SELECT c_custkey, c_acctbal >= (SELECT min(x) FROM (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal DESC) AS n, count(*) OVER () AS a FROM customer) WHERE n <= greatest(1, a * 5 // 100)) AS hit FROM customer")
def top_percent(spark, d):
    return C.top(read(spark, d, "customer"), "c_acctbal", 5, percent=True).select("c_custkey", "hit")


@REGISTER("cf_bottom", "SELECT p_partkey, p_size <= (SELECT p_size FROM part ORDER BY 1 LIMIT 1 OFFSET 19) AS hit FROM part")
def bottom(spark, d):
    return C.top(read(spark, d, "part"), "p_size", 20, bottom=True).select("p_partkey", "hit")


@REGISTER("cf_duplicates", "SELECT p_partkey, count(*) OVER (PARTITION BY p_name) > 1 AS duplicate FROM part")
def duplicates(spark, d):
    return C.duplicates(read(spark, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "duplicate")


@REGISTER("cf_unique", "SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) = 1 AS single FROM supplier")
def unique(spark, d):
    return C.duplicates(_suppliers(spark, d), "s_nationkey").select("s_suppkey", (~F.col("duplicate")).alias("single"))


@REGISTER("cf_above_avg", "SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice::DECIMAL(18,4))::DOUBLE FROM orders) AS hit FROM orders")
def above_average(spark, d):
    return C.above_average(read(spark, d, "orders"), "o_totalprice").select("o_orderkey", "hit")


@REGISTER("cf_cellis", "SELECT p_partkey, p_size BETWEEN 10 AND 20 AS inside, NOT p_size BETWEEN 10 AND 20 AS outside, p_retailprice > 1000 AS dear, lower(p_brand) = 'brand#13' AS brand FROM part")
def cell_is(spark, d):
    size = F.col("p_size")
    return read(spark, d, "part").select(
        "p_partkey", C.cell_is(size, "between", 20, 10).alias("inside"), C.cell_is(size, "notBetween", 10, 20).alias("outside"), C.cell_is(F.col("p_retailprice"), "greaterThan", 1000).alias("dear"),
        C.cell_is(F.col("p_brand"), "equal", "BRAND#13").alias("brand"),
    )


@REGISTER("cf_text", "SELECT p_partkey, contains(lower(p_type), 'steel') AS has, NOT contains(lower(p_type), 'steel') AS lacks, starts_with(lower(p_type), 'eco') AS begins, ends_with(lower(p_type), 's') AS ends_s FROM part")
def text(spark, d):
    t = F.col("p_type")
    return read(spark, d, "part").select("p_partkey", C.text_rule(t, "containsText", "Steel").alias("has"), C.text_rule(t, "notContainsText", "STEEL").alias("lacks"), C.text_rule(t, "beginsWith", "eco").alias("begins"), C.text_rule(t, "endsWith", "S").alias("ends_s"))


@REGISTER("cf_blanks_errors", "SELECT * FROM (VALUES (1, true, false), (2, true, false), (3, false, true), (4, false, false)) t(id, blank, fault)")
def blanks(spark, d):
    t = spark.createDataFrame([(1, None), (2, "  "), (3, "#N/A"), (4, "x")], "id int, v string")
    return t.select("id", C.is_blank(F.col("v")).alias("blank"), C.is_error(F.col("v")).alias("fault"))


@REGISTER("cf_databar", "SELECT s_suppkey, round(least(1.0, greatest(0.0, (s_acctbal - lo) / (hi - lo))), 9) AS bar FROM supplier, (SELECT least(0.0, min(s_acctbal)) AS lo, max(s_acctbal) AS hi FROM supplier)")
def data_bar(spark, d):
    return C.data_bar(_suppliers(spark, d), "s_acctbal").select("s_suppkey", F.round("bar", 9).alias("bar"))


@REGISTER(
    "cf_colorscale_pos",
    "SELECT s_suppkey, round(least(1.0, greatest(0.0, (s_acctbal - lo) / (hi - lo))), 9) AS place FROM supplier, (SELECT (list(s_acctbal ORDER BY s_acctbal))[floor((count(*) - 1) * 0.1 + 0.5)::BIGINT + 1] AS lo, (list(s_acctbal ORDER BY s_acctbal))[floor((count(*) - 1) * 0.9 + 0.5)::BIGINT + 1] AS hi FROM supplier)",
)
def color_scale(spark, d):
    t = _suppliers(spark, d)
    low, high = C.stop_value(t, "s_acctbal", "percentile", 10), C.stop_value(t, "s_acctbal", "percentile", 90)
    return t.select("s_suppkey", F.round(C.fraction(F.col("s_acctbal"), low, high), 9).alias("place"))


@REGISTER("cf_color_mix", "SELECT * FROM (VALUES (0.0::DOUBLE, 'FF0000'), (0.25::DOUBLE, 'FF8000'), (0.5::DOUBLE, 'FFFF00'), (1.0::DOUBLE, '00FF00')) t(place, colour)")
def color_mix(spark, d):
    t = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,)], "place double")
    return t.select("place", C.mix(F.col("place"), [(255, 0, 0), (255, 255, 0), (0, 255, 0)]).alias("colour"))


@REGISTER("cf_priority", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'red' WHEN p_retailprice > 1200 THEN 'bold' WHEN p_size > 20 THEN 'blue' END AS style FROM part")
def priority(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return read(spark, d, "part").select("p_partkey", C.winner([(3, size > 20, "blue"), (1, size > 40, "red"), (2, price > 1200, "bold")]).alias("style"))


_HSL = """p AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS hi, least(r, g, b) / 255.0::DOUBLE AS lo FROM c),
  h AS (SELECT *, (hi + lo) / 2 AS l, CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS s,
    CASE WHEN hi = lo THEN 0 WHEN r / 255.0::DOUBLE = hi THEN ((g - b) / 255.0::DOUBLE / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END) / 6 WHEN g / 255.0::DOUBLE = hi THEN ((b - r) / 255.0::DOUBLE / (hi - lo) + 2) / 6 ELSE ((r - g) / 255.0::DOUBLE / (hi - lo) + 4) / 6 END AS hue FROM p),
  n AS (SELECT *, least(1.0, greatest(0.0, CASE WHEN tint < 0 THEN l * (1 + tint) ELSE l * (1 - tint) + tint END)) AS nl FROM h),
  q AS (SELECT *, CASE WHEN nl < 0.5 THEN nl * (1 + s) ELSE nl + s - nl * s END AS up FROM n),
  k AS (SELECT *, i, hue + sh - floor(hue + sh) AS t, 2 * nl - up AS dn FROM q, (VALUES (1, 1.0::DOUBLE / 3), (2, 0.0::DOUBLE), (3, -1.0::DOUBLE / 3)) v(i, sh)),
  v AS (SELECT *, floor(CASE WHEN s = 0 THEN nl WHEN t < 1.0::DOUBLE / 6 THEN dn + (up - dn) * 6 * t WHEN t < 0.5 THEN up WHEN t < 2.0::DOUBLE / 3 THEN dn + (up - dn) * (2.0::DOUBLE / 3 - t) * 6 ELSE dn END * 255 + 0.5)::INTEGER AS x FROM k)"""


@REGISTER(
    "cf_tint",
    f"""WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 256 AS r, (p_partkey * 104729) % 256 AS g, (p_partkey * 1299709) % 256 AS b, (p_size - 25) / 40.0::DOUBLE AS tint FROM part), {_HSL}
    SELECT p_partkey, max(CASE WHEN tint = 0 THEN printf('%02X%02X%02X', r, g, b) END) IS NOT NULL AS same, max(x) FILTER (i = 1) AS red, max(x) FILTER (i = 2) AS green, max(x) FILTER (i = 3) AS blue FROM v GROUP BY 1""",
)
def tint(spark, d):
    k = F.col("p_partkey")
    parts = [F.lpad(F.hex(k * m % 256), 2, "0") for m in (7919, 104729, 1299709)]
    t = read(spark, d, "part").select("p_partkey", F.concat(*parts).alias("c"), ((F.col("p_size") - 25) / 40.0).alias("tint"))
    t = t.withColumn("new", colour.tinted(F.col("c"), F.col("tint")))
    c = colour.channels(F.col("new"))
    return t.select("p_partkey", (F.col("new") == F.col("c")).alias("same"), c[0].alias("red"), c[1].alias("green"), c[2].alias("blue"))
