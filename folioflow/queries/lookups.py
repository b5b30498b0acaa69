"""Lookups: exact, nearest, by position, with a default, over ranges, through chains of parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as L
from .register import Register, read

REGISTER = Register()
_BRACKETS = [(0.0, "low"), (50000.0, "mid"), (150000.0, "high"), (300000.0, "top")]


@REGISTER("xl_vlookup_exact", "SELECT c_custkey, n_name AS nation, n_regionkey AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def vlookup(spark, d):
    found = L.exact(read(spark, d, "customer"), read(spark, d, "nation").withColumn("pos", F.col("n_nationkey")), "c_nationkey", "n_nationkey", "pos", {"nation": "n_name", "region": "n_regionkey"})
    return found.select("c_custkey", "nation", "region")


@REGISTER(
    "xl_vlookup_text_first",
    "SELECT o_orderkey, pos AS pos FROM orders LEFT JOIN (SELECT lower(name) AS k, min(pos) AS pos FROM (VALUES (1, '1-urgent'), (2, '1-URGENT'), (3, '2-High'), (4, '5-low')) t(pos, name) GROUP BY 1) ON lower(o_orderpriority) = k",
)
def vlookup_text(spark, d):
    t = spark.createDataFrame([(1, "1-urgent"), (2, "1-URGENT"), (3, "2-High"), (4, "5-low")], "pos int, name string")
    return L.exact(read(spark, d, "orders"), t, "o_orderpriority", "name", "pos", {"at": "__pos"}).select("o_orderkey", F.col("at").alias("pos"))


@REGISTER(
    "xl_vlookup_approx",
    "SELECT o_orderkey, label FROM orders ASOF LEFT JOIN (VALUES (0.0::DOUBLE, 'low'), (50000.0, 'mid'), (150000.0, 'high'), (300000.0, 'top')) b(lo, label) ON o_totalprice >= lo",
)
def vlookup_approx(spark, d):
    table = spark.createDataFrame(_BRACKETS, "lo double, label string")
    return L.nearest(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), table, "o_totalprice", "lo", {"label": "label"}).select("o_orderkey", "label")


@REGISTER(
    "xl_match_desc",
    "SELECT o_orderkey, label FROM orders ASOF LEFT JOIN (VALUES (0.0::DOUBLE, 'low'), (50000.0, 'mid'), (150000.0, 'high'), (300000.0, 'top')) b(lo, label) ON o_totalprice <= lo",
)
def match_desc(spark, d):
    table = spark.createDataFrame(_BRACKETS, "lo double, label string")
    return L.nearest(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), table, "o_totalprice", "lo", {"label": "label"}, above=True).select("o_orderkey", "label")


@REGISTER("xl_asof_large", "SELECT l_orderkey, l_linenumber, near FROM lineitem ASOF LEFT JOIN (SELECT DISTINCT o_totalprice AS near FROM orders) ON l_extendedprice >= near")
def asof_large(spark, d):
    left = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return L.nearest(left, read(spark, d, "orders").select("o_totalprice"), "l_extendedprice", "o_totalprice", {"near": "o_totalprice"}).select("l_orderkey", "l_linenumber", "near")


@REGISTER("xl_xlookup_default", "SELECT s_suppkey, coalesce(c_name, 'none') AS name FROM supplier LEFT JOIN (SELECT c_nationkey, arg_min(c_name, c_custkey) AS c_name FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON s_nationkey = c_nationkey")
def xlookup(spark, d):
    rich = read(spark, d, "customer").where("c_acctbal > 9000")
    return L.exact(read(spark, d, "supplier"), rich, "s_nationkey", "c_nationkey", "c_custkey", {"name": "c_name"}, default=F.lit("none")).select("s_suppkey", "name")


@REGISTER("xl_index", "SELECT n_name AS value FROM nation WHERE n_nationkey = 7")
def index(spark, d):
    return L.index(read(spark, d, "nation"), "n_nationkey", 7, "n_name")


@REGISTER("xl_hlookup", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '10' WHEN 1 THEN '20' END AS rate FROM supplier")
def hlookup(spark, d):
    wide = spark.createDataFrame([(10, 20)], "zero int, one int")
    names = F.element_at(F.array(F.lit("ZERO"), F.lit("one"), F.lit("two")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    left = read(spark, d, "supplier").select("s_suppkey", names.alias("k"))
    return L.exact(left, L.transposed(wide, "name", "rate"), "k", "name", "pos", {"rate": "rate"}).select("s_suppkey", "rate")


_RANGES = [(1, 1, 40, 1, 20), (2, 30, 90, 10, 12), (3, 200, 200, 5, 5)]
_CELLS = "SELECT (p_partkey // 25)::INTEGER AS r, (p_partkey % 25)::INTEGER AS c, p_retailprice AS v FROM part"
_RANGE_SQL = "(VALUES (1, 1, 40, 1, 20), (2, 30, 90, 10, 12), (3, 200, 200, 5, 5)) g(id, r1, r2, c1, c2)"


def _cells(spark, d):
    return read(spark, d, "part").select(F.floor(F.col("p_partkey") / 25).cast("int").alias("r"), (F.col("p_partkey") % 25).cast("int").alias("c"), F.col("p_retailprice").alias("v"))


@REGISTER("xl_range_join", f"SELECT r, c, v, id FROM ({_CELLS}) JOIN {_RANGE_SQL} ON r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2")
def range_join(spark, d):
    ranges = spark.createDataFrame(_RANGES, "id int, r1 int, r2 int, c1 int, c2 int")
    return L.covered_by(_cells(spark, d), ranges).select("r", "c", "v", "id")


@REGISTER("xl_merged_cells", f"SELECT r, c, v FROM ({_CELLS}) x WHERE NOT EXISTS (SELECT 1 FROM {_RANGE_SQL} WHERE r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2 AND NOT (r = r1 AND c = c1))")
def merged(spark, d):
    ranges = spark.createDataFrame(_RANGES, "id int, r1 int, r2 int, c1 int, c2 int")
    return L.without_covered(_cells(spark, d), ranges).select("r", "c", "v")


@REGISTER("xl_table_stripes", f"SELECT r, c, (r - r1) % 2 = 1 AS odd, r = r1 AS head FROM ({_CELLS}) JOIN (VALUES (3, 60, 2, 9)) g(r1, r2, c1, c2) ON r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2")
def stripes(spark, d):
    ranges = spark.createDataFrame([(3, 60, 2, 9)], "r1 int, r2 int, c1 int, c2 int")
    return L.covered_by(_cells(spark, d), ranges).select("r", "c", ((F.col("r") - F.col("r1")) % 2 == 1).alias("odd"), (F.col("r") == F.col("r1")).alias("head"))


_STYLES = [("Normal", None), ("Title", "Normal"), ("Chapter", "Title"), ("Loop A", "Loop B"), ("Loop B", "Loop A")]


@REGISTER(
    "dx_style_closure",
    """SELECT * FROM (VALUES ('Normal', 'Normal', 0), ('Title', 'Title', 0), ('Title', 'Normal', 1), ('Chapter', 'Chapter', 0), ('Chapter', 'Title', 1), ('Chapter', 'Normal', 2),
      ('Loop A', 'Loop A', 0), ('Loop A', 'Loop B', 1), ('Loop B', 'Loop B', 0), ('Loop B', 'Loop A', 1)) t(node, ancestor, depth)""",
)
def closure(spark, d):
    return L.closure(spark.createDataFrame(_STYLES, "style string, based_on string"), "style", "based_on")
