"""Scalar functions of the formula language, by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numeric as N
from ..functions import text as T
from ..functions.errors import if_error, if_na
from ..formula.columns import formula_column
from .register import Register, read, rounded

REGISTER = Register()


@REGISTER("xl_math", "SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS i, sign(c_acctbal)::DOUBLE AS s, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 8) END AS root, CASE WHEN c_acctbal < 0 THEN '#NUM!' END AS fault FROM customer")
def math_(spark, d):
    x = F.col("c_acctbal")
    r = N.sqrt(x)
    return read(spark, d, "customer").select("c_custkey", F.abs(x).alias("a"), N.int_(x).alias("i"), F.signum(x).alias("s"), F.round(r["v"], 8).alias("root"), r["e"].alias("fault"))


@REGISTER(
    "xl_round",
    f"""SELECT l_orderkey, l_linenumber, {rounded('x', 2)} AS two, {rounded('x', -2)} AS hundreds, sign(x) * ceil(abs(x) * 10.0::DOUBLE - 1e-12) / 10.0::DOUBLE AS up,
      sign(x) * floor(abs(x) * 10.0::DOUBLE + 1e-12) / 10.0::DOUBLE AS down FROM (SELECT *, l_extendedprice * (1 - l_discount) AS x FROM lineitem)""",
)
def round_(spark, d):
    x = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.round_(x, 2).alias("two"), N.round_(x, -2).alias("hundreds"), N.round_up(x, 1).alias("up"), N.round_down(x, 1).alias("down"))


@REGISTER("xl_ceiling_floor", "SELECT p_partkey, ceil(p_retailprice / 5.0::DOUBLE) * 5.0::DOUBLE AS up, floor(p_retailprice / 0.5::DOUBLE) * 0.5::DOUBLE AS down, 0.0::DOUBLE AS zero FROM part")
def ceiling(spark, d):
    x = F.col("p_retailprice")
    return read(spark, d, "part").select("p_partkey", N.ceiling(x, 5.0).alias("up"), N.floor_(x, 0.5).alias("down"), N.ceiling(x, 0.0).alias("zero"))


@REGISTER("xl_mod", "SELECT c_custkey, CASE WHEN c_nationkey <> 0 THEN c_custkey::DOUBLE - -c_nationkey::DOUBLE * floor(c_custkey::DOUBLE / -c_nationkey::DOUBLE) END AS rest, CASE WHEN c_nationkey = 0 THEN '#DIV/0!' END AS fault FROM customer")
def mod(spark, d):
    r = N.mod(F.col("c_custkey").cast("double"), -F.col("c_nationkey").cast("double"))
    return read(spark, d, "customer").select("c_custkey", r["v"].alias("rest"), r["e"].alias("fault"))


@REGISTER("xl_log", "SELECT s_suppkey, CASE WHEN x > 0 THEN round(ln(x), 9) END AS natural, CASE WHEN x > 0 THEN round(log10(x), 9) END AS decimal, CASE WHEN x > 0 THEN round(ln(x) / ln(2.0::DOUBLE), 9) END AS two, CASE WHEN x <= 0 THEN '#NUM!' END AS fault FROM (SELECT s_suppkey, s_acctbal AS x FROM supplier)")
def log(spark, d):
    x = F.col("s_acctbal")
    return read(spark, d, "supplier").select("s_suppkey", F.round(N.ln(x)["v"], 9).alias("natural"), F.round(N.log10(x)["v"], 9).alias("decimal"), F.round(N.log(x, 2.0)["v"], 9).alias("two"), N.ln(x)["e"].alias("fault"))


@REGISTER("xl_power", "SELECT s_suppkey, CASE WHEN isfinite(p) THEN round(p, 6) END AS p, CASE WHEN NOT isfinite(p) THEN '#NUM!' END AS fault FROM (SELECT s_suppkey, pow(s_nationkey::DOUBLE, 3.0::DOUBLE) AS p FROM supplier)")
def power(spark, d):
    r = N.power(F.col("s_nationkey").cast("double"), F.lit(3.0))
    return read(spark, d, "supplier").select("s_suppkey", F.round(r["v"], 6).alias("p"), r["e"].alias("fault"))


@REGISTER("xl_text_case", "SELECT p_partkey, upper(p_type) AS up, lower(p_type) AS low, length(p_name)::BIGINT AS n FROM part")
def text_case(spark, d):
    return read(spark, d, "part").select("p_partkey", F.upper("p_type").alias("up"), F.lower("p_type").alias("low"), F.length("p_name").cast("long").alias("n"))


@REGISTER(
    "xl_proper",
    "SELECT * FROM (VALUES (1, 'O''Neil'), (2, 'Mc-Donald'), (3, 'X2Y'), (4, 'Été À La Mer'), (5, 'Hello World')) t(id, name)",
)
def proper(spark, d):
    t = spark.createDataFrame([(1, "o'NEIL"), (2, "mc-donald"), (3, "x2y"), (4, "été à LA mer"), (5, "hello world")], "id int, s string")
    return t.select("id", T.proper(F.col("s")).alias("name"))


@REGISTER("xl_text_slice", "SELECT c_custkey, left(c_name, 4) AS a, right(c_name, 3) AS b, substr(c_name, 3, 5) AS c, repeat(left(c_mktsegment, 1), 3) AS r FROM customer")
def text_slice(spark, d):
    s = F.col("c_name")
    return read(spark, d, "customer").select("c_custkey", T.left(s, 4).alias("a"), T.right(s, 3).alias("b"), T.mid(s, 3, 5)["v"].alias("c"), T.rept(T.left(F.col("c_mktsegment")), 3).alias("r"))


@REGISTER("xl_mid_faults", "SELECT * FROM (VALUES (1, 'ab', NULL), (2, NULL, '#VALUE!'), (3, '', NULL)) t(id, v, fault)")
def mid_faults(spark, d):
    t = spark.createDataFrame([(1, 1, 2), (2, 0, 2), (3, 9, 2)], "id int, start int, n int")
    r = T.mid(F.lit("abc"), F.col("start"), F.col("n"))
    return t.select("id", r["v"].alias("v"), r["e"].alias("fault"))


@REGISTER("xl_trim", r"SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' +', ' ', 'g') AS t FROM documents")
def trim(spark, d):
    return read(spark, d, "documents").select("doc_id", T.trim(F.col("text")).alias("t"))


@REGISTER(
    "xl_find_sub",
    """SELECT p_partkey, CASE WHEN position('an' IN p_name) > 0 THEN position('an' IN p_name) END::INTEGER AS at, CASE WHEN position('an' IN p_name) = 0 THEN '#VALUE!' END AS fault,
      CASE WHEN position('AN' IN upper(p_name)) > 0 THEN position('AN' IN upper(p_name)) END::INTEGER AS any_case, replace(p_name, 'a', '**') AS swapped, substr(p_name, 1, 1) || 'ZZ' || substr(p_name, 4) AS patched FROM part""",
)
def find_sub(spark, d):
    s = F.col("p_name")
    f = T.find(F.lit("an"), s)
    return read(spark, d, "part").select("p_partkey", f["v"].alias("at"), f["e"].alias("fault"), T.search(F.lit("AN"), s)["v"].alias("any_case"), T.substitute(s, "a", "**").alias("swapped"), T.replace(s, 2, 2, "ZZ").alias("patched"))


@REGISTER("xl_substitute_nth", "SELECT * FROM (VALUES (1, 'a-b-c', 'a-b+c'), (2, 'a-b', 'a-b'), (3, '', '')) t(id, s, r)")
def substitute_nth(spark, d):
    t = spark.createDataFrame([(1, "a-b-c"), (2, "a-b"), (3, "")], "id int, s string")
    return t.select("id", "s", T.substitute(F.col("s"), "-", "+", 2).alias("r"))


@REGISTER("xl_textjoin_scalar", "SELECT c_custkey, concat_ws('/', c_name, nullif(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, '')) AS t FROM customer")
def text_join(spark, d):
    part = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment"))
    return read(spark, d, "customer").select("c_custkey", T.text_join("/", True, F.col("c_name"), part).alias("t"))


@REGISTER("xl_exact", "SELECT n_nationkey, n_name = upper(n_name) AS same, n_name = lower(n_name) AS other FROM nation")
def exact(spark, d):
    s = F.col("n_name")
    return read(spark, d, "nation").select("n_nationkey", T.exact(s, F.upper(s)).alias("same"), T.exact(s, F.lower(s)).alias("other"))


@REGISTER(
    "xl_dates",
    """SELECT o_orderkey, (datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 25569)::DOUBLE AS serial, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d FROM orders""",
)
def dates(spark, d):
    t = read(spark, d, "orders").select("o_orderkey", D.date_serial(F.col("o_orderdate")).alias("serial"))
    n = F.col("serial")
    return t.select("o_orderkey", "serial", D.year(n).alias("y"), D.month(n).alias("m"), D.day(n).alias("d"))


@REGISTER(
    "xl_date_rolls",
    "SELECT p_partkey, (datediff('day', DATE '1899-12-30', (make_date(2020, 1, 1) + to_months(p_size - 1))::DATE) + p_size - 1)::DOUBLE AS serial FROM part",
)
def date_rolls(spark, d):
    return read(spark, d, "part").select("p_partkey", D.date(F.lit(2020), F.col("p_size"), F.col("p_size")).alias("serial"))


@REGISTER("xl_weekday", "SELECT o_orderkey, (dayofweek(o_orderdate) + 1)::INTEGER AS a, isodow(o_orderdate)::INTEGER AS b, (isodow(o_orderdate) - 1)::INTEGER AS c FROM orders")
def weekday(spark, d):
    n = D.date_serial(F.col("o_orderdate"))
    return read(spark, d, "orders").select("o_orderkey", D.weekday(n, 1).alias("a"), D.weekday(n, 2).alias("b"), D.weekday(n, 3).alias("c"))


@REGISTER("xl_time_parts", "SELECT event_id, hour(make_timestamp(s * 1000000))::INTEGER AS h, minute(make_timestamp(s * 1000000))::INTEGER AS m, second(make_timestamp(s * 1000000))::INTEGER AS s FROM (SELECT event_id, (event_id * 977) % 86400 AS s FROM events)")
def time_parts(spark, d):
    n = F.lit(45000.0) + (F.col("event_id") * 977 % 86400) / 86400.0
    return read(spark, d, "events").select("event_id", D.hour(n).alias("h"), D.minute(n + 1e-9).alias("m"), D.second(n).alias("s"))


@REGISTER("xl_if_iferror", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN 'in' ELSE 'out' END AS sign, CASE WHEN s_nationkey = 0 THEN -1.0 ELSE s_acctbal / s_nationkey END AS share FROM supplier")
def if_iferror(spark, d):
    r = N.divide(F.col("s_acctbal"), F.col("s_nationkey").cast("double"))
    return read(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, "in").otherwise("out").alias("sign"), if_error(r, F.lit(-1.0)).alias("share"))


@REGISTER("xl_ifna_info", "SELECT * FROM (VALUES (1, -1.0::DOUBLE, true), (2, NULL, false), (3, 3.0::DOUBLE, false)) t(id, v, is_na)")
def if_na_(spark, d):
    t = spark.createDataFrame([(1, None, "#N/A"), (2, None, "#REF!"), (3, 3.0, None)], "id int, v double, e string")
    r = F.struct("v", "e")
    return t.select("id", if_na(r, F.lit(-1.0)).alias("v"), F.coalesce(F.col("e") == "#N/A", F.lit(False)).alias("is_na"))


@REGISTER("xl_value", "SELECT * FROM (VALUES (1, 0.12::DOUBLE, NULL), (2, 1.5e3::DOUBLE, NULL), (3, 0.0::DOUBLE, NULL), (4, NULL, '#VALUE!'), (5, -7.0::DOUBLE, NULL)) t(id, v, fault)")
def value(spark, d):
    t = spark.createDataFrame([(1, "12%"), (2, " 1.5e3 "), (3, ""), (4, "abc"), (5, "-7")], "id int, s string")
    r = N.value(F.col("s"))
    return t.select("id", r["v"].alias("v"), r["e"].alias("fault"))


@REGISTER("xl_number_text", "SELECT * FROM (VALUES (1, '0.1'), (2, '123456789012345'), (3, '1E+21'), (4, '1.5E-7'), (5, '-2.25'), (6, '0'), (7, '0.3')) t(id, s)")
def number_text(spark, d):
    t = spark.createDataFrame([(1, 0.1), (2, 123456789012345.0), (3, 1e21), (4, 1.5e-7), (5, -2.25), (6, 0.0), (7, 0.1 + 0.2)], "id int, x double")
    return t.select("id", N.number_text(F.col("x")).alias("s"))


@REGISTER(
    "xl_formula_column",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 24 THEN {rounded('(l_extendedprice * (1 - l_discount))', 2)} ELSE 0.0 END AS net,
      upper(l_returnflag) || '-' || l_linestatus AS tag, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS ratio, CASE WHEN l_tax = 0 THEN '#DIV/0!' END AS ratio_fault FROM lineitem""",
)
def formula(spark, d):
    t = read(spark, d, "lineitem")
    net = formula_column(t, "=IF(l_quantity>=24, ROUND(l_extendedprice*(1-l_discount),2), 0)")
    tag = formula_column(t, '=UPPER(l_returnflag)&"-"&l_linestatus')
    ratio = formula_column(t, "=l_discount/l_tax")
    return t.select("l_orderkey", "l_linenumber", net["v"].alias("net"), tag["v"].alias("tag"), ratio["v"].alias("ratio"), ratio["e"].alias("ratio_fault"))
