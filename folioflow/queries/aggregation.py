"""Spreadsheet aggregates and criteria over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.criteria import column_criterion as crit
from ..functions.errors import shown
from ..operators import ranking
from .register import Register, read

REGISTER = Register()
_D = "DECIMAL(18,4)"


def _money(c):
    """A total as a double with two digits: exact before it is rounded."""
    return F.round(c, 2).cast("double")


@REGISTER(
    "xl_sumifs_lineitem",
    f"""SELECT l_returnflag, l_linestatus, coalesce(round(sum(CASE WHEN l_quantity >= 24 AND l_discount < 0.05 THEN l_extendedprice::{_D} END), 2), 0)::DOUBLE AS total
    FROM lineitem GROUP BY ALL""",
)
def sumifs(spark, d):
    t = read(spark, d, "lineitem")
    both = crit(t, "l_quantity", ">=24") & crit(t, "l_discount", "<0.05")
    return t.groupBy("l_returnflag", "l_linestatus").agg(_money(A.sum_if(both, A.money(F.col("l_extendedprice")))).alias("total"))


@REGISTER("xl_sum", f"SELECT c_mktsegment, round(sum(c_acctbal::{_D}), 2)::DOUBLE AS total, coalesce(sum(CASE WHEN c_acctbal > 1e9 THEN 1 END), 0)::BIGINT AS none FROM customer GROUP BY 1")
def sum_(spark, d):
    t = read(spark, d, "customer")
    return t.groupBy("c_mktsegment").agg(_money(A.total(A.money(F.col("c_acctbal")))).alias("total"), A.sum_if(F.col("c_acctbal") > 1e9, F.lit(1)).cast("long").alias("none"))


@REGISTER(
    "xl_average",
    f"""SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, CASE WHEN count(CASE WHEN o_totalprice < 0 THEN 1 END) = 0 THEN '#DIV/0!' END AS below
    FROM orders GROUP BY 1""",
)
def average(spark, d):
    t = read(spark, d, "orders")
    return t.groupBy("o_orderstatus").agg(F.round(A.average(F.col("o_totalprice"))["v"], 4).alias("mean"), A.average_if(F.col("o_totalprice") < 0, F.col("o_totalprice"))["e"].alias("below"))


@REGISTER("xl_min_max", "SELECT p_brand, coalesce(min(p_retailprice), 0) AS low, coalesce(max(p_retailprice), 0) AS high, coalesce(max(CASE WHEN p_size > 999 THEN p_size END), 0)::INTEGER AS none FROM part GROUP BY 1")
def min_max(spark, d):
    t = read(spark, d, "part")
    price = F.col("p_retailprice")
    return t.groupBy("p_brand").agg(A.minimum(price).alias("low"), A.maximum(price).alias("high"), A.maximum(F.when(F.col("p_size") > 999, F.col("p_size"))).alias("none"))


@REGISTER("xl_count_counta", "SELECT role, count(*)::BIGINT AS n, count(CASE WHEN text <> '' THEN 1 END)::BIGINT AS filled, count(CASE WHEN text IS NULL OR text = '' THEN 1 END)::BIGINT AS blank FROM conversations GROUP BY 1")
def counts(spark, d):
    t = read(spark, d, "conversations")
    return t.groupBy("role").agg(F.count("*").alias("n"), A.count_a(F.col("text")).alias("filled"), A.count_blank(F.col("text")).alias("blank"))


@REGISTER("xl_countblank", "SELECT count(CASE WHEN x = '' THEN 1 END)::BIGINT AS blank, count(CASE WHEN x <> '' THEN 1 END)::BIGINT AS filled FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS x FROM part)")
def count_blank(spark, d):
    x = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_name"))
    return read(spark, d, "part").select(x.alias("x")).agg(A.count_blank(F.col("x")).alias("blank"), A.count_a(F.col("x")).alias("filled"))


@REGISTER("xl_median", "SELECT l_shipmode, round(median(q), 6) AS mid FROM (SELECT l_returnflag AS l_shipmode, l_extendedprice AS q FROM lineitem) GROUP BY 1")
def median(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.round(A.median(F.col("l_extendedprice"))["v"], 6).alias("mid"))


@REGISTER("xl_stdev", "SELECT s_nationkey, CASE WHEN count(*) < 2 THEN NULL ELSE round(stddev_samp(s_acctbal), 4) END AS spread, CASE WHEN count(*) < 2 THEN '#DIV/0!' END AS fault FROM supplier GROUP BY 1")
def stdev(spark, d):
    g = read(spark, d, "supplier").groupBy("s_nationkey").agg(A.stdev(F.col("s_acctbal")).alias("r"))
    return g.select("s_nationkey", F.round(F.col("r.v"), 4).alias("spread"), F.col("r.e").alias("fault"))


@REGISTER("xl_large", "SELECT (SELECT l_extendedprice FROM lineitem ORDER BY 1 DESC LIMIT 1 OFFSET 6) AS value")
def large(spark, d):
    return ranking.kth(read(spark, d, "lineitem"), "l_extendedprice", 7)


@REGISTER("xl_small", "SELECT (SELECT o_totalprice FROM orders ORDER BY 1 LIMIT 1 OFFSET 4) AS value")
def small(spark, d):
    return ranking.kth(read(spark, d, "orders"), "o_totalprice", 5, largest=False)


@REGISTER("xl_large_by_group", "SELECT c_nationkey, list(c_acctbal ORDER BY c_acctbal DESC)[3] AS third, CASE WHEN count(*) < 3 THEN '#NUM!' END AS fault FROM customer GROUP BY 1")
def large_by_group(spark, d):
    t = read(spark, d, "customer").select("c_nationkey", "c_acctbal")
    third = ranking.kth_by(t, ["c_nationkey"], "c_acctbal", 3)
    found = t.select("c_nationkey").distinct().join(third, "c_nationkey", "left")
    return found.select("c_nationkey", F.col("value").alias("third"), F.when(F.col("value").isNull(), "#NUM!").alias("fault"))


@REGISTER("xl_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_retailprice DESC)::BIGINT AS place FROM part")
def rank(spark, d):
    return ranking.rank_by_value(read(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", out="place").select("p_partkey", "place")


@REGISTER("xl_sumproduct", "SELECT l_linestatus, round(sum(l_quantity::DECIMAL(9,2) * l_extendedprice::DECIMAL(12,2)), 2)::DOUBLE AS total FROM lineitem GROUP BY 1")
def sum_product(spark, d):
    p = A.sum_product(F.col("l_quantity").cast("decimal(9,2)"), F.col("l_extendedprice").cast("decimal(12,2)"))
    return read(spark, d, "lineitem").groupBy("l_linestatus").agg(_money(p).alias("total"))


@REGISTER("xl_and_or", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 300000) AS some FROM orders GROUP BY 1")
def and_or(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("every"), F.bool_or(F.col("o_totalprice") > 300000).alias("some"))


@REGISTER("xl_textjoin", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey, n_name) AS names FROM nation GROUP BY 1")
def text_join(spark, d):
    return read(spark, d, "nation").groupBy("n_regionkey").agg(A.text_join(F.col("n_name"), F.col("n_nationkey"), "; ").alias("names"))


@REGISTER("xl_countif_wild", "SELECT p_brand, count(CASE WHEN regexp_full_match(lower(p_type), 's.*l') THEN 1 END)::BIGINT AS hits, count(CASE WHEN regexp_full_match(lower(p_type), '.e.*') THEN 1 END)::BIGINT AS second FROM part GROUP BY 1")
def countif_wild(spark, d):
    t = read(spark, d, "part")
    return t.groupBy("p_brand").agg(A.count_if(crit(t, "p_type", "S*L")).alias("hits"), A.count_if(crit(t, "p_type", "=?e*")).alias("second"))


@REGISTER("xl_sumif", f"SELECT c_mktsegment, coalesce(round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal::{_D} END), 2), 0)::DOUBLE AS total FROM customer GROUP BY 1")
def sumif(spark, d):
    t = read(spark, d, "customer")
    return t.groupBy("c_mktsegment").agg(_money(A.sum_if(crit(t, "c_acctbal", ">0"), A.money(F.col("c_acctbal")))).alias("total"))


@REGISTER("xl_averageif", "SELECT event_type, round(avg(CASE WHEN value >= 10 THEN value END), 6) AS mean, CASE WHEN count(CASE WHEN value >= 10 THEN 1 END) = 0 THEN '#DIV/0!' END AS fault FROM events GROUP BY 1")
def averageif(spark, d):
    t = read(spark, d, "events")
    g = t.groupBy("event_type").agg(A.average_if(crit(t, "value", ">=10"), F.col("value")).alias("r"))
    return g.select("event_type", F.round(F.col("r.v"), 6).alias("mean"), F.col("r.e").alias("fault"))


@REGISTER("xl_countifs", "SELECT o_orderpriority, count(CASE WHEN lower(o_orderstatus) = 'f' AND o_totalprice <= 150000 THEN 1 END)::BIGINT AS hits FROM orders GROUP BY 1")
def countifs(spark, d):
    t = read(spark, d, "orders")
    return t.groupBy("o_orderpriority").agg(A.count_if(crit(t, "o_orderstatus", "=f") & crit(t, "o_totalprice", "<=150000")).alias("hits"))


@REGISTER("xl_countif_ne", "SELECT count(CASE WHEN lower(c_mktsegment) <> 'building' THEN 1 END)::BIGINT AS other, count(CASE WHEN c_nationkey <> 5 THEN 1 END)::BIGINT AS elsewhere, count(*)::BIGINT AS text_differs FROM customer")
def countif_ne(spark, d):
    t = read(spark, d, "customer")
    return t.agg(A.count_if(crit(t, "c_mktsegment", "<>building")).alias("other"), A.count_if(crit(t, "c_nationkey", "<>5")).alias("elsewhere"), A.count_if(crit(t, "c_name", "<>7")).alias("text_differs"))


@REGISTER("xl_countif_blank", "SELECT count(CASE WHEN x IS NULL OR x = '' THEN 1 END)::BIGINT AS blank, count(CASE WHEN x <> '' THEN 1 END)::BIGINT AS filled FROM (SELECT nullif(split_part(p_name, ' ', 3), '') AS x FROM part)")
def countif_blank(spark, d):
    part = F.split_part(F.col("p_name"), F.lit(" "), F.lit(3))
    t = read(spark, d, "part").select(F.when(part != "", part).alias("x"))
    return t.agg(A.count_if(crit(t, "x", "=")).alias("blank"), A.count_if(crit(t, "x", "<>")).alias("filled"))


@REGISTER("xl_countif_text_order", "SELECT count(CASE WHEN lower(n_name) >= 'j' THEN 1 END)::BIGINT AS late, count(CASE WHEN lower(n_name) < 'd' THEN 1 END)::BIGINT AS early FROM nation")
def countif_text(spark, d):
    t = read(spark, d, "nation")
    return t.agg(A.count_if(crit(t, "n_name", ">=J")).alias("late"), A.count_if(crit(t, "n_name", "<d")).alias("early"))


@REGISTER("xl_shown_errors", "SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN '#DIV/0!' ELSE (s_suppkey // s_nationkey)::VARCHAR END AS cell FROM supplier")
def shown_errors(spark, d):
    from ..functions.errors import DIV0, checked

    r = checked(F.floor(F.try_divide(F.col("s_suppkey"), F.col("s_nationkey"))), (F.col("s_nationkey") == 0, DIV0))
    return read(spark, d, "supplier").select("s_suppkey", shown(r).alias("cell"))
