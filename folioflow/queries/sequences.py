"""Counters of nested lists and heavy hitters of contexts, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.heavy import verified_hitters
from ..operators.numbering import decimal_label, list_counters
from .register import Register, read

REGISTER = Register()

_PLACE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_STARTS = "[1, l_partkey % 5, 1, 0, 3, 1, l_suppkey % 2, 1, 1]"


@REGISTER(
    "dx_list_counters",
    f"""
WITH RECURSIVE p AS (
  SELECT *, l_orderkey // 100 AS doc, l_suppkey % 3 AS list, (l_linenumber - 1 + l_partkey % 4) % 9 AS lvl, {_STARTS} AS st,
    row_number() OVER (PARTITION BY l_orderkey // 100, l_suppkey % 3 ORDER BY {', '.join(_PLACE)}) AS pos
  FROM lineitem),
w AS (
  SELECT doc, list, pos, lvl, st, list_transform(range(0, 9), lambda k: CASE WHEN k = lvl THEN st[k + 1] ELSE -1 END) AS c FROM p WHERE pos = 1
  UNION ALL
  SELECT p.doc, p.list, p.pos, p.lvl, p.st, list_transform(range(0, 9), lambda k: CASE WHEN k < p.lvl THEN w.c[k + 1] WHEN k > p.lvl THEN -1 WHEN w.c[k + 1] < 0 THEN p.st[k + 1] ELSE w.c[k + 1] + 1 END)
  FROM w JOIN p ON p.doc = w.doc AND p.list = w.list AND p.pos = w.pos + 1)
SELECT doc, list, pos, lvl, array_to_string(list_transform(range(0, lvl + 1), lambda k: CASE WHEN c[k + 1] < 0 THEN st[k + 1] ELSE c[k + 1] END), '.') AS label FROM w""",
)
def nested_lists(spark, d):
    t = read(spark, d, "lineitem")
    starts = F.array(*(F.expr(x.replace("%", "% ")) for x in _STARTS.strip("[]").split(", ")))
    rows = t.select(F.floor(F.col("l_orderkey") / 100).alias("doc"), (F.col("l_suppkey") % 3).alias("list"), ((F.col("l_linenumber") - 1 + F.col("l_partkey") % 4) % 9).alias("lvl"), starts.alias("starts"), *_PLACE)
    rows = list_counters(rows, ["doc", "list"], _PLACE, "lvl", "starts")
    pos = F.row_number().over(Window.partitionBy("doc", "list").orderBy(*_PLACE)).cast("long")
    return rows.select("doc", "list", pos.alias("pos"), "lvl", decimal_label(F.col("counters"), F.col("lvl")).alias("label"))


#: Counters a context.
_K = 48


@REGISTER(
    "dc_heavy_words",
    f"""
WITH w AS (SELECT source || '/' || lang AS context, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS item FROM documents),
c AS (SELECT context, item, count(*) AS count FROM w GROUP BY context, item),
t AS (SELECT context, count(*) AS n FROM w GROUP BY context)
SELECT c.context, item, count, n, TRUE AS bounded FROM c JOIN t ON c.context IS NOT DISTINCT FROM t.context WHERE count * {_K + 1} > n""",
)
def heavy_words(spark, d):
    # Texts are dealt over all tasks: they are often read by a few, and long to cut and count.
    t = read(spark, d, "documents").select("doc_id", "text", "source", "lang").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    words = F.explode(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    return verified_hitters(t.select(F.concat("source", F.lit("/"), "lang").alias("context"), words.alias("item")), "context", "item", _K)
