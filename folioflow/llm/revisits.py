"""Not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

Captures are dealt by ranges of URL and time, so however many captures a URL has, no part
holds more of them than any other; only those of one URL at one very time stay together.  Inside a part a window carries the last full response
along; where a part begins inside a URL, what the parts before ended with is carried in, one
row per URL and part.  Nothing is joined by the base, which a whole third of the captures
may share.  Only ids, times and headers move; bodies stay where they are.

Validators.  Equal entity tags by weak comparison decide; where either side has none, a
Last-Modified equal to that of the base; a ``digest`` of the payload that both sides carry
must agree besides, and can decide alone.

Defined results
    null or empty url        resolved to nothing (status ``no_url``)
    null time                never a base; a revisit without time is ``no_base``
    ties in time             a response at the very time of a revisit is not earlier; among equals the highest record id is latest
    repeated rows            each gets its own result row
    null validators          a revisit with no validator that the base has too is ``unchecked`` and merges nothing
    null record id           a base or revisit like others; among bases of one time it is the lowest
    very long inputs         headers are carried whole; their size is that of a record's head, not of its body
    empty table              empty result
    clashing columns         ignored; only the named columns are read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Query parameters that do not select content.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")

#: Headers of a 304 that must not replace those of the stored response (RFC 9111, 3.2 and 4.3.4, and the fields of a connection).
KEPT_OUT = (
    "connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Scheme and leading ``www.``/``m.`` dropped, host in lower case, no default port, no fragment, tracking parameters out, the rest sorted, no trailing slash."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    pattern = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?]*)([^?]*)(.*)$"
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, pattern, 1)), r"^(?:www\.|m\.)|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, pattern, 2), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(bare, pattern, 3), r"^\?", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def _opaque(etag: Column) -> Column:
    """What weak comparison compares: the tag without its weakness mark."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def permitted(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~k.isin(*KEPT_OUT))


def lower_keys(headers: Column) -> Column:
    """Names in lower case; of names that differ in case alone, the last in order of name stays."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    return F.aggregate(
        entries,
        F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(e.key)), F.create_map(F.lower(e.key), e.value)),
    )


def _entries(headers: Column) -> Column:
    """Headers as what can be ordered."""
    return F.array_sort(F.map_entries(headers))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit with its base and merged headers.

    ``records``: ``record_id`` long, ``url`` string, ``at`` timestamp, ``kind`` (``response`` or
    ``revisit``), ``headers`` map<string,string>.  A response is full if its header map lacks
    ``content-range``.  Returns one row per revisit: ``record_id``, ``canonical``, ``status``,
    ``base_id``, ``base_at`` and ``merged`` headers (null unless ``resolved``).

    ``resolved`` means the validators agree as the head of this module says.  Disagreement is ``mismatch``.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "at", "kind", lower_keys(F.col("headers")).alias("headers"))
    full = (F.col("kind") == "response") & ~F.map_contains_key("headers", F.lit("content-range"))
    rows = rows.where((F.col("kind") == "revisit") | full)
    known = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so that a part is the same part wherever it is read.
    rows = checkpointed(rows.repartitionByRange(parts, "canonical", "at").withColumn("part", F.spark_partition_id()))
    live = rows.where(known).withColumns({"base": F.when(full, F.struct("at", "record_id", _entries(F.col("headers")).alias("headers"))), "when": F.unix_micros("at")})
    # Strictly earlier rows by time alone; of equal times the highest id, which max of the structs gives.
    earlier = Window.partitionBy("canonical", "part").orderBy("when").rangeBetween(Window.unboundedPreceding, -1)
    asked = live.withColumn("near", F.max("base").over(earlier)).where("kind = 'revisit'")
    # Captures of a URL at one time are in one part, so all that the parts before hold is earlier.
    ends = live.groupBy("canonical", "part").agg(F.max("base").alias("last"))
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canonical", "part", F.max("last").over(before).alias("far")).where("far is not null")
    found = asked.join(carried, ["canonical", "part"], "left").select("record_id", "canonical", "headers", F.coalesce("near", "far").alias("b"))
    found = found.select("record_id", "canonical", "headers", F.map_from_entries("b.headers").alias("stored"), F.col("b.record_id").alias("base_id"), F.col("b.at").alias("base_at"))
    lost = rows.where(~known & (F.col("kind") == "revisit")).select(
        "record_id", "canonical", "headers", F.lit(None).cast("map<string,string>").alias("stored"), F.lit(None).cast("long").alias("base_id"), F.lit(None).cast("timestamp").alias("base_at")
    )
    every = found.unionByName(lost)
    tag, old = _opaque(F.col("headers")["etag"]), _opaque(F.col("stored")["etag"])
    since, modified = F.trim(F.col("headers")["last-modified"]), F.trim(F.col("stored")["last-modified"])
    digest, body = F.trim(F.col("headers")["digest"]), F.trim(F.col("stored")["digest"])
    same = F.when(digest.isNotNull() & body.isNotNull(), digest == body)
    named = F.when(tag.isNotNull() & old.isNotNull(), tag == old).when(since.isNotNull() & modified.isNotNull(), since == modified)
    agree = F.coalesce(named & same, named, same)
    status = (
        F.when(F.col("canonical").isNull(), "no_url").when(F.col("base_at").isNull(), "no_base").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    )
    update = permitted(F.col("headers"))
    kept = F.map_filter("stored", lambda k, v: ~F.map_contains_key(update, k))
    return every.select(
        "record_id",
        "canonical",
        status.alias("status"),
        "base_id",
        "base_at",
        F.when(status == "resolved", F.map_concat(kept, update)).alias("merged"),
    )


def capture_log(pages: DataFrame, every_s: int = 37) -> DataFrame:
    """WARC-like records of a ``pages`` table, which has no captures of its own.

    Pages ``p`` and ``p + 1`` (``p`` even) are captured in full at the same second after 2024-01-01 and asked for again one hour and one
    day later.  The later asks are 304s.  By the page's number a page has an entity tag made from its body or, every fifth, a
    modification time; every ninth has a payload digest too.  Some asks carry a changed tag, time or digest or no validator at all, and every
    thirteenth page has a partial response in between.  Record ids are ``4 * page_id`` plus 0 to 3.
    """
    p, k = F.col("page_id"), F.col("k")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    base = F.lit(1704067200) + F.floor(p / 2) * (2 * every_s)
    pages = pages.select("page_id", "url", tag.alias("tag"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"), base.alias("s"))
    rows = pages.select("*", F.explode(F.when(p % 13 == 6, F.array(*map(F.lit, range(4)))).otherwise(F.array(*map(F.lit, range(3))))).alias("k"))
    sent = F.col("s") + F.element_at(F.array(F.lit(0), F.lit(3600), F.lit(86400), F.lit(1800)), k + 1)
    response, bare, timed = k.isin(0, 3), p % 11 == 4, p % 5 == 2
    etag = F.when(timed, None).when(response, F.col("tag")).when(bare, None).when(p % 7 == 3, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    modified = F.concat(F.lit("t"), F.col("s").cast("string"))
    since = F.when(~timed, None).when(response, modified).when(bare, None).when((p % 10 == 2) & (k == 2), "later").otherwise(modified)
    digest = F.when((p % 9 != 3) | (bare & ~response), None).when(k == 2, "other").otherwise(F.concat(F.lit("d"), p.cast("string")))
    named = {
        "ETag": etag, "Last-Modified": since, "Digest": digest, "X-Captured": sent.cast("string"), "Content-Length": F.when(response, F.col("size")).otherwise(0).cast("string"),
        "Cache-Control": F.concat(F.lit("max-age="), (k * 60).cast("string")), "Content-Range": F.when(k == 3, "bytes 0-9/*"),
    }
    headers = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in named.items())), lambda e: e.value.isNotNull()))
    return rows.select((p * 4 + k).alias("record_id"), "url", F.timestamp_seconds(sent).alias("at"), F.when(response, "response").otherwise("revisit").alias("kind"), headers.alias("headers"))
