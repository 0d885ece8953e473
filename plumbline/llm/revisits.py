"""Not-modified revisits of a web archive, resolved to the latest earlier full response of the same page.

All of it is DataFrame expressions. The as-of join cuts time into buckets at quantiles: the last response of each
(page, bucket) is aggregated first, a window over a page's buckets carries it forward, and a window inside each
(page, bucket) finishes the join. So a page with a third of all captures is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from .runtime import keep

# Header fields that a 304 may not replace, since they describe one message or one connection.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that do not name another page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid", "sessionid")


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, www., user and default port; path without index page and trailing slash;
    query without tracking parameters, sorted; no fragment. Null and blank stay null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/(index\.(html?|php))?$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING)))
    full = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.length(host) > 0, full)


def parse_headers(block: Column) -> Column:
    """A raw header block as a map of lower-case names; of repeated fields the first counts, lines without a colon don't."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1))


def resolve(records: DataFrame, time_buckets: int | None = None) -> DataFrame:
    """records(record_id, url, ts, record_type, status, http_headers, ...) ->
    (record_id, page, ts, outcome, response_id, age_s, headers), a row a revisit.

    A revisit is a record of type 'revisit' or status 304; a full response is of type 'response' and status 200.
    It resolves to the response with the same canonical url and the latest ts strictly before its own (ties: the
    larger record_id). outcome: 'resolved' if ETags agree (weak comparison) or, where one lacks an ETag,
    Last-Modified agrees; 'unchecked' if no validator is on both; 'changed' if they disagree; 'no_response'
    without an earlier response; 'incomplete' for a null url, id or time. headers are the response's, updated by
    the revisit's permitted fields, as sorted 'name: value' lines; null unless resolved or unchecked. Null header
    blocks are empty. Repeated records are rows of their own; an empty table gives no rows. Header blocks and urls of
    any length are read whole; other columns are ignored. There are as many time buckets as the rows need, or
    time_buckets.
    """
    full = (F.col("record_type") == "response") & (F.col("status") == 200)
    revisit = (F.col("record_type") == "revisit") | (F.col("status") == 304)
    slim = records.select("record_id", canonical_url(F.col("url")).alias("page"), "ts", F.coalesce(full, F.lit(False)).alias("full"), F.coalesce(revisit, F.lit(False)).alias("revisit"), parse_headers(F.coalesce("http_headers", F.lit(""))).alias("h")).where("full or revisit")
    whole = F.col("page").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    slim = keep(slim, "records")  # headers are parsed once
    known = slim.where(whole)
    cuts = None
    if time_buckets is not None:
        cuts = known.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [i / time_buckets for i in range(1, time_buckets)] or [1.0], 10 * time_buckets)).first()[0] or []
    known = ordered.bucketed(known.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))), "_at", cuts).drop("_at").withColumnRenamed("_bucket", "bucket")
    answer = F.when(F.col("full") & ~F.col("revisit"), F.struct("record_id", "ts", "h"))
    last = known.groupBy("page", "bucket").agg(F.max_by(answer, F.when(F.col("full") & ~F.col("revisit"), F.struct("ts", "record_id"))).alias("own"))
    carried = last.select("page", "bucket", F.last("own", ignorenulls=True).over(Window.partitionBy("page").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("page", "bucket").orderBy("ts", F.col("revisit").desc(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = known.join(carried, ["page", "bucket"]).withColumn("r", F.coalesce(F.last(answer, ignorenulls=True).over(inside), "carried")).where("revisit")
    mine, theirs = F.col("h"), F.col("r.h")
    etag = lambda m: F.regexp_replace(m["etag"], "^W/", "")
    same = F.coalesce(etag(mine) == etag(theirs), mine["last-modified"] == theirs["last-modified"])
    outcome = F.when(F.col("r").isNull(), "no_response").when(same, "resolved").when(~same, "changed").otherwise("unchecked")
    fresh = F.map_filter(mine, lambda k, v: ~k.isin(*NOT_MERGED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    lines = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    done = joined.withColumn("outcome", outcome).select("record_id", "page", "ts", "outcome", F.col("r.record_id").alias("response_id"), (F.unix_seconds("ts") - F.unix_seconds("r.ts")).alias("age_s"), F.when(F.col("outcome").isin("resolved", "unchecked"), lines).alias("headers"))
    rest = slim.where(~whole & F.col("revisit")).select("record_id", "page", "ts", F.lit("incomplete").alias("outcome"), F.lit(None).cast(dict(slim.dtypes)["record_id"]).alias("response_id"), F.lit(None).cast("long").alias("age_s"), F.lit(None).cast("string").alias("headers"))
    return done.unionAll(rest)


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records out of pages(page_id, url, html): each page's full response, and its later revisits.

    Every page is asked for again after a day; every third once more with another ETag; every fifth also before
    its response; every seventh by another spelling of its url and without ETag. A null url is empty, a null html gives
    records without headers; repeated rows give their records again, an empty table none.
    """
    base, tag = F.lit(1_700_000_000) + F.col("page_id") * 60, F.substring(F.md5("html"), 1, 12)
    url, day = F.coalesce("url", F.lit("")), 86_400

    def record(suffix: str, at: Column, address: Column, kind: str, status: int, block: Column, when: Column) -> Column:
        row = F.struct(F.concat(F.col("page_id").cast("string"), F.lit(suffix)).alias("record_id"), address.alias("url"), F.timestamp_seconds(at).alias("ts"), F.lit(kind).alias("record_type"), F.lit(status).alias("status"), block.alias("http_headers"))
        return F.when(when, row)

    def block(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    stamp = F.concat(F.lit("t"), (F.col("page_id") % 9).cast("string"))
    first = block("ETag: \"", tag, "\"\r\nLast-Modified: ", stamp, "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length("html").cast("string"), "\r\nCache-Control: max-age=60\r\nServer: a")
    again = block("ETag: W/\"", tag, "\"\r\nContent-Length: 0\r\nConnection: close\r\nCache-Control: max-age=600\r\nDate: d", (F.col("page_id") % 100).cast("string"))
    other = block("ETag: \"x", tag, "\"\r\nLast-Modified: ", stamp)
    third = block("Last-Modified: ", stamp, "\r\nVary: accept\r\nno colon here")
    yes = F.lit(True)
    rows = F.array(
        record("-r", base, url, "response", 200, first, yes),
        record("-a", base + day, url, "revisit", 304, again, yes),
        record("-b", base + 2 * day, url, "revisit", 304, other, F.col("page_id") % 3 == 0),
        record("-c", base - day, url, "revisit", 304, again, F.col("page_id") % 5 == 0),
        record("-d", base + 3 * day, F.concat(F.regexp_replace(url, "^https?://", "HTTP://www."), F.lit("#part")), "revisit", 304, third, F.col("page_id") % 7 == 0),
    )
    return pages.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("x")).select("x.*")
