"""Dated URL lists applied to captures at fetch time (operator 7); SQL functions only.

A list entry is dated: from its day on it adds or removes a pattern (a host, which covers
its subdomains, or a host with a path prefix) on a list.  Entries become validity intervals
[from, to) with one window per pattern; a capture is joined, by equality, with the intervals
of every pattern that could cover it (its host's suffixes, with and without prefixes of its
path), and an interval counts if the capture's fetch day lies in it.  The longest active
pattern decides, ``allow`` before ``block``.

Captures are reduced to distinct (host, path prefixes, day) before the join, so a host with
a third of all captures joins once for each path and day; the join itself is an equi-join
whose hot keys the skew join splits.

A prefix may name any number of path segments: captures keep as many as the longest pattern.

Special cases.  Null or relative URLs and null days match nothing and are kept.  Host and
scheme ignore case, a path does not; user, port, a final dot of the host, query and fragment
are ignored, and so are empty path segments, at the end of a pattern too.  Path segments that
differ in percent escapes alone are equal (``%41`` and ``A``; an escaped slash stays inside
its segment); an escape that is none stands for itself.  An IPv6 host keeps its brackets and has no suffixes.  Patterns that
mean the same are one pattern, named by the least spelling.  Repeated adds or removes change
nothing; on one day an add outranks a remove.  Null entry fields, or a pattern without a
host: the entry is ignored.  Repeated captures give one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick


def split_url(url) -> tuple:
    """Host (lower case) and path of a URL column; null if it has no host."""
    m = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)(?::\d*)?([^?#\s]*)"
    host = F.lower(F.regexp_replace(F.regexp_extract(url, m, 1), r"\.$", ""))
    return F.when(host != "", host), F.regexp_extract(url, m, 2)


def segments(path):
    """Path segments in one spelling: decoded and encoded again, so no separator is inside."""
    def one(x):
        return F.coalesce(F.url_encode(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))), x)

    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), one)


def intervals(entries: DataFrame) -> DataFrame:
    """``list, key, pattern, valid_from, valid_to`` (null: open) from ``list, pattern, action, day``."""
    days = entries.filter("list is not null and pattern is not null and day is not null and "
                          "action in ('add', 'remove')")
    host = F.lower(F.regexp_replace(F.substring_index("pattern", "/", 1), r"\.$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("pattern", "^[^/]*(.*)$", 1), "/+", "/"), "/$", "")
    key = F.array_join(F.concat(F.array(host), segments(path)), "/")
    days = days.select("list", "day", "action", F.concat(host, path).alias("pattern"), key.alias("key"),
                       host.alias("host")).filter("host <> ''")
    # One state per day: the window below holds the days of one pattern of one list.
    days = days.groupBy("list", "key", "day").agg(F.max(F.col("action") == "add").alias("on"), F.min("pattern").alias("pattern"))
    all_days = Window.partitionBy("list", "key")
    w = all_days.orderBy("day")
    days = days.withColumns({"was": F.lag("on").over(w), "pattern": F.min("pattern").over(all_days)})
    days = days.filter(F.col("on") != F.coalesce("was", F.lit(False)))
    days = days.withColumn("until", F.lead("day").over(w))
    return days.filter("on").select("list", "key", "pattern", F.col("day").alias("valid_from"),
                                    F.col("until").alias("valid_to"))


def apply_lists(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                day_col: str = "day") -> DataFrame:
    """``page_id, host, day, n_active`` (active entries that cover the capture), ``rule`` (the
    deciding ``list:pattern``, null if none) and ``blocked``, one row per capture."""
    spans = intervals(pick(entries, list="list", pattern="pattern", action="action", day="day"))
    # bounded: one row; no capture needs a longer prefix than the longest pattern has
    depth = spans.agg(F.max(F.size(F.split("key", "/")) - 1)).collect()[0][0] or 0
    host, path = split_url(F.col("url"))
    rows = pick(captures, id=id_col, url=url_col, day=day_col).select("id", "day", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("prefix", F.concat_ws("/", F.slice(segments("path"), 1, depth)))
    distinct = rows.filter("host is not null and day is not null").select("host", "prefix", "day").distinct()
    labels = F.when(F.startswith("host", F.lit("[")), F.array("host")).otherwise(F.split("host", r"\."))
    steps = F.filter(F.split("prefix", "/"), lambda x: x != "")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.when(
        i > 0, F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))).otherwise(""))
    keyed = distinct.select("host", "prefix", "day", F.explode(F.flatten(F.transform(
        hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))).alias("k2"))
    active = keyed.join(spans, (F.col("k2") == F.col("key")) & (F.col("day") >= F.col("valid_from")) &
                        (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    order = F.struct(F.length("key"), F.when(F.col("list") == "allow", 1).otherwise(0), F.col("pattern"))
    verdict = active.groupBy("host", "prefix", "day").agg(
        F.count("*").alias("n_active"), F.max_by(F.concat_ws(":", "list", "pattern"), order).alias("rule"))
    verdict = verdict.withColumnsRenamed({"host": "h2", "prefix": "p2", "day": "d2"})
    same = (F.col("host") == F.col("h2")) & (F.col("prefix") == F.col("p2")) & (F.col("day") == F.col("d2"))
    return rows.join(verdict, same, "left").select(
        F.col("id").alias("page_id"), "host", "day", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        "rule", F.coalesce(F.col("rule").startswith("block:"), F.lit(False)).alias("blocked"))
