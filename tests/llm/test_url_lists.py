"""Dated lists with entries of many path segments against a plain reading of the rules."""

import datetime

from tidewater.llm.url_lists import apply_lists

DAY = datetime.date(2024, 1, 10)
ENTRIES = [("block", "a.org/1/2/3/4"), ("allow", "a.org/1/2/3/4/5"), ("block", "b.org"), ("allow", "b.org/x/y/z/w"),
           ("block", "c.org/one"), ("block", "d.org/1/2/3")]
URLS = ["http://a.org/1/2/3", "http://a.org/1/2/3/4", "http://A.org/1//2/3/4?q", "http://www.a.org/1/2/3/4/6/7/8",
        "http://a.org/1/2/3/4/5/6", "http://a.org/1/2/3/45", "http://b.org/x/y/z", "http://b.org/x/y/z/w/v",
        "http://c.org/one/2/3/4/5", "http://d.org/1/2/3/4", "http://e.org/1/2/3/4", "http://b.org", None, "/1/2/3/4"]


def plain(url):
    """Number of covering entries and the longest one."""
    if url is None or "://" not in url:
        return 0, None
    host, _, path = url.split("://")[1].split("?")[0].lower().partition("/")
    steps = [x for x in path.split("/") if x]
    hit = []
    for name, pattern in ENTRIES:
        h, *want = pattern.split("/")
        if ("." + host).endswith("." + h) and steps[:len(want)] == want:
            hit.append((len(pattern), f"{name}:{pattern}"))
    return len(hit), max(hit)[1] if hit else None


def test_entries_of_any_depth(spark):
    pages = spark.createDataFrame([(i, u, DAY) for i, u in enumerate(URLS)], "page_id long, url string, day date")
    entries = spark.createDataFrame([(a, b, "add", datetime.date(2024, 1, 1)) for a, b in ENTRIES],
                                    "list string, pattern string, action string, day date")
    got = {r["page_id"]: (r["n_active"], r["rule"], r["blocked"]) for r in apply_lists(pages, entries).collect()}
    want = {i: (*plain(u), (plain(u)[1] or "").startswith("block:")) for i, u in enumerate(URLS)}
    assert got == want and got[4] == (2, "allow:a.org/1/2/3/4/5", False)
    none = apply_lists(pages, entries.limit(0)).collect()
    assert len(none) == len(URLS) and not any(r["n_active"] or r["blocked"] for r in none)


def verdicts(spark, urls, entries, days=None):
    pages = spark.createDataFrame([(i, u, d, 1, 2) for i, (u, d) in enumerate(zip(urls, days or [DAY] * len(urls)))],
                                  "page_id long, url string, day date, URL int, rule int")
    listed = spark.createDataFrame(entries, "list string, pattern string, action string, day date")
    rows = apply_lists(pages, listed).collect()
    assert len(rows) == len(urls)
    return [(r["n_active"], r["rule"], r["blocked"]) for r in sorted(rows, key=lambda r: r["page_id"])]


def on(*patterns):
    return [("block", p, "add", datetime.date(2024, 1, 1)) for p in patterns]


def test_path_keeps_its_case(spark):
    got = verdicts(spark, ["http://H.com/Admin/x", "HTTP://h.COM/admin/x"], on("H.com/Admin"))
    assert got == [(1, "block:h.com/Admin", True), (0, None, False)]


def test_trailing_and_double_slashes(spark):
    got = verdicts(spark, ["http://h.com/", "http://h.com", "http://g.com//a//b", "http://g.com/ab"], on("h.com/", "g.com//a/"))
    assert got == [(1, "block:h.com", True)] * 2 + [(1, "block:g.com/a", True), (0, None, False)]


def test_ipv6_and_ports(spark):
    got = verdicts(spark, ["http://[2001:DB8::1]/a", "http://u:p@[2001:db8::1]:80/b?x", "http://h.com.:8080/a", "http://[::1]/a"],
                   on("[2001:db8::1]", "h.com/a"))
    assert got == [(1, "block:[2001:db8::1]", True)] * 2 + [(1, "block:h.com/a", True), (0, None, False)]


def test_percent_escapes(spark):
    urls = ["http://h.com/%41dmin", "http://h.com/Admin", "http://h.com/a%2Fb", "http://h.com/a/b", "http://h.com/100%",
            "http://h.com/a+b", "http://h.com/a%2bb", "http://h.com/%c3%a9"]
    got = verdicts(spark, urls, on("h.com/Admin", "h.com/%41dmin", "h.com/a%2fb", "h.com/100%", "h.com/a+b", "h.com/é"))
    rule = [r and r.split("/", 1)[1] for _, r, _ in got]
    assert rule == ["%41dmin", "%41dmin", "a%2fb", None, "100%", "a+b", "a+b", "é"] and all(n <= 1 for n, _, _ in got)


def test_days_nulls_and_repeats(spark):
    d = datetime.date
    entries = [("block", "h.com", "add", d(2024, 1, 5)), ("block", "h.com", "add", d(2024, 1, 5)),
               ("block", "h.com", "remove", d(2024, 1, 8)), ("block", "h.com", "add", d(2024, 1, 8)),
               ("block", "h.com", "remove", d(2024, 1, 20)), ("block", "h.com", "remove", d(2024, 1, 25)),
               ("allow", "h.com", "add", d(2024, 1, 12)), ("allow", "h.com", "remove", d(2024, 1, 14)),
               (None, "h.com", "add", d(2024, 1, 1)), ("block", None, "add", d(2024, 1, 1)), ("block", "/x", "add", d(2024, 1, 1)),
               ("block", "h.com", "drop", d(2024, 1, 1)), ("block", "h.com", "add", None)]
    days = [d(2024, 1, 4), d(2024, 1, 5), d(2024, 1, 8), d(2024, 1, 12), d(2024, 1, 14), d(2024, 1, 20), None]
    urls = ["http://h.com/x"] * 7 + [None, "/x", "h.com/x", ""] + ["http://h.com/x"] * 3
    got = verdicts(spark, urls, entries, days + [DAY] * 7)
    no, yes = (0, None, False), (1, "block:h.com", True)
    assert got == [no, yes, yes, (2, "allow:h.com", False), yes, no, no, no, no, no, no, yes, yes, yes]


def test_subdomains_and_empty_tables(spark):
    got = verdicts(spark, ["http://a.b.h.com/x", "http://xh.com/", "http://com/"], on("h.com"))
    assert got == [(1, "block:h.com", True), (0, None, False), (0, None, False)]
    assert verdicts(spark, [], on("h.com")) == []
