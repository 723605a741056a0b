"""Benchmark passages against brute force over all windows."""

import random
import re
from collections import Counter

import pytest

from tidewater.llm.decontaminate import find_contamination


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def bag(w):
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, items):
    out = []
    for d, t in rows:
        w = words(t)
        for i, x in items:
            want = words(x)
            if not want:
                continue
            best, b = None, bag(want)
            for a in range(len(w) - len(want) + 1):
                c = bag(w[a:a + len(want)])
                least, most = sum((c & b).values()), sum((c | b).values())
                if 100 * least >= 80 * most and (best is None or least / most > best[0]):
                    best = (least / most, a)
            if best:
                out.append((d, i, best[0], best[1]))
    return sorted(out, key=repr)


def fixture():
    r = random.Random(9)
    text = lambda n: [r.choice("the of and a to in is".split()) if r.random() < .3 else
                      "".join(r.choice("abcde") for _ in range(4)) for _ in range(n)]
    items = [(i, " ".join(text(r.randint(1, 60)))) for i in range(60)]
    items += [(60, None), (61, ""), (62, items[3][1]), (63, "x y x y x y x y x y x y x y x y")]
    rows = []
    for i in range(80):
        t = text(r.randint(0, 80))
        if i % 2:
            p = r.choice(items[:60])[1].split()
            if i % 4 == 1 and len(p) > 20:
                p[r.choice([0, len(p) - 1])] = "changed"
            if i % 8 == 3:
                p = [x.upper() for x in p]
            k = r.randint(0, len(t))
            t[k:k] = p
        rows.append((i, r.choice([" ", "\n"]).join(t)))
    rows += [(100, None), (101, ""), (102, "y x " * 40), (None, items[40][1]), (103, items[41][1]),
             (103, items[41][1])]
    return rows, items


@pytest.mark.parametrize("rows, items", [fixture(), ([], fixture()[1]), (fixture()[0], [])],
                         ids=["mixed", "no documents", "no items"])
def test_against_brute_force(spark, rows, items):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(docs, bench).collect()
    assert sorted([tuple(x) for x in got], key=repr) == brute(rows, items)


def test_documents_shorter_than_an_item(spark):
    """An item with words cut off at either end is found while 80 % of its shingles are there."""
    item = [f"w{i}" for i in range(44)]  # 40 shingles
    rows = [(i, " ".join(w)) for i, w in enumerate(
        [item[1:], item[:-1], item[4:-4], item[:-8], item[:-9], item[:10], ["x", *item[:-3], "y"], [], item[:4]])]
    docs = spark.createDataFrame([*rows, (None, rows[1][1])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "a b c d")], "item_id long, text string")
    got = sorted((tuple(x) for x in find_contamination(docs, bench).collect()), key=repr)
    want = [(i, 7, n / 40, 0) for i, n in ((0, 39), (1, 39), (2, 32), (3, 32), (None, 39))]
    assert got == sorted([*want, (6, 7, 37 / 42, 0)], key=repr)
