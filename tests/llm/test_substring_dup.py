"""Repeated passages against brute force over all windows."""

import random
import re
from collections import Counter

import pytest

from tidewater.llm.substring_dup import remove_repeats


def brute(rows, size=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    n = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - size + 1):
            if n[tuple(w[a:a + size])] > 1:
                gone.update(range(a, a + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def fixture_rows():
    r = random.Random(5)
    word = lambda: r.choice("the of and a to in is it was for on that with as be".split()) \
        if r.random() < .5 else "".join(r.choice("abcdeé") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (34, 35, 36, 51, 200)]
    rows = []
    for i in range(120):
        t = text(r.randint(0, 90))
        for _ in range(r.randint(0, 2)):
            k = r.randint(0, len(t))
            t[k:k] = r.choice(passages)
        rows.append((i, r.choice([" ", "\n", "  "]).join(t)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "x " * 34), (204, "y " * 35), (205, "z " * 36),
             (206, "a b " * 60), (207, "a b c " * 60), (208, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]),
             (209, "Orre " * 5000), (210, " ".join(text(20000))), (211, "ab" * 90000)]
    return rows


@pytest.mark.parametrize("rows", [fixture_rows(), [], [(1, None)]], ids=["mixed", "empty", "null"])
def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_words string")
    got = remove_repeats(df).select("c0", "n_words", "n_removed", "kept").collect()
    assert sorted([tuple(x) for x in got], key=repr) == brute(rows)
