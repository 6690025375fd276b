"""Contamination by items and texts full of placeholders, against a plain re-computation with slots."""

import collections
import random
import re
import time

import pytest

from kelpforge.llm import decontaminate


def template(text):
    """(kind or word, value) of each token; numbers and units only, texts here have no names."""
    out = []
    for t in re.findall(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*", text.lower()):
        kind = "#number" if t[0].isdigit() else "#unit" if t in decontaminate.UNITS else None
        out.append((kind or t, t if kind else ""))
    return out


def plain(item, text, similarity=0.8):
    """(matched windows, verbatim) if text holds item, with loops over all pairs of windows."""
    a, b = template(item), template(text)
    n = len(a) - 4
    diagonals, matched, same = collections.defaultdict(dict), set(), set()
    for i in range(n):
        for j in range(len(b) - 4):
            if [k for k, _ in a[i : i + 5]] == [k for k, _ in b[j : j + 5]]:
                diagonals[j - i][i] = sorted({(x, y) for (k, x), (_, y) in zip(a[i : i + 5], b[j : j + 5], strict=True) if k[0] == "#"})
    bare = lambda i: all(k[0] == "#" for k, _ in a[i : i + 5])
    for hits in diagonals.values():
        seeded = any(not bare(i) for i in hits)
        votes = collections.Counter(p for i, pairs in hits.items() if seeded for p in pairs)
        best = {}
        for (x, y), count in votes.items():
            best[x] = max(best.get(x, (-1, False, "", "")), (count, x == y, [-ord(c) for c in y], y))
        for i, pairs in hits.items():
            identical = all(x == y for x, y in pairs)
            if identical or seeded and all(best[x][3] == y for x, y in pairs):
                matched.add(i)
                same |= {i} if identical else set()
    return (len(matched), same == matched) if n > 0 and len(matched) >= similarity * n else None


WORDS = "red green blue cat dog tree house lake river stone".split()


def noise(rng, n, numbers):
    return " ".join(str(rng.randrange(30)) if rng.random() < numbers else "km" if rng.random() < 0.1 else rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("numbers", [0.3, 0.8, 1.0])
def test_slots_against_plain_loops(spark, numbers):
    rng = random.Random(int(numbers * 10))
    items = [(k, noise(rng, rng.randrange(8, 30), numbers)) for k in range(12)]
    docs = []
    for k, t in items:
        other = {str(v): str(rng.randrange(30, 60)) for v in range(30)}
        changed = " ".join(other.get(w, w) for w in t.split())
        broken = " ".join(other.get(w, w) if rng.random() < 0.8 else w for w in t.split())
        docs += [noise(rng, 20, numbers) + " " + x + " " + noise(rng, 20, numbers) for x in (t, changed, broken, t + " " + changed)]
    docs.append(noise(rng, 300, numbers))
    got = decontaminate.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i): told for d, text in enumerate(docs) for i, item in items if (told := plain(item, text))}
    assert {(r.doc_id, r.item_id): (r.matched_windows, r.verbatim) for r in got.collect()} == want
    assert len(want) >= 12


def test_large_number_tables_end_in_seconds(spark):
    rng = random.Random(1)
    table = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(2000))
    item = table()
    docs = [table() for _ in range(100)] + ["see " + item + " there", " ".join(["0"] * 2000)]
    items = spark.createDataFrame([(1, item), (2, "values of the table are " + table()), (3, " ".join(["0"] * 500))], "item_id long, text string")
    texts = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    began = time.time()
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontaminate.contaminated(texts, items).collect()}
    assert got == {(100, 1, True), (101, 3, True)}
    assert time.time() - began < 90
