"""The pipeline's near-copy stage against brute force over all pairs."""

import collections

import corpus_pipeline
import numpy as np
from kelpforge.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string"


def plain_links(docs, least=0.8):
    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: shingles(t) for d, t in docs}
    index = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    both = collections.Counter((a, b) for m in index.values() for a in m for b in m if a < b)
    return [(a, b) for (a, b), n in both.items() if n / (len(sets[a]) + len(sets[b]) - n) >= least]


def plain_lost(docs):
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in plain_links(docs):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {d for d in root if find(d) != d}


def test_stage_against_all_pairs(spark):
    docs = exact_dedup.drop_exact_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.remove_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    lost = plain_lost(rows)
    assert lost and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - lost


def test_stage_drops_three_word_edits_and_keeps_the_rest(spark):
    words = [f"w{k}" for k in range(248)]
    edited = [f"x{k}" if k in (20, 120, 220) else w for k, w in enumerate(words)]
    other = words[:124] + [f"y{k}" for k in range(124)]
    docs = spark.createDataFrame([(5, " ".join(edited)), (3, " ".join(words)), (4, " ".join(other)), (None, None), (6, "a b"), (None, " ".join(words)), (7, "a c")], SCHEMA)
    kept = simhash.drop_near_duplicates(docs).collect()
    assert collections.Counter(r.doc_id for r in kept) == {3: 1, 4: 1, None: 1, 6: 1, 7: 1}
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_dense_group_leaves_one(spark):
    """Forty copies, each with one word of its own, so that no two are equal."""
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(f"e{k}" if j == k else w for j, w in enumerate(base))) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()] == [0]


def test_links_reach_over_rows_that_are_lost(spark):
    """a-b and b-c are similar, a-c isn't: all three are one group, also where b is no one's least partner."""
    base = [f"w{k}" for k in range(200)]
    edit = lambda n, c: " ".join(f"{c}{j}" if j in n else w for j, w in enumerate(base))
    a, b, c = edit((), "x"), edit((20, 60, 100), "x"), edit((20, 60, 100, 140, 160, 180), "x")
    rows = [(1, a), (3, b), (2, c), (9, " ".join(base[::-1]))]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 9]


def test_buckets_of_unlike_rows_and_clashing_names(spark):
    """Texts that share two thirds of their shingles with all others are compared in pieces and all stay."""
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base + [f"e{k}_{j}" for j in range(40)])) for k in range(30)] + [(99, " ".join(base + [f"e7_{j}" for j in range(38)]))]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("__row", "__row_", "row", "root", "bucket"):
        docs = docs.selectExpr("*", f"1 AS {name}")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(30))


def test_sketches_tell_apart_no_similar_texts(spark):
    """Parities never exceed the shingles that are in one set only; marks differ in as many hashes as the low bits drawn do."""
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 150, 900, 20_000)]
    pairs = [(s, s[: max(1, int(len(s) * share))]) for s in sets for share in (1, 0.95, 0.8, 0.5)]
    rows, wanted = [], []
    for k, (a, b) in enumerate(pairs):
        x, y = simhash.drawn_hashes(a), simhash.drawn_hashes(b)
        rows.append((k, simhash.marks(x), simhash.marks(y), simhash.parities(a), simhash.parities(b)))
        low = np.uint64(simhash._MARK_SHIFT)
        wanted.append((len(a) - len(b), int((((x ^ y) >> low) & np.uint64((1 << simhash.MARK_BITS) - 1) != 0).sum())))
    df = spark.createDataFrame(rows, "k int, ma array<long>, mb array<long>, oa array<long>, ob array<long>")
    told = df.select("k", simhash.parities_apart("oa", "ob").alias("odd"), simhash.marks_apart("ma", "mb").alias("marks")).orderBy("k").collect()
    for r, (a, b), (apart, marks) in zip(told, pairs, wanted, strict=True):
        assert r.odd <= apart and r.marks == marks
        assert len(b) < 0.8 * len(a) or r.marks <= simhash.MARKS_APART


def test_group_around_the_threshold(spark):
    """Edits of one text, from few to many: rows that are similar to any other row go, all others stay."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(150)]
    docs = []
    for k in range(120):
        at = set(rng.choice(150, rng.integers(0, 9), replace=False).tolist())
        docs.append((k, " ".join(f"e{k}" if j in at else w for j, w in enumerate(base))))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert kept == {k for k, _ in docs} - plain_lost(docs) and 1 < len(kept) < 119


def test_dense_group_whose_least_rows_lie_at_its_edge(spark, monkeypatch):
    """The least row of every bucket is similar to no other, so what joins the group are further rounds and not its square."""
    base = [f"w{k}" for k in range(150)]
    edit = lambda k, n: " ".join(f"e{k}_{j}" if (j - k) % (150 // n) == 0 else w for j, w in enumerate(base))
    rows = [(k, edit(k, 5)) for k in range(25)] + [(100 + k, edit(k, 1)) for k in range(140)]
    made, open_pairs = [], simhash._open_pairs

    def counted(*args):
        found = open_pairs(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(simhash, "_open_pairs", counted)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {k for k, _ in rows} - plain_lost(rows)
    assert len(made) == 1 and made[0] < 20 * len(rows)
