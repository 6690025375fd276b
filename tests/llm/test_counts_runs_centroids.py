"""Token counts, periodic runs and centroids against the library, brute force and whole-number arithmetic."""

import hashlib
import json
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kelpforge.llm import centroids, periodic_runs, queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.load_vocabulary(PATH)


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


ODD_TEXTS = [
    "", " ", "\n", "a <|endoftext|> b<|endoftext|><|endoftext", "aaaaaaaaaaaaaaaaaaaaaaa", "don't WE'LL 's 'T's \x1c\x1d y\x1cb\x85 \xa0\n\nz", " \t\n\r  x   \n", "x  \n\n y",
    "՘࢏ x꟎1", "日本語の文章。" * 40, "\U0001f600\U0001f468‍\U0001f469" * 9, "ⅷ\xb2\xbdx", "na\xefve caf\xe9 — “quoted”…",
]


# Token counts


def test_counts_equal_the_library_on_odd_and_random_texts(library, vocabulary):
    rng = random.Random(1)
    texts = ODD_TEXTS + ["".join(rng.choice("ab c'\n\t d1e!-tsl\xa0\xe9中 　") for _ in range(rng.randrange(200))) for _ in range(300)]
    assert token_counts.Counting(vocabulary).count(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_all_characters_are_split_as_the_library_does(library, vocabulary):
    texts = [f"a{c}{c}1{c} {c}-{c}" for c in map(chr, range(0x3000)) if not c.isspace()] + [f"a{c} {c}\n{c}b {c}{c} 1" for c in map(chr, range(0x3001)) if c.isspace()]
    assert token_counts.Counting(vocabulary).count(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_long_units_and_long_pre_tokens(library, vocabulary, monkeypatch):
    rng = random.Random(2)
    texts = ["a" * 100_001, "1a-" * 60_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ") for _ in range(200_000)), "中文。" * 40_000, "=" * 70_000]
    want = [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert token_counts.Counting(vocabulary).count(texts) == want
    monkeypatch.setattr(token_counts, "_LONG_UNIT", 50)
    monkeypatch.setattr(token_counts, "SLICE_CHARS", 1000)
    assert token_counts.Counting(vocabulary).count(texts) == want


def test_merging_all_at_once_equals_one_merge_after_another(vocabulary):
    rank = {(int(p >> 32), int(p & 0xFFFFFFFF)): (int(r), int(m)) for p, r, m in zip(vocabulary.pairs, vocabulary.ranks, vocabulary.merged, strict=True)}

    def one_by_one(symbols):
        while True:
            best = min(((rank[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
            if best is None:
                return len(symbols)
            k = best[1]
            symbols = symbols[:k] + [rank[symbols[k], symbols[k + 1]][1]] + symbols[k + 2 :]

    rng = random.Random(3)
    sequences = [[int(vocabulary.symbol_of[ord(c)]) for c in "".join(rng.choice("aest" if k % 2 else "abcdefghilmnorstu") for _ in range(rng.randrange(1, 40)))] for k in range(200)]
    owner = np.repeat(np.arange(200), list(map(len, sequences)))
    assert token_counts.merge_all(np.array(sum(sequences, []), np.int32), owner, vocabulary).tolist() == [one_by_one(s) for s in sequences]
    assert token_counts.merge_all(np.zeros(0, np.int32), np.zeros(0, np.int64), vocabulary).tolist() == []


def test_forgotten_units_are_counted_again(vocabulary, monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN_UNITS", 2)
    monkeypatch.setattr(token_counts, "KNOWN_CHARS", 4)
    counting = token_counts.Counting(vocabulary)
    assert [counting.count(["one two wonderful three", "four two"]) for _ in range(3)] == [[4, 2]] * 3
    assert all(len(u) <= 4 for u in counting.known)


def test_other_vocabularies_are_refused(tmp_path):
    told = json.load(open(PATH, encoding="utf-8"))
    for name, changed in [("word_bpe_49k.json", None), ("a.json", {"normalizer": {"type": "Lowercase"}}), ("b.json", {"model": {**told["model"], "merges": told["model"]["merges"][::-1]}})]:
        path = public_tokenizers.path(name) if changed is None else str(tmp_path / name)
        if changed:
            json.dump(told | changed, open(path, "w", encoding="utf-8"))
        with pytest.raises(ValueError):
            token_counts.load_vocabulary(path)


def test_count_tokens_in_odd_rows(spark, vocabulary):
    rows = [(1, None, 5), (2, "", 5), (None, "two words", 5), (3, "two words", 5), (3, "two words", 5), (4, "x " * 1025, 5), (-5, "\xe9", 5)]
    got = token_counts.count_tokens(frame(spark, rows, "doc_id long, text string, n_tokens int"), vocabulary)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 9, 2, False), (3, 9, 2, False), (3, 9, 2, False), (4, 2050, 1026, True), (-5, 2, 1, False)], key=str)
    assert token_counts.count_tokens(frame(spark, []), vocabulary).collect() == []
    assert token_counts.count_tokens(frame(spark, [("k", "a b")], "doc_id string, text string"), vocabulary, limit=1).first() == ("k", 3, 2, True)


def test_op11_equals_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 1024) for i, t in texts.items()}
    assert {r[0]: tuple(r[1:]) for r in queries.QUERIES["op11_token_counts"](spark, sf).collect()} == want


# Periodic runs


def plain_runs(w, least_words=24, least_periods=3):
    found = {}
    for p in range(1, len(w) // least_periods + 1):
        j = 0
        while j + p < len(w):
            begun = j
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - begun + p >= max(least_words, least_periods * p):
                found.setdefault((begun, j - begun + p), p)
            j += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def sequences(seed, n, letters):
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = [rng.randrange(rng.choice(letters)) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            if len(w) > 30:
                s, p = rng.randrange(len(w)), rng.randrange(1, 12)
                for i in range(s, min(len(w), s + rng.randrange(20, 90))):
                    w[i] = w[s + (i - s) % p]
        out.append(w)
    return out


def searched(texts, **options):
    return periodic_runs.find_runs(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts], np.int64), **options)


@pytest.mark.parametrize("at_once", [1 << 20, 100])
def test_runs_equal_brute_force(monkeypatch, at_once):
    monkeypatch.setattr(periodic_runs, "PAIRS_AT_ONCE", at_once)
    doubled = [0]
    for _ in range(10):
        doubled += [1 - x for x in doubled]
    texts = [*sequences(1, 150, [1, 2, 3, 20]), doubled, doubled * 4, [1] * 300, []]
    assert searched(texts) == [plain_runs(t) for t in texts]
    assert searched(texts, least_words=4, least_periods=2) == [plain_runs(t, 4, 2) for t in texts]
    assert searched([]) == []


def test_wrong_hashes_are_found_out(monkeypatch):
    class Wrong(periodic_runs.PrefixHashes):
        def __init__(self, words, draw):
            super().__init__(words, draw)
            if draw.random() == random.Random(0).random() or len(made) < 3:
                self.sums = self.sums * np.uint64(0)  # all stretches look alike
            made.append(1)

    made = []
    monkeypatch.setattr(periodic_runs, "PrefixHashes", Wrong)
    texts = sequences(4, 3, [2, 20]) + [[1, 2] * 20 + [3] + list(range(60))]
    assert searched(texts) == [plain_runs(t) for t in texts]
    assert len(made) > 3


def test_products_modulo_the_prime():
    rng = random.Random(5)
    prime = (1 << 61) - 1
    a, b = ([rng.randrange(prime) for _ in range(500)] + [0, 1, prime - 1, prime - 1] for _ in range(2))
    assert periodic_runs.mulmod(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % prime for x, y in zip(a, b, strict=True)]


def test_periodic_runs_in_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 12), (4, "a b " * 12), (4, "a b " * 12), (5, "x" + " y\x0bz\xa0" * 30_000), (6, "a b " * 11 + "a"), (-7, "\x85 " * 24)]
    got = periodic_runs.periodic_runs(frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, runs int"))
    assert got.columns == ["doc_id", "n_words", "runs", "strongest", "collapsed"]
    told = sorted((r[0], r[1], [tuple(x) for x in r[2]], r[3] and tuple(r[3]), r[4]) for r in got.collect() if r[0] is not None)
    ab, y = (0, 24, 2), (1, 60_000, 2)
    assert told[0] == (-7, 24, [(0, 24, 1)], (0, 24, 1), "\x85")
    assert told[1:4] == [(1, 0, [], None, ""), (2, 0, [], None, ""), (3, 0, [], None, "")]
    assert told[4:6] == [(4, 24, [ab], ab, "a b")] * 2
    assert told[6] == (5, 60_001, [y], y, "x y z\xa0") and told[7] == (6, 23, [], None, ("a b " * 11 + "a"))
    assert got.where("doc_id IS NULL").first()["collapsed"] == "a b"
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []


def test_strongest_is_told_exactly():
    assert periodic_runs.strongest([(9, 3 * 10**17 + 1, 10**17), (5, 3 * 10**17 + 2, 10**17), (7, 30, 10)]) == (5, 3 * 10**17 + 2, 10**17)
    assert periodic_runs.strongest([(9, 30, 10), (5, 60, 20), (5, 30, 10)]) == (5, 30, 10)
    assert periodic_runs.strongest([]) is None


def test_op12_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect()}
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for doc_id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if n > 4000:  # brute force is quadratic; the next test has a long one
            continue
        g = h // 10
        if h % 10 == 0 and n:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want = (len(runs), *best, milli, hexed("".join(f"{s},{m},{q}\n" for s, m, q in runs)), hexed(" ".join(x for i, x in enumerate(w) if i not in gone)))
        assert got[doc_id] == want, doc_id
    assert planted > 5 and len(got) == len(docs)


def test_planting_keeps_rows_without_words(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = [(ids[0], None), (ids[1], ""), (ids[2], "\t "), (ids[3], "one"), (None, "a  b")]
    assert sorted(map(tuple, periodic_runs.with_planted_runs(frame(spark, rows)).collect()), key=str) == sorted(rows, key=str)


# Centroids


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(np.float64(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            c[j] = [sum(x) // len(members) for x in zip(*members, strict=True)] if members else c[j]
    own = assign()
    distance = [far(v, c[o]) for (_, v), o in zip(kept, own, strict=True)]
    of = [sum(d for d, o in zip(distance, own, strict=True) if o == j) for j in range(len(c))]
    return [(i, o, d, of[o], sum(distance), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, own, distance, strict=True)]


def test_op13_equals_whole_number_arithmetic(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_centroids"](spark, sf).collect())) == sorted(plain_clusters(rows))


def test_ties_odd_vectors_and_few_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(-2, 3)) / 64 for _ in range(64)]) for i in range(300)] + [(i, [1e5 * rng.choice([-1, 1])] * 64) for i in range(300, 330)]
    rows += [(7, [0.5] * 64)] * 20 + [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [float("nan")] * 64), (405, [float("-inf")] + [1.0] * 63), (406, [None] + [1.0] * 63)]
    schema = "vec_id long, embedding array<double>, cluster int"
    got = centroids.cluster(spark.createDataFrame([(*r, 9) for r in rows], schema))
    assert sorted(map(tuple, got.collect())) == sorted(plain_clusters(rows))
    assert sorted(map(tuple, centroids.cluster(spark.createDataFrame([(*r, 9) for r in rows[:5]], schema)).collect())) == sorted(plain_clusters(rows[:5]))
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    alone = centroids.cluster(spark.createDataFrame([(None, [1.0] * 64, 1)] * 2 + [(3, [2.0**21] * 64, 1)], schema)).collect()
    assert [(r["vec_id"], r["distance"]) for r in alone] == [(None, 0)] * 2


def test_screening_never_decides_wrongly():
    rng = np.random.default_rng(7)
    for size in (3, 200, 1 << 20, (1 << 27) - 1):
        x, c = (rng.integers(-size, size + 1, (n, 64)) for n in (400, 16))
        c[5], c[9] = c[2], c[2] + (np.arange(64) == 3)  # equal centroids, and one that float32 can't tell from them
        x[:50] = c[rng.integers(0, 16, 50)]
        distance = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
        assert centroids.nearest(x, c).tolist() == [min(range(16), key=lambda j: (row[j], j)) for row in distance]
        low, high = centroids.intervals(x, c)
        true = distance - (x.astype(object) ** 2).sum(1)[:, None]
        assert all(Fraction(a) <= t <= Fraction(b) for a, t, b in zip(low.ravel().tolist(), true.ravel().tolist(), high.ravel().tolist(), strict=True))


def test_rows_of_one_cluster_are_added_before_they_move(spark, sf):
    moved = F.col("vector")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector")).where(centroids.is_kept(moved))
    start = centroids.first_centroids(rows, 16, 64)
    assert (centroids._moved(rows.repartition(7), start, 64) == centroids._moved(rows.coalesce(1), start, 64)).all()
