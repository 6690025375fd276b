"""Near-duplicate documents: SimHash fingerprints linked at a small Hamming distance through a vantage-point tree.

Distinct fingerprints are what is searched, so copies cost nothing. A tree over a bounded sample gives the shards: each
inner node has a vantage point and a radius, near fingerprints go left, others right. A fingerprint has one home shard,
and by the triangle inequality it can only link to fingerprints of those shards whose region its ball of `max_bits`
reaches; to those of them that come before its home it is sent as a visitor, so every pair meets exactly once. Inside a
shard the same splitting goes on in numpy until blocks are small enough to compare outright. A shard returns a spanning
forest of its links, never all pairs, and the forests' components are joined over all shards.

`similar_documents` links texts whose shingles have a Jaccard similarity of 0.8 or more, which is checked exactly. Whole
fingerprints of two such texts differ in ten bits of 64 on average, and a ball of that reach meets nearly every region
of a tree (see README), so only the closest texts are found through the tree. For all others the fingerprints of small
samples of a text are compared: PRINTS fingerprints a text, each of PRINT_SHINGLES shingles drawn by least hash.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpforge.llm._common import ROW, empty_if_null, free_name, join_heavy, settle, with_row_key
from kelpforge.llm.components import components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: The tree is fitted on so many fingerprints at most (by hash order); every fingerprint is indexed.
SAMPLE = 1 << 17
#: Fingerprints at home in a shard, about: as many as give 64 shards, but within these bounds.
SHARD_LEAST, SHARD_MOST = 1 << 12, 1 << 18
_BLOCK = 1 << 21
_HASHES_AT_ONCE = 1 << 14


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles in order, some at a time; fewer words than width are one shingle, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), _HASHES_AT_ONCE):
        cut = zip(starts[k : k + _HASHES_AT_ONCE].tolist(), ends[k : k + _HASHES_AT_ONCE].tolist(), strict=True)
        yield np.array([digest(joined[s:e], SEED) for s, e in cut], "<u8")


def majority(parts: Iterator[np.ndarray]) -> int:
    """64 bits as a signed integer; bit b is set if it is in over half of the hashes. No hashes: 0."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None) -> int:
    return majority(shingle_hashes(text, SHINGLE_WORDS))


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([fingerprint(t) for t in part], dtype="int64")


class VantageTree:
    """Regions of the Hamming space; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.points: list[int] = []
        self.radii: list[int] = []
        self.children: list[tuple[int, int]] = []  # a negative child c is leaf -c - 1
        self.leaves = 0
        self.root = self._grow(np.asarray(sample, np.uint64), leaves)

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        split = None
        if leaves > 1 and len(sample) > 1:
            point = sample[0]
            distance = np.bitwise_count(sample ^ point)
            split = _radius(distance)
        if split is None:
            self.leaves += 1
            return -self.leaves
        k = len(self.points)
        self.points.append(int(point))
        self.radii.append(split)
        self.children.append((0, 0))
        near = distance <= split
        left = self._grow(sample[near], leaves // 2)
        self.children[k] = (left, self._grow(sample[~near], leaves - leaves // 2))
        return k

    def route(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, index into values and whether it is the home, for all leaves that a ball of radius reach meets."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, index, home = todo.pop()
            if not len(index):
                continue
            if node < 0:
                out.append((np.full(len(index), -node - 1), index, home))
                continue
            distance = np.bitwise_count(values[index] ^ np.uint64(self.points[node])).astype(np.int64)
            near, left, right = distance <= self.radii[node], distance - reach <= self.radii[node], distance + reach > self.radii[node]
            todo.append((self.children[node][0], index[left], (home & near)[left]))
            todo.append((self.children[node][1], index[right], (home & ~near)[right]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _radius(distance: np.ndarray) -> int | None:
    """The radius that halves the points best, with points on both sides; None if all are equally far."""
    counts = np.cumsum(np.bincount(distance, minlength=65))
    inner = np.flatnonzero((counts > 0) & (counts < len(distance)))
    return int(inner[np.abs(counts[inner] - len(distance) / 2).argmin()]) if len(inner) else None


class _Forest:
    """Union-find over positions, in arrays; pairs are gathered and joined many at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.size += len(a)
        if self.size > 1_000_000:
            self.join()

    def join(self) -> np.ndarray:
        if self.waiting:
            a, b = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.waiting, self.size = [], 0
            while True:
                ra, rb = self.root[a], self.root[b]
                if not (apart := ra != rb).any():
                    break
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (self.root[self.root] != self.root).any():
                    self.root = self.root[self.root]
        return self.root


def link_shard(home: np.ndarray, visitors: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links home-home and home-visitor: fingerprints and the smallest linked one in the shard."""
    everyone = np.concatenate((home, visitors))
    order = np.argsort(everyone, kind="stable")  # so that the smallest position is the smallest value
    everyone, position = everyone[order], np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    forest = _Forest(len(everyone))
    todo = [(np.sort(position[: len(home)]), np.arange(len(everyone)))]
    while todo:
        mine, others = todo.pop()
        if len(mine) * len(others) > _BLOCK // 8:
            point = everyone[mine[len(mine) // 2]]
            d_mine = np.bitwise_count(everyone[mine] ^ point).astype(np.int64)
            d_others = np.bitwise_count(everyone[others] ^ point).astype(np.int64)
            t = _radius(d_mine)
            if t is not None:
                near, left, right = d_mine <= t, d_others <= t + reach, d_others > t - reach
                if near.sum() * left.sum() + (~near).sum() * right.sum() < 0.9 * len(mine) * len(others):
                    todo += [(mine[near], others[left]), (mine[~near], others[right])]
                    continue
        step = max(1, _BLOCK // max(1, len(others)))
        for k in range(0, len(mine), step):
            part = mine[k : k + step]
            a, b = np.nonzero(np.bitwise_count(everyone[part][:, None] ^ everyone[others][None, :]) <= reach)
            apart = part[a] != others[b]
            forest.link(part[a][apart], others[b][apart])
    root = forest.join()
    moved = np.flatnonzero(root != np.arange(len(root)))
    return everyone[moved], everyone[root[moved]]


def _router(tree: VantageTree, reach: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = part["fp"].to_numpy(np.int64)
            for k in range(0, len(values), _HASHES_AT_ONCE):
                some = values[k : k + _HASHES_AT_ONCE]
                leaf, index, home = tree.route(some.view(np.uint64), reach)
                at = np.empty(len(some), np.int64)
                at[index[home]] = leaf[home]
                sent = leaf <= at[index]
                yield pd.DataFrame({"shard": leaf[sent].astype(np.int32), "fp": some[index[sent]], "home": home[sent]})

    return route


def _linker(reach: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def link(shard: pd.DataFrame) -> pd.DataFrame:
        values, home = shard["fp"].to_numpy(np.int64).view(np.uint64), shard["home"].to_numpy(bool)
        a, b = link_shard(values[home], values[~home], reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return link


def linked_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS, sample: int = SAMPLE, shard_rows: int | None = None) -> DataFrame:
    """a, b for distinct fingerprints fp: links that connect all fingerprints at max_bits or fewer differing bits."""
    n = distinct.count()
    target = shard_rows or min(max(n // 64, SHARD_LEAST), SHARD_MOST)
    chosen = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(sample, max(64, 64 * n // target)))
    seen = np.array([r["fp"] for r in chosen.collect()], np.int64).view(np.uint64)
    tree = VantageTree(seen, max(1, min(-(-n // target), len(seen) // 8)))
    routed = distinct.select("fp").mapInPandas(_router(tree, max_bits), "shard int, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(_linker(max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, sample: int = SAMPLE, shard_rows: int | None = None
) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per input row.

    component_id is the smallest id that is reachable over links of max_bits or fewer differing bits, itself included.
    Null and empty texts have fingerprint zero and link like others. Rows without an id take part and never name a
    component that has an id; repeated rows give a row each. An empty table gives an empty result. Only id and text are
    read, so other columns cannot clash.
    """
    prints = settle(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(empty_if_null(F.col(text_col))).alias("fp")))
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members")))
    named = _roots(nodes, max_bits, sample, shard_rows)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    named = join_heavy(named, least, "root", "prints", nodes.count()).select("fp", "members", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return join_heavy(prints, named, "fp", "members", prints.count(), sizes=nodes).select("doc_id", shown, "component_id")


def _roots(nodes: DataFrame, max_bits: int, sample: int = SAMPLE, shard_rows: int | None = None) -> DataFrame:
    """nodes (fp, ...) with root, the smallest fingerprint of fp's component."""
    roots = components(linked_fingerprints(nodes, max_bits, sample, shard_rows)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


# Similarity of 0.8 and more

SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Two texts of similarity s share the fingerprint of one sample at least with probability 1 - (1 - s^PRINT_SHINGLES)^PRINTS: 0.9996 at 0.8.
PRINTS, PRINT_SHINGLES = 20, 5
#: Of each of the shingles drawn so many bits are kept; in two texts of similarity s a share of (1 - s)(1 - 2^-MARK_BITS) of
#: the shingles differs in them. Texts that differ in over MARKS_APART of 100 are not compared (chance 0.00002 at 0.8).
MARK_BITS, MARKS_APART, _MARK_SHIFT = 4, 36, 24
#: Bits that tell whether an odd number of a text's shingles falls on them: sets differ in as many shingles as bits, or more.
PARITY_BITS = 1024
#: Rows of a text's partners that one task compares with it, about.
_PARTNERS = 4096
#: Rows of a bucket that are compared with as many others in one piece.
_PIECE = 512
#: Rows of a bucket, drawn by hash, that all others meet in a further round of stars. Rounds go on while pairs that are not
#: joined yet exceed _FEW for each text and the last round left at most the share _PAYS of them.
_PIVOTS, _FEW, _PAYS = 4, 4, 0.75
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, (PRINTS * PRINT_SHINGLES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, (PRINTS * PRINT_SHINGLES, 1), dtype=np.uint64)
_COLUMNS_AT_ONCE = 512


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of five words in a row, sorted; a text without words has one, the hash of nothing."""
    parts = list(shingle_hashes(text, SIMILAR_WORDS)) or [np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)]
    return np.unique(np.concatenate(parts))


def drawn_hashes(hashes: np.ndarray) -> np.ndarray:
    """For each of PRINTS * PRINT_SHINGLES bijections of hashes the least value."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), _COLUMNS_AT_ONCE):
        np.minimum(least, (hashes[None, k : k + _COLUMNS_AT_ONCE] * _FACTORS + _SHIFTS).min(1), out=least)
    return least


def sample_prints(least: np.ndarray) -> list[int]:
    """Fingerprints of PRINTS samples of PRINT_SHINGLES drawn hashes each."""
    bits = np.unpackbits(least.view(np.uint8).reshape(PRINTS, PRINT_SHINGLES, 8), axis=2, bitorder="little")
    return np.packbits(bits.sum(1) * 2 > PRINT_SHINGLES, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def marks(least: np.ndarray) -> list[int]:
    """MARK_BITS bits of each drawn hash, as planes of 64-bit integers: first all first bits, then all second ones."""
    held = np.zeros((MARK_BITS, -(-len(least) // 64) * 64), np.uint8)
    for k in range(MARK_BITS):
        held[k, : len(least)] = (least >> np.uint64(_MARK_SHIFT + k)) & np.uint64(1)
    return np.packbits(held, axis=1, bitorder="little").view("<i8").ravel().tolist()


def parities(hashes: np.ndarray) -> list[int]:
    odd = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def parities_apart(one: str, two: str) -> Column:
    """In how many bits two columns of parities differ."""
    return reduce(operator.add, (F.bit_count(F.col(one)[w].bitwiseXOR(F.col(two)[w])) for w in range(PARITY_BITS // 64)))


def marks_apart(one: str, two: str) -> Column:
    """In how many of the drawn hashes two columns of marks differ."""
    words = -(-PRINTS * PRINT_SHINGLES // 64)
    differ = [[F.col(one)[k * words + w].bitwiseXOR(F.col(two)[k * words + w]) for k in range(MARK_BITS)] for w in range(words)]
    return reduce(operator.add, (F.bit_count(reduce(Column.bitwiseOR, planes)) for planes in differ))


_SKETCH = T.StructType([T.StructField("kind", T.StringType()), T.StructField("shingles", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("prints", T.ArrayType(T.LongType())), T.StructField("marks", T.ArrayType(T.LongType())), T.StructField("odd", T.ArrayType(T.LongType()))])


@F.pandas_udf(_SKETCH)
def _sketches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        rows = []
        for text in part:
            held = shingle_set(text)
            least = drawn_hashes(held)
            rows.append((xxhash.xxh3_128_hexdigest(held.tobytes()), len(held), majority(iter([held])), sample_prints(least), marks(least), parities(held)))
        yield pd.DataFrame(rows, columns=["kind", "shingles", "fp", "prints", "marks", "odd"])


@F.pandas_udf(T.DoubleType())
def _jaccard(own: pd.Series, other: pd.Series) -> pd.Series:
    out, told, held = [], None, None
    for a, b in zip(own, other, strict=True):
        if held is None or b != told:
            told, held = b, shingle_set(b)
        mine = shingle_set(a)
        both = len(np.intersect1d(mine, held, assume_unique=True))
        out.append(both / (len(mine) + len(held) - both))
    return pd.Series(out, dtype=float)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of similar texts. A text with many partners is dealt out as often as it has _PARTNERS of them."""
    pairs = settle(pairs.distinct())
    total = pairs.count()
    often = settle(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("deals", F.ceil(F.col("n") / _PARTNERS).cast("int")))
    dealt = join_heavy(pairs, often, "b", "n", total).select("a", "b", F.pmod(F.xxhash64("a"), F.col("deals")).alias("deal"))
    one = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    two = often.join(texts, often.b == texts.row).select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals").cast("long") - 1)).alias("deal"), F.col("text").alias("text_b"))
    return settle(dealt.join(one, "a").join(two, ["b", "deal"]).where(_jaccard("text_a", "text_b") >= similarity).select("a", "b"))


def _stars(buckets: DataFrame) -> DataFrame:
    """Pairs of each row of a bucket (bucket, row, n) with the least row of the bucket."""
    heads = buckets.groupBy("bucket").agg(F.min("row").alias("pivot"), F.count(F.lit(1)).alias("size"))
    both = join_heavy(buckets.select("bucket", "row"), heads, "bucket", "size", buckets.count())
    return both.where("row <> pivot").select(F.col("row").alias("a"), F.col("pivot").alias("b")).distinct()


def _crossing(buckets: DataFrame) -> int:
    """In how many pairs of rows of a bucket (bucket, row, root, shingles) the two are not joined yet, told by counts alone."""
    sizes = buckets.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
    pairs = sizes.agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
    return int(pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0])


def _more_stars(buckets: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs of each row of a bucket (bucket, row, root, shingles) with _PIVOTS others of it, drawn anew each turn, that it isn't joined with."""
    drawn = [F.min(F.struct(F.xxhash64("row", F.lit(turn * _PIVOTS + k)), "row", "root", "shingles")) for k in range(_PIVOTS)]
    heads = buckets.groupBy("bucket").agg(F.array_distinct(F.array(*(F.struct(d["row"].alias("row"), d["root"].alias("root"), d["shingles"].alias("shingles")) for d in drawn))).alias("pivots"), F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    both = join_heavy(buckets, settle(heads.where("low <> high")), "bucket", "size", buckets.count())
    fits = lambda p: (p["root"] != F.col("root")) & (F.least(p["shingles"], "shingles") >= similarity * F.greatest(p["shingles"], "shingles"))
    met = both.select("row", F.explode_outer(F.filter("pivots", fits)).alias("pivot")).where("pivot IS NOT NULL")
    return met.select(F.greatest("row", "pivot.row").alias("a"), F.least("row", "pivot.row").alias("b")).distinct()


def _rooted(buckets: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).select(F.col("a").alias("row"), F.col("b").alias("root"))
    return settle(buckets.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")))


def _open_pairs(buckets: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """Pairs of rows of a bucket (bucket, row, root, shingles) that are not joined yet and whose sizes and marks allow for the similarity.

    Only buckets with two roots or more are left. Each is cut into pieces of about _PIECE rows and every two pieces meet as a
    join key of their own, so that no bucket is one task's work. Of two sets of similarity s that hold n shingles together at most n (1 - s) / (1 + s)
    are in one set only, so sets with more parities apart are left out for certain; marks tell long texts apart, where
    parities don't. Rows of which only a passage is equal so meet inside the join and leave no pair behind.
    """
    sizes = buckets.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    left = join_heavy(buckets, sizes, "bucket", "size", buckets.count())
    left = settle(left.select("bucket", "row", "root", "shingles", F.ceil(F.col("size") / _PIECE).cast("int").alias("pieces")).join(heads.select("row", "marks", "odd"), "row"))
    left = left.withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int"))
    x = left.select("bucket", F.col("row").alias("a"), F.col("root").alias("root_a"), F.col("shingles").alias("n_a"), F.col("marks").alias("marks_a"), F.col("odd").alias("odd_a"), F.col("piece").alias("p"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("q"))
    y = left.select("bucket", F.col("row").alias("b"), F.col("root").alias("root_b"), F.col("shingles").alias("n_b"), F.col("marks").alias("marks_b"), F.col("odd").alias("odd_b"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("p"), F.col("piece").alias("q"))
    fit = (F.col("a") > F.col("b")) & (F.col("root_a") != F.col("root_b")) & (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    fit &= parities_apart("odd_a", "odd_b") * (1 + similarity) <= (F.col("n_a") + F.col("n_b")) * (1 - similarity) + 1e-6
    fit &= marks_apart("marks_a", "marks_b") <= MARKS_APART
    return x.join(y, ["bucket", "p", "q"]).where(fit).select("a", "b")


def similar_documents(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row, root for rows (row, text) with a row key: root is the least row reachable over links of `similarity` or more.

    Texts of equal shingle sets are one class, told by its least row. Classes of one component of the vantage-point tree,
    and classes that share the fingerprint of a sample, are candidates. Each is first checked against the least row of its
    candidates, so that a dense group becomes one component without its square. The least row may lie at a group's edge and be
    similar to few, so rounds with rows drawn by hash follow for as long as they join much; after that only pairs of
    candidates that are still in different components are checked.
    """
    texts = rows.select("row", empty_if_null(F.col("text")).alias("text"))
    own = settle(texts.select("row", _sketches("text").alias("s")).select("row", "s.*"))
    total = own.count()
    classes = own.groupBy("kind").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies"))
    known = settle(join_heavy(own.select("row", "kind"), classes, "kind", "copies", total).select("row", "first"))
    heads = settle(own.join(classes.select(F.col("first").alias("row")), "row").select("row", "shingles", "fp", "prints", "marks", "odd"))

    fps = settle(heads.groupBy("fp").agg(F.count(F.lit(1)).alias("members")))
    near = join_heavy(heads.select("row", "fp"), _roots(fps, MAX_BITS), "fp", "members", total, sizes=fps).select(F.col("root").alias("bucket"), "row")
    flat = heads.select("row", "shingles", F.explode("prints").alias("bucket"))
    shared = settle(flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    buckets = settle(join_heavy(flat, shared, "bucket", "size", total * PRINTS).select("bucket", "row", "shingles"))

    links = _verified(_stars(settle(near)).union(_stars(buckets)), texts, similarity)
    rooted = _rooted(buckets, links)
    before, turn = float("inf"), 0
    while _FEW * total < (apart := _crossing(rooted)) <= _PAYS * before:
        links = links.union(_verified(_more_stars(rooted, turn, similarity), texts, similarity))
        rooted, before, turn = _rooted(buckets, links), apart, turn + 1
    moved = components(links.union(_verified(_open_pairs(rooted, heads, similarity), texts, similarity))).select(F.col("a").alias("first"), F.col("b").alias("root"))
    return known.join(moved, "first", "left").select("row", F.coalesce("root", "first").alias("root"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar texts, with the columns of docs: the one with the smallest id, rows without an id last.

    Rows are told apart by a key of their own, so rows without an id, with a repeated id or given twice are decided one by
    one; of equal ids the row stays that comes first in the table as it is read. Null texts and texts without words are
    similar to each other only. No column of docs can clash with a name of this operator's own; an empty table gives an
    empty result.
    """
    name = free_name(docs, ROW)
    keyed = with_row_key(docs, name)
    rows = keyed.select(F.col(name).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    roots = settle(similar_documents(rows, similarity).join(rows.select("row", "id"), "row"))
    first = roots.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias(name))
    return keyed.join(first.select(name), name, "left_semi").select(*docs.columns)
