"""Periodic stretches of words, such as a phrase that a broken page repeats over and over.

For every period p a harmonic grid of positions, max(24, 3 p) - p words apart, is laid over each text: a run long enough
to count equals itself shifted by p on a stretch that holds a grid point. All (period, grid point) pairs of many texts
are worked on at once: those whose words are equal are extended to both sides by binary search over prefix hashes. Of
runs that end up with the same bounds the least period stays, and the words of each run are then compared themselves. A
text where that fails is searched again under another base, so results never rest on hashes.

A text of n words has about n/2 ln(n/24) pairs, made in blocks; texts are independent and nothing is shuffled, so hot
keys don't matter and a lost task is searched again from its input.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpforge.llm._common import empty_if_null

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: (period, grid point) pairs that are worked on at once, and words of texts that are searched together.
PAIRS_AT_ONCE, WORDS_AT_ONCE = 1 << 20, 1 << 19

_PRIME = np.uint64((1 << 61) - 1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_S61, _S31, _S30, _ONE = np.uint64(61), np.uint64(31), np.uint64(30), np.uint64(1)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> _S61)
    return np.where(x >= _PRIME, x - _PRIME, x)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for factors below that prime, in halves that 64 bits hold."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _fold(_fold(((a1 * b1) << _ONE) + (middle >> _S30) + ((middle & _LOW30) << _S31)) + _fold(a0 * b0))


class PrefixHashes:
    """Polynomial hashes of all prefixes of a sequence, in a random base."""

    def __init__(self, words: np.ndarray, draw: random.Random):
        power = np.ones(1, np.uint64)
        step = np.array([draw.randrange(1 << 32, int(_PRIME))], np.uint64)
        while len(power) <= len(words):
            power = np.concatenate([power, mulmod(power, step)])
            step = mulmod(step, step)
        self.power = power[: len(words) + 1]
        terms = mulmod(words.astype(np.uint64) + _ONE, self.power[:-1])
        halves = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (terms >> _S31, terms & _LOW31))
        high, low = (_fold(x) for x in halves)
        self.sums = _fold(mulmod(high, np.full(1, 1 << 31, np.uint64)) + low)

    def same(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether as many words as size from x on hash as those from y on, for x < y."""
        left = _fold(self.sums[x + size] + _PRIME - self.sums[x])
        return mulmod(left, self.power[y - x]) == _fold(self.sums[y + size] + _PRIME - self.sums[y])

    def longest(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, of most at most, are equal from x and y on; with back, how many before them."""
        least, most = np.zeros_like(most), most.copy()
        while (open_ := least < most).any():
            middle = (least + most + 1) >> 1
            same = self.same(x - middle, y - middle, middle) if back else self.same(x, y, middle)
            least = np.where(open_ & same, middle, least)
            most = np.where(open_ & ~same, middle - 1, most)
        return least


def _grid(sizes: np.ndarray, least_words: int, least_periods: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text, period, grid point within the text) for all texts and periods."""
    periods = np.where(sizes >= least_words, sizes // least_periods, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(least_words, least_periods * period) - period
    points = -(-(sizes[text] - period) // step)
    ends = np.cumsum(points)
    begun = 0
    while begun < len(text):
        done = max(begun + 1, int(np.searchsorted(ends, (ends[begun - 1] if begun else 0) + PAIRS_AT_ONCE, "right")))
        n = points[begun:done]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(text[begun:done], n), np.repeat(period[begun:done], n), at * np.repeat(step[begun:done], n)
        begun = done


def find_runs(words: np.ndarray, sizes: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, seed: int = 0) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period. words: the texts' word numbers end to end."""
    begins = np.cumsum(sizes) - sizes
    hashes = PrefixHashes(words, random.Random(seed))
    found = [np.zeros((0, 4), np.int64)]
    for text, period, point in _grid(sizes, least_words, least_periods):
        x = begins[text] + point
        equal = words[x] == words[x + period]
        text, period, x = text[equal], period[equal], x[equal]
        begin, y = begins[text], x + period
        start = x - hashes.longest(x, y, x - begin, back=True)
        end = y + hashes.longest(x, y, begin + sizes[text] - y, back=False)
        long = end - start >= np.maximum(least_words, least_periods * period)
        found.append(np.unique(np.stack([text, start, end, period], 1)[long], axis=0))
    runs = np.concatenate(found)
    runs = runs[np.lexsort(runs.T[::-1])]
    same_bounds = (runs[1:, :3] == runs[:-1, :3]).all(1)
    runs = runs[np.r_[True, ~same_bounds]] if len(runs) else runs
    told: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    wrong = set()
    for text, start, end, period in runs.tolist():
        if not np.array_equal(words[start : end - period], words[start + period : end]):
            wrong.add(text)
        begin = int(begins[text])
        told[text].append((start - begin, end - start, period))
    for text in wrong:
        own = slice(begins[text], begins[text] + sizes[text])
        told[text] = find_runs(words[own], sizes[text : text + 1], least_words, least_periods, seed + 1)[0]
    return [sorted(t, key=lambda r: (r[0], r[2])) for t in told]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, compared exactly; of several the first, then the one with the least period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words).decode()
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]).decode()


_RUN = "struct<start: long, length: long, period: long>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _searched(texts: list[bytes], least_words: int, least_periods: int) -> Iterator[tuple[int, list, tuple | None, str]]:
    """Number of words, runs, strongest run and collapsed text of each text; texts are searched together up to WORDS_AT_ONCE words."""

    def told(split: list[list[bytes]]) -> Iterator[tuple[int, list, tuple | None, str]]:
        number: dict[bytes, int] = {}
        numbers = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64)
        sizes = np.array([len(words) for words in split], np.int64)
        for words, runs in zip(split, find_runs(numbers, sizes, least_words, least_periods), strict=True):
            yield len(words), runs, strongest(runs), collapse(words, runs)

    waiting, held = [], 0
    for text in texts:
        waiting.append(text.split())  # of bytes: at 0x20 and 0x09 to 0x0D, and nowhere else
        held += len(waiting[-1])
        if held >= WORDS_AT_ONCE:
            yield from told(waiting)
            waiting, held = [], 0
    yield from told(waiting)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), strongest run, collapsed text: one row per input row.

    Words are stretches without 0x20 and 0x09-0x0D, numbered from 0. A run is a stretch of words with least period q, of
    max(least_words, least_periods * q) words or more, that no neighbouring word extends; least_periods is 2 or more.
    strongest has the greatest length / period (then the smallest start, then period), null without a run. collapsed
    holds the words, joined by a blank, that no run holds after its first period. Null and empty texts, and those of
    white space, have no words, no runs and an empty collapsed text. Ids are of any type; repeated rows and rows without
    an id are searched each for itself; further columns are neither read nor returned; an empty table gives an empty
    result. A task holds one text at a time or WORDS_AT_ONCE words, at about a hundred bytes a word.
    """
    if least_words < 1 or least_periods < 2:
        raise ValueError("a run has a word or more and two periods or more")
    rows = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(F.col(text_col)).cast("binary").alias("text"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun in range(0, batch.num_rows, 256):
                part = batch.slice(begun, 256)
                told = list(_searched(part.column("text").to_pylist(), least_words, least_periods))
                n_words, runs, best, collapsed = zip(*told, strict=True)
                as_run = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([[as_run(r) for r in rs] for rs in runs], pa.list_(_RUN_TYPE)), pa.array(map(as_run, best), _RUN_TYPE), pa.array(collapsed, pa.string())],
                    ["doc_id", "n_words", "runs", "strongest", "collapsed"],
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(searched, f"doc_id {id_type}, n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs, where crc32 of the id in decimal is divisible by 10 with a text whose end repeats some of its words.

    With g = crc32 / 10 rounded down and n words, the words from a = g % n on become those from a on, over and over with
    period 1 + floor((n - a) / (3 + g % 8)). Rows without an id or without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = docs.select("doc_id", "text", words.alias("words"), ((h - h % 10) / 10).cast("long").alias("g"), F.size(words).alias("n"))
    a = F.pmod("g", F.nullif(F.greatest("n", F.lit(0)), F.lit(0))).cast("int")
    first = split.withColumns({"a": a, "rest": F.col("n") - a})
    told = first.withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.pmod("g", F.lit(8))))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(F.col("rest") / F.col("p")).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice("words", 1, F.col("a")), again), 1, F.col("n")), " ")
    return told.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
