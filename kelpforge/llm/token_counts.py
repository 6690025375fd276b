"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous merging of ragged arrays.

A text is cut into units (white space and what follows up to the next white space), which no token crosses. Units that a
task meets for the first time are split into pre-tokens by the vocabulary's own splitter and laid end to end in one flat
array of symbols, with a number of its sequence beside each. In every round each sequence's lowest-rank pair is merged
wherever it stands in that sequence, for all sequences at once; a sequence without a known pair leaves the array, and
what is left of it is its count. Merging one pair everywhere is what one merge after another gives, since a pair that
holds a new symbol always ranks behind the pair that made it (`load_vocabulary` checks that).

A sequence is a stretch of a pre-token between two bytes that no token of the vocabulary holds side by side, so that a
very long pre-token gives many short sequences. Nothing is shuffled, and a lost task is counted again from its input.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpforge.llm._common import empty_if_null

LIMIT = 1024
#: Characters of texts that are counted together; a longer text is counted alone.
SLICE_CHARS = 4_000_000
#: Units whose counts a task keeps at most, and the longest that it keeps; all others are counted again when they recur.
KNOWN_UNITS, KNOWN_CHARS = 1_000_000, 64
_UNITS_AT_ONCE = 1 << 16
_NONE = np.int32(np.iinfo(np.int32).max)

#: The characters with Unicode's property White_Space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How the splitter cuts a text of ASCII characters only.
_ASCII_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
#: The byte alphabet's characters for the bytes that aren't printed as they are in ASCII.
_BYTE_CHARACTER = np.arange(1 << 10)
_BYTE_CHARACTER[:33] += 256
_BYTE_CHARACTER[127] = 289
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Where a very long unit may be cut: pre-tokens hold letters, digits or signs, and none goes on from a letter or digit to a sign.
_LETTERS = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_SEAM = re.compile(rf"(?<=[{_LETTERS}0-9])(?=[!-/:-@\[-`{{-~\u3001\u3002])|(?<=[{_LETTERS}])(?=[0-9])|(?<=[0-9])(?=[{_LETTERS}])")
_LONG_UNIT = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """Merges sorted by pair, symbols of the byte alphabet, byte pairs that some token holds, and strings that are one token each."""

    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    symbol_of: np.ndarray
    together: np.ndarray
    whole: tuple[str, ...]

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols, or _NONE, and the symbol that it becomes."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = self.pairs[at] == key
        return np.where(known, self.ranks[at], _NONE), self.merged[at]


def load_vocabulary(path: str) -> Vocabulary:
    """A tokenizer file of the byte-level BPE kind; other kinds, and options that this operator doesn't know, are refused."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, split = told["model"], told["pre_tokenizer"] or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or told["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError(f"{path} has options of its model that are not known here")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take their surroundings")
    ids = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right, merged = (np.array([ids[x] for x in column], np.int64) for column in ([m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
    made = np.full(max(ids.values()) + 1, -1, np.int64)
    made[merged] = np.arange(len(merges))
    if len(np.unique(merged)) < len(merges) or (np.maximum(made[left], made[right]) >= np.arange(len(merges))).any():
        raise ValueError(f"{path} merges symbols before they are made")
    symbol_of = np.full(1 << 10, -1, np.int32)  # by code point: the byte alphabet lies below 1,024
    together = np.zeros((1 << 10, 1 << 10), bool)
    for token, i in ids.items():
        if len(token) == 1:
            symbol_of[ord(token)] = i
    for token in (m[0] + m[1] for m in merges):
        points = np.frombuffer(token.encode("utf-32-le"), np.uint32)
        together[points[:-1], points[1:]] = True
    order = np.argsort((left << 32) | right)
    whole = tuple(sorted((t["content"] for t in told["added_tokens"]), key=lambda t: (-len(t), t)))
    return Vocabulary(((left << 32) | right)[order], order.astype(np.int32), merged[order].astype(np.int32), symbol_of, together, whole)


def merge_all(symbols: np.ndarray, owner: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """How many symbols survive of each sequence; owner numbers the sequences 0, 1, ... in order, each with at least one symbol."""
    survivors = np.zeros(owner[-1] + 1 if len(owner) else 0, np.int64)
    ranks, merged = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int32)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    ranks[inner], merged[inner] = vocabulary.looked_up(symbols[inner], symbols[inner + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(ranks, starts)
        done = lowest == _NONE
        if done.any():
            survivors[owner[starts[done]]] = sizes[done]
            stays = np.repeat(~done, sizes)
            symbols, owner, ranks, merged = symbols[stays], owner[stays], ranks[stays], merged[stays]
            lowest, sizes = lowest[~done], sizes[~done]
            if not len(symbols):
                break
        hits = np.flatnonzero(ranks == np.repeat(lowest, sizes))
        # Pairs overlap only where a symbol is paired with itself: of such a row of pairs every second is merged.
        first = np.r_[True, np.diff(hits) > 1]
        run = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
        symbols[hits] = merged[hits]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        symbols, owner, ranks, merged = symbols[keep], owner[keep], ranks[keep], merged[keep]
        at = hits - np.arange(len(hits))
        ranks[at] = _NONE
        ranks[at[at > 0] - 1] = _NONE
        changed = np.zeros(len(symbols) + 1, bool)
        changed[at] = changed[at - 1] = True  # of what stands before the first symbol the last place takes the mark
        touched = np.flatnonzero(changed[: len(symbols) - 1])
        touched = touched[owner[touched] == owner[touched + 1]]
        ranks[touched], merged[touched] = vocabulary.looked_up(symbols[touched], symbols[touched + 1])
    return survivors


def _pieces(unit: str) -> Iterator[str]:
    """unit itself, or a very long one cut at seams, so that its pre-tokens aren't all listed at once."""
    begun = 0
    while len(unit) - begun > _LONG_UNIT:
        seam = _SEAM.search(unit, begun + _LONG_UNIT)
        if not seam:
            break
        yield unit[begun : seam.start()]
        begun = seam.start()
    yield unit[begun:]


class Counting:
    """Counts tokens; remembers the counts of short units."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers.pre_tokenizers import ByteLevel  # here, where the work is done: its Unicode tables are those that count

        self.vocabulary, self.known = vocabulary, {}
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.whole = re.compile("|".join(map(re.escape, vocabulary.whole))) if vocabulary.whole else None

    def units(self, text: str) -> tuple[Counter, int]:
        """The units of a text, and how many strings of it are one token each."""
        units, ends = Counter(), self.whole.split(text) if self.whole else [text]
        for part in ends:
            if len(part) <= SLICE_CHARS:
                units.update(_UNIT.findall(part))
            else:
                for some in batched((m[0] for m in _UNIT.finditer(part)), _UNITS_AT_ONCE):
                    units.update(some)
        return units, len(ends) - 1

    def learn(self, units: list[str]) -> list[int]:
        """Counts of units; pre-tokens of many units are merged together, as many as SLICE_CHARS characters hold."""
        counts, texts, owners, held = np.zeros(len(units), np.int64), [], [], 0
        for k, unit in enumerate(units):
            for piece in _pieces(unit) if len(unit) > _LONG_UNIT else (unit,):
                told = _ASCII_SPLIT(piece) if piece.isascii() else [t for t, _ in self.split(piece)]
                texts += told
                owners += [k] * len(told)
                held += len(piece)
                if held >= SLICE_CHARS:
                    self._merge(texts, owners, counts)
                    texts, owners, held = [], [], 0
        if texts:
            self._merge(texts, owners, counts)
        return counts.tolist()

    def _merge(self, texts: list[str], owners: list[int], counts: np.ndarray) -> None:
        """Adds the tokens of pre-tokens to the counts of their owners."""
        flat = _BYTE_CHARACTER[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        sequence = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        begins = np.r_[True, (sequence[1:] != sequence[:-1]) | ~self.vocabulary.together[flat[:-1], flat[1:]]]
        alive = merge_all(self.vocabulary.symbol_of[flat], np.cumsum(begins) - 1, self.vocabulary)
        np.add.at(counts, np.array(owners)[sequence[begins]], alive)

    def count(self, texts: list[str]) -> list[int]:
        told = [self.units(t) for t in texts]
        if len(self.known) > KNOWN_UNITS:
            self.known = {}
        new = list(set().union(*(units for units, _ in told)).difference(self.known))
        self.known.update(zip(new, self.learn(new), strict=True))
        counts = [n + sum(map(mul, units.values(), map(self.known.__getitem__, units))) for units, n in told]
        for u in new:
            if len(u) > KNOWN_CHARS:
                del self.known[u]
        return counts


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """From and to of consecutive rows with SLICE_CHARS characters at most, or of one row."""
    begun, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > SLICE_CHARS:
            yield begun, k
            begun, held = k, 0
        held += n
    if sizes:
        yield begun, len(sizes)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary | str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit): one row per input row, ids of any type.

    vocabulary is the file of a byte-level BPE, read on the driver (some megabytes at any input size), or what
    `load_vocabulary` gave. Counts are those of the whole text without tokens added at its ends; strings that the file
    lists as tokens of their own count one each. Null text counts as empty: no bytes, no tokens. A text is held in memory
    once, its distinct units beside it, however long it is. Repeated rows and rows without an id are counted like others;
    further columns are neither read nor returned; an empty table gives an empty result.
    """
    words = load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(empty_if_null(F.col(text_col))).cast("long").alias("n_bytes"), empty_if_null(F.col(text_col)).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(words)
        for batch in batches:
            sizes = batch.column("n_bytes").to_pylist()
            for a, b in _slices(sizes):
                n = counting.count(batch.column("text").slice(a, b - a).to_pylist())
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("n_bytes").slice(a, b - a), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
