"""Language identification as a mixture: each document's language proportions by expectation maximisation.

A model per language holds smoothed letter-trigram frequencies. A word's likelihood in a language is the product of its
trigrams'; a document is a mixture whose weights EM fits to its words. Which languages it has is then chosen by
penalised likelihood: languages are taken out, the smallest share first, while the Bayesian information criterion falls.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpforge.llm._common import empty_if_null, held_out
from kelpforge.llm._grams import hashed_grams

#: Trigrams are filed under this many hash values, so a model has as many rows per language at most.
BUCKETS = 1 << 16
#: Labelled documents per language that the model is fitted on, about: a hash of the id takes this share of a language.
SAMPLE_PER_LANGUAGE = 4000
SMOOTHING = 0.2
HELD_OUT = (4, 2)
ROUNDS = 20
#: Numerals such as fractions and circled digits, which count as word characters in expressions but aren't letters.
_NUMERALS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_WORD, _LETTERS = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_NUMERALS}]+")
#: Words whose likelihoods a worker keeps; they are worked out again after that many, so memory is bounded.
_CACHED_WORDS = 400_000
_TEXTS_AT_ONCE = 100


def count_words(text: str | None) -> Counter:
    """Runs of letters in lower case and how often they stand; only words that hold a numeral take the slower expression."""
    counted = Counter(_WORD.findall((text or "").lower()))
    for word in [w for w in counted if not w.isalpha()]:
        n = counted.pop(word)
        for part in _LETTERS.findall(word):
            counted[part] += n
    return counted


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and word numbers of all letter trigrams of `<word>`, in the order of words; a word has as many as letters."""
    return hashed_grams(words, (3,), BUCKETS)


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # bucket x language

    def __post_init__(self):
        self._reset()

    def __getstate__(self):
        return {"languages": self.languages, "log_p": self.log_p}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def _reset(self) -> None:
        self._row: dict[str, int] = {}
        self._table = np.empty((1024, len(self.languages)), np.float32)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self._row]
        if len(self._row) + len(new) > _CACHED_WORDS:
            self._reset()
            new = words
        if new:
            at = len(self._row)
            self._row.update(zip(new, range(at, at + len(new)), strict=True))
            while at + len(new) > len(self._table):
                self._table = np.concatenate((self._table, np.empty_like(self._table)))
            buckets, of = word_buckets(new)
            self._table[at : at + len(new)] = np.add.reduceat(self.log_p[buckets], np.searchsorted(of, np.arange(len(new))), axis=0)
        return self._table[[self._row[w] for w in words]].astype(np.float64)

    def predict(self, text: str | None) -> tuple[str, float]:
        shares = self.mixture(text)
        if not shares:
            return "und", 0.0
        best = max(shares, key=lambda k: (shares[k], k))
        return best, shares[best]

    def mixtures(self, texts: list[str | None]) -> list[dict[str, float]]:
        """As mixture; the words of some texts are looked up together."""
        out = []
        for k in range(0, len(texts), _TEXTS_AT_ONCE):
            counted = [count_words(t) for t in texts[k : k + _TEXTS_AT_ONCE]]
            if self.languages:
                self.likelihoods(list(set().union(*counted)))
            out += [self._mixture(c) for c in counted]
        return out

    def mixture(self, text: str | None) -> dict[str, float]:
        """Chosen languages and their shares of the words, which add up to 1; empty without a letter or a language."""
        return self._mixture(count_words(text))

    def _mixture(self, counted: Counter) -> dict[str, float]:
        if not counted or not self.languages:
            return {}
        times = np.fromiter(counted.values(), np.float64, len(counted))
        ll = self.likelihoods(list(counted))
        chosen = np.arange(len(self.languages))
        weights, fit = _mix(ll, times)
        penalty = np.log(times.sum()) if times.sum() > 1 else 1.0
        while len(chosen) > 1:
            keep = np.sort(np.argsort(-weights, kind="stable")[:-1])
            fewer, fewer_fit = _mix(ll[:, chosen[keep]], times)
            if 2 * (fit - fewer_fit) > penalty:
                break
            chosen, weights, fit = chosen[keep], fewer, fewer_fit
        return {self.languages[k]: float(min(w, 1.0)) for k, w in zip(chosen, weights, strict=True)}


def _mix(ll: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights by EM and the log-likelihood that they reach."""
    top = ll.max(1)
    if ll.shape[1] == 1:
        return np.ones(1), float(times @ top)
    p, total = np.exp(ll - top[:, None]), times.sum()
    weights = np.full(ll.shape[1], 1 / ll.shape[1])
    for _ in range(ROUNDS):
        mixed = p @ weights
        after = weights * ((times / mixed) @ p) / total
        done = np.abs(after - weights).max() < 1e-4
        weights = after
        if done:
            break
    return weights, float(times @ (np.log(p @ weights + 1e-300) + top))


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts of what a task reads: as many rows as languages and buckets at most."""
    counts: dict[str, np.ndarray] = {}
    for part in parts:
        for lang, text in zip(part["lang"], part["text"], strict=True):
            into = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            words = count_words(text)
            buckets, of = word_buckets(list(words))
            into += np.bincount(buckets, weights=np.fromiter(words.values(), np.float64, len(words))[of], minlength=BUCKETS).astype(np.int64)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fitted on a bounded sample of the rows that may be learned from; the counts themselves are made on the executors.

    What comes to the driver is a row per language and bucket. Languages are the distinct labels.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), *HELD_OUT))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    whole = F.create_map(*(F.lit(x) for x in sum(sizes.items(), ()))) if sizes else None
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    taken = own.where(F.pmod(F.xxhash64("doc_id"), whole[F.col("lang")].cast("long")) < per_language).select("lang", empty_if_null(F.col("text")).alias("text"))
    counted = taken.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((BUCKETS, len(languages)))
    n[counted["bucket"].to_numpy(int), [languages.index(x) for x in counted["lang"]]] = counted["n"].to_numpy(float)
    seen = max(1, int((n.sum(1) > 0).sum()))
    return LanguageModel(languages, np.log((n + SMOOTHING) / (n.sum(0) + SMOOTHING * 4 * seen)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages: one row per input row; score is the share of lang_pred's words.

    languages maps all chosen languages to their shares. `und` with score 0 for null texts, texts without a letter, and
    where there is nothing to learn from. Repeated rows are predicted alike, rows without an id are never learned from,
    an empty table gives an empty result. Other columns are not read.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows per language

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in parts:
            mixtures = own.mixtures(list(part["text"]))
            best = [max(m, key=lambda k: (m[k], k), default="und") for m in mixtures]
            score = [m.get(b, 0.0) for m, b in zip(mixtures, best, strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": best, "score": score, "languages": mixtures})

    key = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).cast("string").alias("doc_id"), held_out(F.col(id_col), *HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    out = read.mapInPandas(predict, "doc_id string, held_out boolean, lang_pred string, score double, languages map<string,double>")
    return out.withColumn("doc_id", F.col("doc_id").cast(key))


def keep_identified(docs: DataFrame, least_score: float = 0.34, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs in which one learned language has at least least_score of the words, with their columns.

    Rows are decided by their text alone: null and empty texts and texts without a letter go, repeated rows and rows
    without an id are decided alike. Columns of docs cannot clash, for none is added; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([max(m.values(), default=0.0) >= least_score for m in model.value.mixtures(list(part))], dtype=bool)

    return docs.where(known(F.col(text_col)))
