"""Document quality by supervised subword embeddings.

A document is the average of learned vectors, filed by hash, of its tokens and of their character n-grams; a softmax
over that average gives the classes. Tokens are what stands between white space, with case and signs; a token that
repeats the one before it also counts as a repetition mark. Vectors and softmax are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. With two classes a trained feature is one number, the difference
of the classes' scores, so documents are scored by adding numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpforge.llm._common import empty_if_null, held_out, settle
from kelpforge.llm._grams import hashed_grams

BUCKETS, DIM = 1 << 17, 16
GRAM_LEAST, GRAM_MOST = 2, 4
#: Labelled rows that the model is fitted on at most, by hash order of the id.
SAMPLE = 4000
#: Features that those rows have together at most: where very long texts have more, fewer rows are taken, in that order.
SAMPLE_FEATURES = 12_000_000
EPOCHS, RATE, SEED = 6, 0.5, 42
HELD_OUT = (4, 2)
_REPEATED = "\x00repeated"
_CACHED_TOKENS = 300_000
_TEXTS_AT_ONCE = 100


def buckets_of(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and token numbers: the tokens themselves, then their character n-grams; the repetition mark has none."""
    whole = np.fromiter((zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in tokens), np.int64, len(tokens))
    plain = [k for k, t in enumerate(tokens) if t != _REPEATED]
    grams, of = hashed_grams([tokens[k] for k in plain], range(GRAM_LEAST, GRAM_MOST + 1), BUCKETS)
    return np.concatenate((whole, grams)), np.concatenate((np.arange(len(tokens)), np.array(plain, np.int64)[of]))


def token_counts(text: str) -> Counter:
    tokens = text.split()
    counted = Counter(tokens)
    again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    if again:
        counted[_REPEATED] = again
    return counted


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how often a document has them."""
    counted = token_counts(text)
    buckets, of = buckets_of(list(counted))
    at, back = np.unique(buckets, return_inverse=True)
    times = np.fromiter(counted.values(), np.float64, len(counted))
    return at.astype(np.int32), np.bincount(back, weights=times[of], minlength=len(at)).astype(np.float32)


class QualityModel:
    """Score differences by bucket, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._known: dict[str, tuple[float, int]] = {}

    def _learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self._known]
        if len(self._known) + len(new) > _CACHED_TOKENS:
            self._known.clear()
            new = list(tokens)
        buckets, of = buckets_of(new)
        total = np.bincount(of, weights=self.weights[buckets], minlength=len(new))
        size = np.bincount(of, minlength=len(new))
        self._known.update(zip(new, zip(total.tolist(), size.tolist(), strict=True), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for k in range(0, len(texts), _TEXTS_AT_ONCE):
            counted = [token_counts(t or "") for t in texts[k : k + _TEXTS_AT_ONCE]]
            self._learn(set().union(*counted))
            for tokens in counted:
                total, size = 0.0, 0
                for token, n in tokens.items():
                    t, m = self._known[token]
                    total += t * n
                    size += m * n
                out.append(float(1 / (1 + np.exp(-np.clip(total / max(size, 1) + self.bias, -40, 40)))))
        return out


def gradients(part: np.ndarray, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the loss -log p(label) by vectors (those of a document's features), out and bias; part is each feature's share of the document."""
    hidden = part @ vectors
    z = out @ hidden + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    return part[:, None] * (out.T @ p)[None, :], np.outer(p, hidden), p


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> QualityModel:
    """Softmax over averaged vectors by stochastic gradient descent; one class or no rows give the share of class 1.

    Steps are preconditioned by a fixed positive diagonal: a feature of share s of a document moves by 1 / sqrt(s) of its
    gradient, so that rare features learn as well, and the bias by a tenth of its own.
    """
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return QualityModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(documents), 0
    for _ in range(epochs):
        for k in rng.permutation(len(documents)):
            at, n = documents[k]
            lr = rate * (1 - done / steps)
            done += 1
            part = n / max(n.sum(), 1)
            by_vectors, by_out, by_bias = gradients(part, vectors[at], out, bias, labels[k])
            out -= lr * by_out
            bias -= lr * 0.1 * by_bias
            vectors[at] -= lr / np.sqrt(part)[:, None] * by_vectors
    return QualityModel(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


@F.pandas_udf(T.BinaryType())
def _features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Buckets as 32-bit integers, then counts as 32-bit floats: as plain bytes they stay small on the driver."""
    for part in texts:
        yield pd.Series([b"".join(x.tobytes() for x in features(t)) for t in part])


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(packed) // 2
    return np.frombuffer(packed, np.int32, half // 4), np.frombuffer(packed, np.float32, half // 4, half)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, remainder: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label of at most `rows` labelled documents that may be learned from, in hash order of the id.

    Their ids are broadcast, which `rows` bounds. Of several labels of one id the greatest counts, of several texts of one
    id the one whose hash is least.
    """
    told = labels.select(F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("label")).where("labelled IS NOT NULL AND label IN (0, 1)")
    told = told.where(~held_out(F.col("labelled"), divisor, remainder)).groupBy("labelled").agg(F.max("label").alias("label"))
    chosen = told.orderBy(F.xxhash64("labelled"), "labelled").limit(rows)
    own = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(F.col(text_col)).alias("text"))
    found = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("least"))
    return one.select("doc_id", "least.text", "least.label")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = SAMPLE_FEATURES) -> QualityModel:
    """Fitted on the driver, which gets `sample` rows and about `most_features` features at most."""
    found = settle(labelled_sample(docs, labels, "quality", *HELD_OUT, sample).select("doc_id", _features("text").alias("f"), "label"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # of `sample` narrow rows at most
    sizes = found.select("doc_id", F.sum(F.octet_length("f") / 8).over(order).alias("so_far"), F.row_number().over(order).alias("nth"))
    kept = found.join(F.broadcast(sizes.where((F.col("so_far") <= most_features) | (F.col("nth") == 1))), "doc_id")
    rows = sorted(kept.collect(), key=lambda r: (r["doc_id"], r["f"]))
    documents = [_unpacked(bytes(r["f"])) for r in rows]
    return fit(documents, np.array([r["label"] for r in rows], int))


def score_quality(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row; score is the probability of quality 1.

    Null and empty texts are scored by the bias alone. Labels that are null or not 0 or 1 are not learned from; without
    labels of both classes every text gets the share of class 1. Repeated rows are scored alike, an empty table gives an
    empty result, rows without an id are scored and count as held out. Only id and text are read.
    """
    model = model or train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # BUCKETS numbers

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = QualityModel(*shared.value)
        for part in texts:
            yield pd.Series(own.scores(list(part)), dtype=float)

    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), *HELD_OUT).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
