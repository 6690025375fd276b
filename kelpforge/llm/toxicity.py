"""Toxicity of text whose words may be disguised: noisy-channel restoration, then scoring of what was restored.

1. A character trigram model is counted over the words of the whole corpus.
2. Suspicious words (letters mixed with digits or signs, letters repeated three times or more, single letters set apart)
   become lattices: a sign or digit may stand for letters, for nothing or for itself, a run of a letter for one or two
   of it, a blank or sign between letters for the end of a word or for nothing. Viterbi decoding takes the path that is
   likeliest under the character model and the channel's costs. All other words stand as they are.
3. Restored words give whole words and character n-grams, most of them tied to the word's beginning. On labelled rows
   each is counted in toxic and other documents. A decision list is learned from them: the evidence that best tells the
   toxic documents not yet explained is taken, these are then explained, and so on, so that n-grams which only happen to
   stand in toxic documents find nothing left to explain. A document's score is the posterior of its best evidence.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpforge.llm._common import empty_if_null, held_out, settle
from kelpforge.llm.quality import labelled_sample

HELD_OUT = (3, 1)
#: Labelled rows that evidence is counted on at most, by hash order of the id.
SAMPLE = 20_000
#: Pieces of evidence that the driver weighs at most, the worthiest ones, and how often toxic rows of the sample name them
#: together at most: where very long texts do more, fewer of those rows are taken, by hash order of the text.
SAMPLE_EVIDENCE, SAMPLE_PLACES = 500_000, 20_000_000
#: Documents of the sample that must have a piece of evidence; all pieces that do are weighed.
LEAST_DOCUMENTS = 2
#: A piece of evidence is worth (toxic + PRIOR_DOCUMENTS * share of toxic) / (all + PRIOR_DOCUMENTS).
PRIOR_DOCUMENTS = 3.0
LEAST_POSTERIOR = 0.3
#: How often a toxic document may be explained; the share of toxic documents, and its lower bound (three deviations), that later evidence must have.
EXPLAINED, PURE, SURE = 8, 0.95, 0.5
THRESHOLD = 0.7
#: Character classes of the trigram model; letters beyond share a class by code point.
CLASSES = 128
#: What a digit or sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Channel costs, as log probabilities: a sign read as a letter, left out, kept; a run read as two letters.
_AS_LETTER, _LEFT_OUT, _KEPT, _SINGLED, _DOUBLED = -1.0, -8.0, -10.0, -6.0, -0.5
#: The same for what stands between letters: it joins them, or ends a word; and for a sign at a token's end that is left out.
_JOINS, _ENDS, _TRAILS = -0.7, -0.2, -2.5
_EDGE = re.compile(r"^[\"'(\[{<¿]+|(?:[.,;:?\"')\]}>|]+|([^\w\s])\1*)+$")
_EDGE_FRONT = re.compile(r"^[\"'(\[{<¿]+")
_RUN = re.compile(r"(.)\1\1")
#: Signs at a token's end that punctuation doesn't explain.
_TRAILING = re.compile(r"[$@+€£|0-9]\W*$")
#: Tokens of nothing but digits and signs that stand for letters, of a word's length.
_SIGNS_ONLY = re.compile(rf"[{re.escape(''.join(LEET))}]{{3,12}}")
_WORD = re.compile(r"[^\W\d_]+")
_CACHED_WORDS = 200_000


def char_class(c: str) -> int:
    """0 for what isn't a letter, and for the letters beyond the basic plane."""
    k = ord(c)
    return 1 + (k - 97 if 97 <= k <= 122 else 26 + k % (CLASSES - 27)) if c.isalpha() and k < 1 << 16 else 0


_CLASS_OF = np.array([char_class(chr(k)) if not 0xD800 <= k < 0xE000 else 0 for k in range(1 << 16)], np.int32)


def trigram_codes(words: str) -> np.ndarray:
    """Codes of all class trigrams of a text in lower case; class 0 is the edge of a word."""
    points = np.frombuffer(f"  {words} ".encode("utf-32-le", "replace"), np.uint32)
    classes = np.where(points < 1 << 16, _CLASS_OF[np.minimum(points, (1 << 16) - 1)], 0)
    return (classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:]


class CharModel:
    """Log probability of a character class after two others, smoothed by the shorter contexts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        n = np.zeros(CLASSES**3)
        n[codes] = counts
        n = n.reshape(CLASSES, CLASSES, CLASSES)
        uni = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
        two = n.sum(0)
        bi = (two + 5 * uni) / (two.sum(1, keepdims=True) + 5)
        self.log_p = np.log((n + 5 * bi[None]) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place of a token what it may stand for, with the channel's cost; a blank in it stands for a blank or nothing."""
    places, k = [], 0
    while k < len(token):
        end = k
        while end < len(token) and token[end] == token[k]:
            end += 1
        c, run = token[k], end - k
        read = [(x, _AS_LETTER) for x in LEET.get(c, "")]
        if c.isalpha():
            options = [(c, 0.0)] if run == 1 else [(c, -0.1 if run > 2 else _SINGLED), (c + c, _DOUBLED if run > 2 else 0.0)]
        elif read:
            options = [*read, *((x + x, _AS_LETTER + _DOUBLED) for x, _ in read if run > 1), ("", _TRAILS if end == len(token) else _LEFT_OUT), (c if c.isdigit() else " ", _KEPT)]
        else:
            options = [("", _JOINS), (" ", _ENDS)]
        places.append(options)
        k = end
    return places


def decode(token: str, model: CharModel) -> str:
    """The likeliest reading of a lower-case token, by Viterbi search over the last two character classes; words in it are set apart by blanks."""
    beams: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in _lattice(token):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in beams.items():
            for piece, cost in options:
                x, y, s = a, b, score + cost
                for c in piece:
                    z = char_class(c)
                    s += model.log_p[x, y, z]
                    x, y = y, z
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, (piece, path))
        beams = after
    _, _, path = max((score + model.log_p[a, b, 0], (a, b), path or ()) for (a, b), (score, path) in beams.items())
    pieces = []
    while path:
        pieces.append(path[0])
        path = path[1]
    return "".join(reversed(pieces))


def _suspicious(token: str) -> bool:
    letters = sum(map(str.isalpha, token))
    return bool(letters) and (letters < len(token) or bool(_RUN.search(token)))


class Restorer:
    def __init__(self, model: CharModel):
        self.model = model
        self._known: dict[str, tuple[str, ...]] = {}

    def _token(self, token: str) -> tuple[str, ...]:
        """Words of one lower-case token, or of single characters set apart by blanks, as they are restored."""
        if token.isalpha() and not _RUN.search(token):
            return (token,)
        if " " in token or _SIGNS_ONLY.fullmatch(token):
            return tuple(_WORD.findall(decode(token, self.model)))
        core = _EDGE.sub("", token)
        found = [core] if core.isalpha() and not _RUN.search(core) else _WORD.findall(decode(core, self.model)) if _suspicious(core) else _WORD.findall(core)
        if _TRAILING.search(token) and not core.endswith(token[-1]):
            found += _WORD.findall(decode(_EDGE_FRONT.sub("", token), self.model))
        return tuple(filter(None, found))

    def words(self, text: str | None) -> set[str]:
        """Distinct words of the restored text, in lower case."""
        tokens = (text or "").lower().split()
        found: set[str] = set()
        for token in {*tokens, *_set_apart(tokens)}:
            told = self._known.get(token)
            if told is None:
                if len(self._known) > _CACHED_WORDS:
                    self._known.clear()
                told = self._known[token] = self._token(token)
            found.update(told)
        return found


def _set_apart(tokens: list[str]) -> Iterator[str]:
    """Runs of single characters, three letters or more among them, with the blanks between them; the last may have a sign behind it."""
    run: list[str] = []
    for token in [*tokens, "  "]:
        if len(token) == 1:
            run.append(token)
            continue
        tail = _EDGE.sub("", token)
        if run and len(tail) == 1 and len(token) == 2:
            run.append(tail)
        if len(run) > 2 and sum(c.isalnum() or c in LEET for c in run) > 2 and any(map(str.isalpha, run)):
            yield " ".join(run)
        run = []


def evidence_of(word: str) -> list[str]:
    """The whole word, its beginnings and its inner n-grams of four and five letters."""
    out = [f"<{word}>"] if len(word) > 2 else []
    out += [f"<{word[:k]}" for k in range(3, min(9, len(word)) + 1)]
    out += [word[i : i + k] for k in (4, 5) for i in range(1, len(word) - k + 1)]
    return out


def evidence_in(words: set[str]) -> set[str]:
    """What a document holds: evidence, and as evidence of its own whether two or three different words have it."""
    times = Counter(e for w in words for e in set(evidence_of(w)))
    return set(times) | {f"{e}*{k}" for e, n in times.items() for k in (2, 3) if n >= k}


def count_characters(docs: DataFrame) -> CharModel:
    """The character model of all of docs (text). A task returns CLASSES ^ 3 rows at most, and so does the sum."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES**3, np.int64)
        for part in parts:
            texts = part["text"].fillna("")
            for k in range(0, len(texts), 100):
                total += np.bincount(trigram_codes("  ".join(texts.iloc[k : k + 100]).lower()), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    found = docs.select("text").mapInPandas(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    return CharModel(found["code"].to_numpy(int), found["n"].to_numpy(float))


class ToxicityModel:
    """Posterior by evidence, and the share of toxic rows where there is none."""

    def __init__(self, posteriors: dict[str, float], base: float, characters: CharModel):
        self.posteriors, self.base, self.restorer = posteriors, base, Restorer(characters)
        self._find = ahocorasick.Automaton()
        for e in {e.split("*")[0] for e in posteriors}:
            self._find.add_word(e, e)
        self._find.make_automaton()
        self._known: dict[str, tuple[str, ...]] = {}

    def _word(self, word: str) -> tuple[str, ...]:
        told = self._known.get(word)
        if told is None:
            if len(self._known) > _CACHED_WORDS:
                self._known.clear()
            # What evidence_of(word) has of the posteriors' evidence: inner n-grams begin after the first letter.
            found = self._find.iter(f"<{word}>") if len(self._find) else ()
            told = self._known[word] = tuple({e for end, e in found if e[0] == "<" or end - len(e) + 1 > 1})
        return told

    def score(self, text: str | None) -> float:
        times = Counter(e for w in self.restorer.words(text) for e in self._word(w))
        get = self.posteriors.get
        best = max((get(f"{e}*{k}" if k > 1 else e, 0.0) for e, n in times.items() for k in range(1, min(n, 3) + 1)), default=0.0)
        return best if best else self.base * 0.5


def _count_evidence(characters) -> object:
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, counts = Restorer(characters.value), {}
        for part in parts:
            for text, label in zip(part["text"], part["label"], strict=True):
                for e in evidence_in(restorer.words(text)):
                    told = counts.get(e)
                    if told is None:
                        told = counts[e] = [0, 0]
                    told[label] += 1
                if len(counts) > 300_000:
                    yield _evidence_frame(counts)
                    counts = {}
        yield _evidence_frame(counts)

    return count


def _evidence_frame(counts: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame([(e, c[1], c[0]) for e, c in counts.items()], columns=["evidence", "toxic", "other"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """docs has doc_id and text. The character model is counted on all of docs, evidence on a bounded labelled sample.

    Evidence that LEAST_DOCUMENTS toxic rows of the sample have is weighed on the driver, which gets SAMPLE_EVIDENCE strings
    and SAMPLE_PLACES packed numbers at most, however long the texts are.
    """
    characters = count_characters(docs)
    shared = docs.sparkSession.sparkContext.broadcast(characters)  # CLASSES ^ 3 numbers
    rows = settle(labelled_sample(docs, labels, "toxic", *HELD_OUT, sample).select("text", "label").dropDuplicates())
    told = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"), *HELD_OUT))
    base = told.agg(F.sum(F.col("toxic").cast("long")), F.count(F.lit(1))).first()
    share = ((base[0] or 0) + 0.5) / (base[1] + 1)
    counted = rows.mapInPandas(_count_evidence(shared), "evidence string, toxic long, other long")
    counted = counted.groupBy("evidence").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    kept = counted.where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("worth", _worth(F.col("toxic"), F.col("other"), share)).where(F.col("worth") >= max(LEAST_POSTERIOR, 1.5 * share))
    best = kept.orderBy(F.desc("worth"), F.desc("toxic"), F.desc(F.length("evidence")), "evidence").limit(SAMPLE_EVIDENCE).collect()
    number = {r["evidence"]: k for k, r in enumerate(best)}
    places = docs.sparkSession.sparkContext.broadcast(number)
    found = settle(rows.where("label = 1").select("text").mapInPandas(_find_evidence(shared, places), "row long, found binary"))
    order = Window.orderBy("row")  # of `sample` numbers at most
    sizes = found.select("row", F.sum(F.octet_length("found") / 4).over(order).alias("so_far"), F.row_number().over(order).alias("nth"))
    held = found.join(F.broadcast(sizes.where((F.col("so_far") <= SAMPLE_PLACES) | (F.col("nth") == 1)).select("row").distinct()), "row").orderBy("row", "found").collect()
    chosen = decision_list([np.frombuffer(bytes(r["found"]), np.int32) for r in held], list(number), *(np.array([r[c] for r in best], float) for c in ("toxic", "other")), share)
    return ToxicityModel({best[k]["evidence"]: float(best[k]["worth"]) for k in chosen}, float(share), characters)


def _worth(toxic, other, share: float):
    return (toxic + PRIOR_DOCUMENTS * share) / (toxic + other + PRIOR_DOCUMENTS)


def _find_evidence(characters, places) -> object:
    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, number = Restorer(characters.value), places.value
        for part in parts:
            found = [np.array(sorted(number[e] for e in evidence_in(restorer.words(t)) if e in number), np.int32).tobytes() for t in part["text"]]
            rows = [int.from_bytes(hashlib.blake2b((t or "").encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for t in part["text"]]
            yield pd.DataFrame({"row": rows, "found": found})

    return find


def decision_list(documents: list[np.ndarray], names: list[str], toxic: np.ndarray, other: np.ndarray, share: float) -> list[int]:
    """Numbers of the evidence taken. documents: what each toxic document holds, as numbers of evidence.

    Each step takes what explains most among documents that are not explained yet. After that, documents may be
    explained EXPLAINED times, but only by evidence that is sure by itself. Evidence that holds or is held by what was
    taken is passed over, for it tells the same words.
    """
    if not documents or not names:
        return []
    of = np.concatenate([np.full(len(d), k) for k, d in enumerate(documents)])
    what = np.concatenate(documents)
    n = toxic + other
    sure = (toxic / n + 4.5 / n - 3 * np.sqrt(toxic / n * (1 - toxic / n) / n + 2.25 / n**2)) / (1 + 9 / n)
    sure = (sure >= SURE) & (toxic / n >= PURE)
    times, chosen = np.zeros(len(documents), int), []
    bare = [x.split("*")[0] for x in names]
    free = np.ones(len(names), bool)
    for limit, allowed in ((1, np.ones(len(names), bool)), (EXPLAINED, sure)):
        while True:
            left = np.bincount(what[(times < limit)[of]], minlength=len(names)).astype(float)
            worth = _worth(left, other, share)
            usable = free & allowed & (left >= LEAST_DOCUMENTS) & (worth >= max(LEAST_POSTERIOR, 1.5 * share))
            gain = np.where(usable, left * np.log(worth / share), 0)
            k = int(gain.argmax())  # the first of equals: the more particular one
            if gain[k] <= 0:
                break
            chosen.append(k)
            times[of[what == k]] += 1
            free &= np.array([bare[k] not in x and x not in bare[k] for x in bare])
    return chosen


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row; score is the probability of toxic 1.

    Texts without evidence, among them null and empty ones, get half the share of toxic labels. Labels that are null or
    not 0 or 1 are not learned from; without any, every text gets the same score. Repeated rows are scored alike, an
    empty table gives an empty result, rows without an id are scored and count as held out. Only id and text are read.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = model or train(read, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.posteriors, model.base, model.restorer.model))

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = ToxicityModel(*shared.value)
        for part in texts:
            yield pd.Series([own.score(t) for t in part], dtype=float)

    out = read.select("doc_id", held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), score(empty_if_null(F.col("text"))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
