"""Secret spans by regular expressions behind a trigram inverted index, in DataFrame functions only.

From each regular expression a Boolean trigram query is derived (`trigram_query`): the lower-case trigrams that every
match must hold, as alternatives of conjunctions. The index holds postings (trigram, document) for the trigrams that
some query names. Postings of a conjunction are intersected by counting, alternatives are united, and the documents
that remain are candidates: only they run the regular expression. Rules whose expression has no mandatory trigram, such
as a character class, run on every document.

Positions: Spark has no function that gives all match positions, so the text between matches is split off, and a match
begins where the lengths of all pieces and matches before it end. Lengths are code points.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforge.llm._common import ROW, empty_if_null, with_row_key

#: Alternatives of one expression beyond which a literal run is cut.
_MOST_STRINGS = 64


@dataclass(frozen=True)
class SecretRule:
    """Matches of `pattern`, leftmost and not overlapping, whose group `group` has at least `least` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three rules that the query's contract states. The bounded repeats leave the same matches as
#: dropping shorter ones afterwards, because both expressions take whole runs of their class.
ASSIGN = SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8)
ACCESS = SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16)
HEX = SecretRule("hex", r"[0-9a-f]{32,}", 0, 32)
BASE_RULES = (ASSIGN, ACCESS, HEX)
#: What the method adds: key blocks and prefixed service tokens.
ADDED_RULES = (
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("service", r"(?:ghp|gho|ghs|glpat|xoxb|xoxp)[_-][A-Za-z0-9_-]{20,}"),
)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that a match must hold; one empty set: no trigram is mandatory."""
    runs: list[set[str]] = []

    def cut(strings: set[str] | None) -> None:
        if strings:
            runs.append(strings)

    def walk(nodes: Iterable, before: set[str]) -> set[str]:
        """What the literal run that ends here may be, after it was `before`."""
        for op, arg in nodes:
            if op is sre.LITERAL:
                before = {x + chr(arg).lower() for x in before}
            elif op is sre.SUBPATTERN:
                before = walk(arg[-1], before)
            elif op is sre.BRANCH:
                before = set().union(*(walk_apart(x, before) or {""} for x in arg[1]))
            elif op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
                before = before | (walk_apart(arg[2], before) or {""})
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 4:
                before = {x + chr(c).lower() for x in before for _, c in arg}
            elif op is sre.AT:
                continue
            else:
                cut(before)
                before = {""}
            if len(before) > _MOST_STRINGS:
                cut(before)
                before = {""}
        return before

    def walk_apart(nodes: Iterable, before: set[str]) -> set[str] | None:
        """As walk, but None if the branch cut its run: what it named then isn't mandatory for the other branches."""
        kept = len(runs)
        after = walk(nodes, before)
        if len(runs) > kept:
            # An alternative that breaks the run: fall back on what all alternatives share, the part before it.
            del runs[kept:]
            cut(before)
            return None
        return after

    cut(walk(sre_parser.parse(pattern), {""}))
    grams = lambda s: frozenset(s[i : i + 3] for i in range(len(s) - 2))
    best: list[frozenset[str]] = [frozenset()]
    for strings in runs:
        alternatives = {grams(s) for s in strings}
        alternatives = {a for a in alternatives if not any(b < a for b in alternatives)}
        # Of several runs the most selective one is kept: the one whose loosest alternative names the most trigrams.
        if min(map(len, alternatives)) > min(map(len, best)):
            best = sorted(alternatives, key=sorted)
    return best


def build_postings(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """The index: a row (gram, doc_id) for each given trigram that a document's lower-case text holds."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select("doc_id", F.explode(held).alias("gram"))


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id, kinds: for which rules a document is a candidate. The query table is as long as the list of rules."""
    terms = [(kind, n, g, len(c)) for kind, clauses in queries.items() for n, c in enumerate(clauses) for g in sorted(c)]
    query = postings.sparkSession.createDataFrame(terms, "kind string, clause int, gram string, needed int")
    hits = postings.join(F.broadcast(query), "gram").groupBy("doc_id", "kind", "clause", "needed").agg(F.countDistinct("gram").alias("found"))
    return hits.where("found = needed").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


#: Matches whose starts are summed in one run; the runs' own starts are summed after that, so work grows with the matches.
_RUN = 256
_SPAN = "struct<start:int,rank:int,kind:string,stop:int>"


def _spans(text: Column, rule: SecretRule, rank: int) -> Column:
    """Structs (start, rank, kind, stop) of the rule's matches in text."""
    none = F.array().cast(f"array<{_SPAN}>")
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    told = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    lengths = lambda c, name: F.transform(c, lambda x: F.length(x).alias(name))

    def steps_of(sizes: Column) -> Column:
        gaps = F.zip_with(F.slice(lengths(pieces, "gap"), 1, F.size(sizes)), sizes, lambda g, n: F.struct(g.alias("gap"), n.alias("size")))
        return F.zip_with(gaps, lengths(told, "told") if rule.group else sizes, lambda s, t: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), t.alias("told")))

    def runs_of(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(steps) / _RUN).cast("int") - 1), lambda k: F.slice(steps, k * _RUN + 1, _RUN))

    def starts_of(runs: Column) -> Column:
        """Where each run begins."""
        sums = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda at, s: at + s["gap"] + s["size"]))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sums, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def spans_of(run: Column, begin: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            at = acc["at"] + s["gap"]
            span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (at + s["size"]).alias("stop")).cast(_SPAN)
            return F.struct((at + s["size"]).alias("at"), F.when(s["told"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(run, F.struct(begin.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    every = lambda runs: _let(starts_of(runs), lambda starts: F.flatten(F.transform(runs, lambda run, k: spans_of(run, F.get(starts, k)))))
    found = _let(lengths(whole, "size"), lambda sizes: _let(steps_of(sizes), lambda steps: _let(runs_of(steps), every)))
    return F.when(F.regexp(text, F.lit(rule.pattern)), found).otherwise(none)


def scan_secrets(
    docs: DataFrame, rules: Sequence[SecretRule] = BASE_RULES + ADDED_RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, spans (array of start, rank, kind, stop; sorted): one row per input row.

    Null text counts as empty; rows without an id are scanned like others, repeated rows give a row each, an empty table
    gives an empty result. Only id and text are read. The index narrows work, never results: candidates are verified. Rows
    meet their candidates by a key of each row's own, so that many rows of one id, or of none, are no hot key.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(F.col(text_col)).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    filtered = {k: q for k, q in queries.items() if all(q)}
    kinds = F.array().cast("array<string>")
    if filtered:
        grams = sorted({g for q in filtered.values() for c in q for g in c})
        keyed = with_row_key(read)
        found = candidates(build_postings(keyed.select(F.col(ROW).alias("doc_id"), "text"), grams), filtered)
        read = keyed.join(found.select(F.col("doc_id").alias(ROW), "kinds").hint("shuffle_hash"), ROW, "left").select("doc_id", "text", "kinds")
        kinds = F.coalesce("kinds", kinds)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
    each = []
    for rank, r in enumerate(rules):
        spans = _spans(F.col("text"), r, rank)
        each.append(F.when(F.array_contains(kinds, r.kind), spans).otherwise(none) if r.kind in filtered else spans)
    return read.select("doc_id", F.array_sort(F.flatten(F.array(*each))).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:stop by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
