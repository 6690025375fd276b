"""URL verdicts from pattern rules that are found by their rarest literal token, in DataFrame functions only.

A rule's pattern is a regular expression over host + path. Its literal tokens are those that every fitting URL must
hold as a whole: host labels, and path pieces that are closed on both sides. Token frequencies are counted over all
URLs, each rule is filed under its rarest token, and a URL runs the regular expressions of those rules only that are
filed under one of its own tokens. Rules without a literal token run on every URL.

Up to `inline_rules` rules the index is a constant map inside the projection, so the table is neither shuffled nor
joined; above that, URL tokens are joined with the index.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforge.llm._common import join_heavy, settle

INLINE_RULES = 256
_HOST, _PATH = "h:", "p:"
_RULE_TYPE = "struct<rule:string,verdict:string,weight:int,pattern:string>"


@dataclass(frozen=True)
class UrlRule:
    """host fits itself and its subdomains, path is a prefix; or a pattern with the tokens that it cannot do without."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    tokens: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.host + self.path if not self.pattern else f"~{self.pattern}"

    def regex(self) -> str:
        if self.pattern:
            return self.pattern
        quote = lambda s: "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in s)
        return (f"^(?:[^/]*\\.)?{quote(self.host)}(?=/|\\z)" if self.host else "^[^/]*") + quote(self.path)

    def literal_tokens(self) -> list[str]:
        if self.pattern:
            return list(self.tokens)
        found = [_HOST + x for x in self.host.split(".") if x]
        pieces = re.split(r"[^A-Za-z0-9]+", self.path)
        closed = pieces[1:-1] if self.path else []
        return sorted(set(found + [_PATH + x for x in closed if x]))


#: The rules that the query's contract states.
BASE_RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)

#: Verdicts of the method where no stated rule fits: hosts that name themselves spam, and advertisement servers.
PATTERN_RULES = (
    UrlRule("block", pattern=r"^(?:[^/]*\.)?spam[^./]*\.[^/]*"),
    UrlRule("block", pattern=r"^(?:[^/]*\.)?adserver\.[^/]*", tokens=(_HOST + "adserver",)),
)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z in lower case; empty for null or without ://."""
    host = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ?, # or end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit(_HOST), x))
    pieces = F.transform(F.split(path, r"[^A-Za-z0-9]+"), lambda x: F.concat(F.lit(_PATH), x))
    return F.array_distinct(F.concat(labels, pieces))


def token_counts(urls: DataFrame, rules: Sequence[UrlRule]) -> dict[str, int]:
    """For each literal token of the rules, how many rows of urls (host, path) have it. As long as the list of tokens."""
    wanted = sorted({t for r in rules for t in r.literal_tokens()})
    if not wanted:
        return {}
    have = F.array_intersect(url_tokens(F.col("host"), F.col("path")), F.array(*map(F.lit, wanted)))
    counted = urls.select(F.explode(have).alias("token")).groupBy("token").count()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in counted.collect()}


def rule_index(rules: Sequence[UrlRule], counts: dict[str, int]) -> dict[str, list[dict]]:
    """Token to rules; the rules at "" have no literal token. Stated rules weigh their length, so that the longest wins."""
    index: dict[str, list[dict]] = {}
    for r in rules:
        token = min(r.literal_tokens(), key=lambda t: (counts[t], t), default="")
        weight = -1 if r.pattern else len(r.name)
        index.setdefault(token, []).append({"rule": r.name, "verdict": r.verdict, "weight": weight, "pattern": r.regex()})
    return index


def _fits(target: Column, rule: Column) -> Column:
    return F.regexp(target, rule["pattern"])


def _ranked(rule: Column) -> Column:
    """Greatest first: the longest rule, then block before allow, then by name."""
    return F.struct(
        rule["weight"].alias("weight"), (rule["verdict"] == "block").alias("blocks"), rule["rule"].alias("rule"), rule["verdict"].alias("verdict")
    )


def _inline_verdicts(urls: DataFrame, index: dict[str, list[dict]]) -> DataFrame:
    target = F.concat("host", "path")
    table = F.from_json(F.lit(json.dumps(index)), f"map<string,array<{_RULE_TYPE}>>")
    keys = F.array_append(F.filter(url_tokens(F.col("host"), F.col("path")), lambda t: F.map_contains_key(table, t)), F.lit(""))
    candidates = F.flatten(F.transform(keys, lambda t: F.coalesce(F.try_element_at(table, t), F.from_json(F.lit("[]"), f"array<{_RULE_TYPE}>"))))
    hits = F.transform(F.filter(candidates, lambda r: _fits(target, r)), _ranked)
    return urls.withColumn("best", F.array_max(hits))


def _joined_verdicts(urls: DataFrame, index: dict[str, list[dict]], counts: dict[str, int]) -> DataFrame:
    """By a join on the token, in which frequent tokens, and rules without one, don't move the URLs.

    Verdicts are worked out once for each distinct host and path, and found again by them.
    """
    spark = urls.sparkSession
    known = settle(urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")))
    n = known.count()
    rows = [(t, [(r["rule"], r["verdict"], r["weight"], r["pattern"]) for r in found], counts.get(t, n)) for t, found in index.items()]
    table = spark.createDataFrame(rows, f"token string, rules array<{_RULE_TYPE}>, n long")
    tokens = F.array_append(url_tokens(F.col("host"), F.col("path")), F.lit(""))
    pairs = known.select("host", "path", F.explode(tokens).alias("token"))
    held = join_heavy(pairs, table, "token", "n", n + sum(counts.values())).select("host", "path", F.explode("rules").alias("told"))
    rule = F.col("told")
    hits = held.where(_fits(F.concat("host", "path"), rule)).groupBy("host", "path").agg(F.max(_ranked(rule)).alias("best"))
    best = known.join(hits, ["host", "path"], "left")
    return join_heavy(urls, best, ["host", "path"], "pages", urls.count(), sizes=known)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule] = BASE_RULES + PATTERN_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    inline_rules: int = INLINE_RULES,
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per input row.

    The longest fitting rule decides (of equal length: block, then the later name); without one, the pattern rules do,
    and else `default`. rule is null unless a stated rule decided. Null or malformed URLs have empty host and path.
    Repeated rows are judged alike, an empty table gives an empty result, other columns are not read.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    counts = token_counts(urls, rules)
    index = rule_index(rules, counts)
    judged = _inline_verdicts(urls, index) if len(rules) <= inline_rules else _joined_verdicts(urls, index, counts)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.weight") >= 0, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
