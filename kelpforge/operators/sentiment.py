"""Aspect sentiment over text by lexicon tables, with negation, suppression of small groups and early warnings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforge.functions.text import words


@dataclass(frozen=True)
class Lexicon:
    positive: Sequence[str]
    negative: Sequence[str]
    negators: Sequence[str]
    aspects: Sequence[tuple[str, Sequence[str]]]  # in order of preference


#: A small lexicon for demonstrations; production lexicons are parameters.
SMALL = Lexicon(
    positive=("good", "great", "fair", "clear", "helpful", "friendly"),
    negative=("bad", "poor", "unfair", "slow", "unclear", "stressful"),
    negators=("not", "no", "never", "hardly"),
    aspects=(("pay", ("pay", "salary", "bonus")), ("lead", ("manager", "lead", "boss")), ("load", ("workload", "hours", "deadline"))),
)


def polar_words(tokens: Column, lexicon: Lexicon) -> Column:
    """Array of (aspect, polarity) of the opinion words among tokens; a negator among the three words before turns one around.

    The aspect is the first declared one with a term within six words on either side. tokens must be a plain column:
    an expression would be worked out again for each word.
    """

    def near(i: Column, first: int, last: int, terms: Sequence[str]) -> Column:
        """Whether a word at a distance of first to last is one of terms; outside the text there is none."""
        return reduce(or_, (F.get(tokens, i + k).isin(*terms) for k in range(first, last + 1)))

    def judge(t: Column, i: Column) -> Column:
        plain = F.when(t.isin(*lexicon.positive), F.lit(1.0)).when(t.isin(*lexicon.negative), F.lit(-1.0))
        aspect = F.coalesce(*(F.when(near(i, -6, 6, terms), F.lit(name)) for name, terms in lexicon.aspects), F.lit("uncategorised"))
        polarity = F.when(near(i, -3, -1, lexicon.negators), -plain).otherwise(plain)
        return F.when(plain.isNotNull(), F.struct(aspect.alias("aspect"), polarity.alias("polarity")))

    return F.filter(F.transform(tokens, judge), lambda s: s.isNotNull())


def scored_texts(responses: DataFrame, group: str, text: str, lexicon: Lexicon = SMALL) -> DataFrame:
    """grp, polar, overall: the mean polarity of a text's opinion words, 0 without any."""
    split = responses.select(F.col(group).alias("grp"), words(F.col(text)).alias("tokens"))
    polar = split.select("grp", polar_words(F.col("tokens"), lexicon).alias("polar"))
    total = F.aggregate("polar", F.lit(0.0), lambda s, p: s + p["polarity"])
    return polar.withColumn("overall", F.when(F.size("polar") > 0, total / F.size("polar")).otherwise(0.0))


def group_sentiment(responses: DataFrame, group: str, text: str, lexicon: Lexicon = SMALL, minimum: int = 5) -> DataFrame:
    """grp, respondents, overall, aspect, score, mentions; groups with fewer than `minimum` responses have only grp and suppressed."""
    if minimum < 2:
        raise ValueError("a minimum below two protects nobody")
    scored = scored_texts(responses, group, text, lexicon)
    sizes = scored.groupBy("grp").agg(F.count(F.lit(1)).alias("respondents"), F.bround(F.avg("overall"), 4).alias("overall"))
    # An outer inline: for a plain one Spark would infer a filter on the array, and work the array out a second time for it.
    each = scored.select("grp", F.inline_outer("polar")).where("aspect IS NOT NULL").groupBy("grp", "aspect").agg(F.bround(F.avg("polarity"), 4).alias("score"), F.count(F.lit(1)).alias("mentions"))
    joined = sizes.join(each, "grp", "left").withColumn("suppressed", F.col("respondents") < minimum)
    hide = lambda c: F.when(~F.col("suppressed"), F.col(c)).alias(c)
    return joined.select("grp", "suppressed", *(hide(c) for c in ("respondents", "overall", "aspect", "score", "mentions"))).distinct()


def concerns(report: DataFrame, below: float = -0.15) -> DataFrame:
    return report.where((F.col("score") < below)).orderBy("grp", "score", "aspect")


def early_warnings(previous: DataFrame, current: DataFrame, drop: float = 0.35) -> DataFrame:
    """grp, aspect, previous, current, drop where an aspect fell by at least `drop` between two reports."""
    if drop <= 0:
        raise ValueError("the drop must be positive")
    before = previous.where("score IS NOT NULL").select("grp", "aspect", F.col("score").alias("previous"))
    both = current.where("score IS NOT NULL").select("grp", "aspect", F.col("score").alias("current")).join(before, ["grp", "aspect"])
    return both.withColumn("drop", F.col("previous") - F.col("current")).where(F.col("drop") >= drop)


def extremes(report: DataFrame) -> DataFrame:
    """The groups with the lowest and the highest overall score."""
    shown = report.where("NOT suppressed")
    return shown.agg(F.min_by("grp", F.struct("overall", "grp")).alias("lowest"), F.max_by("grp", F.struct("overall", "grp")).alias("highest"))
