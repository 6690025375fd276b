"""Text columns: scrubbing, tokens, normalisers, number extraction."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is scrubbed. Letters and digits of any script count, and so does any white space.
_SPACE = r"\t-\r\x1C-\x20\x{85}\p{Z}"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
PHONE = rf"\+?\p{{Nd}}[\p{{Nd}}{_SPACE}().-]{{7,}}\p{{Nd}}"
SPELLED = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def scrub(text: Column) -> Column:
    """E-mail addresses, then phone numbers, become placeholders."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[email]"), PHONE, "[phone]")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z']+"), F.lit(0))


def skill_tokens(text: Column) -> Column:
    """Lower-case tokens that may hold . - + #; such signs at the end don't count."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z0-9.+#-]*"), F.lit(0))
    return F.transform(found, lambda t: F.rtrim(t, F.lit(".-+#")))


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.str.casefold()


def _sorted_json(text: str | None) -> str | None:
    """JSON with sorted keys and no blanks, characters as they are; None for what is no JSON."""
    try:
        return text and json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _json(texts: pd.Series) -> pd.Series:
    return texts.map(_sorted_json)


def normalise(value: Column, steps: str = "") -> Column:
    """value after the named steps in order, separated by blanks; no step leaves it as it is, null stays null.

    space: runs of white space become one blank, none at the ends. case: case folding, for which Spark has no function, after
    space. json: sorted keys without blanks; what is no JSON has its white space collapsed.
    """
    for step in steps.split():
        spaced = F.btrim(F.regexp_replace(value, f"[{_SPACE}]+", " "))
        match step:
            case "space":
                value = spaced
            case "case":
                value = _folded(spaced)
            case "json":
                value = F.coalesce(_json(value), spaced)
            case _:
                raise ValueError(f"no such step: {step}")
    return value


def signals(brief: Column) -> Column:
    """Map of `key: number` lines of a lower-case brief; the last of repeated keys counts."""
    low = F.lower(brief)
    pattern = F.lit(r"([a-z_]+)\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)")
    keys, values = F.regexp_extract_all(low, pattern, F.lit(1)), F.regexp_extract_all(low, pattern, F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), F.transform(values, lambda v: v.cast("double")).alias("v"))
    last = F.aggregate(pairs, F.create_map().cast("map<string,double>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    return F.map_filter(last, lambda k, _: k != "role_requirement")


def required_years(brief: Column) -> Column:
    """Years that the role_requirement line asks for, in digits or spelled; null if none."""
    line = F.regexp_extract(F.lower(brief), r"role_requirement\s*[:=]\s*([^\n]*)", 1)
    digits = F.regexp_extract(line, r"([0-9]+(?:\.[0-9]+)?)\s*\+?\s*(?:years|yrs)", 1)
    spelled = F.regexp_extract(line, rf"\b({'|'.join(SPELLED)})\b\s*\+?\s*(?:years|yrs)", 1)
    number = F.coalesce(*(F.when(spelled == w, F.lit(float(n))) for w, n in SPELLED.items()))
    return F.when(digits != "", digits.try_cast("double")).otherwise(number)


def spreadsheet_safe(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


def years_ago(value: Column, reference_year: int) -> Column:
    """Years from a date (or ISO text) to the reference year, two decimals; null if it is no date."""
    day = F.try_to_date(F.substring(value.cast("string"), 1, 10), "yyyy-MM-dd")
    return F.bround(F.lit(float(reference_year)) - (F.year(day) + (F.month(day) - 1) / 12), 2)
