"""Terms in one spelling, outside of formulas and code."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stays as it is, the longer forms first: display and inline formulas, fenced and inline code.
_KEPT = re.compile(r"(\$\$.*?\$\$|\$[^$\n]+?\$|```.*?```|`[^`\n]+?`)", re.S)
_MADE = T.StructType().add("text", "string").add("changes", T.MapType(T.StringType(), T.LongType()))


def _rules(terms: dict[str, str]) -> list[tuple[re.Pattern[str], str, str]]:
    """(pattern, term, spelling), the longest term first; blanks of a term stand for any blanks or hyphens."""
    out = []
    for term in sorted(terms, key=len, reverse=True):
        body = r"[\s\-]+".join(map(re.escape, term.split(" ")))
        edged = rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])" if re.search("[ -]", term) else rf"\b{body}\b"
        out.append((re.compile(edged, re.I), term, terms[term]))
    return out


def normaliser(terms: dict[str, str]) -> Callable[[str], tuple[str, dict[str, int]]]:
    """A function that gives a text with its terms in one spelling, and how often each was replaced."""
    rules = _rules(terms)

    def run(text: str) -> tuple[str, dict[str, int]]:
        changes: dict[str, int] = {}
        parts = _KEPT.split(text)
        # what is kept stands at odd places; a mark holds its place, so that a term doesn't reach over it
        body = "\0".join(parts[::2])
        for pattern, term, spelling in rules:
            body, n = pattern.subn(lambda _, s=spelling: s, body)
            if n:
                changes[term] = n
        open_ = body.split("\0")
        return "".join(x for pair in zip(open_, [*parts[1::2], ""]) for x in pair), changes

    return run


def normalise_terms(c: Column, terms: dict[str, str]) -> Column:
    """Struct (text, changes): the text with its terms in one spelling, and a map of the number of replacements by term; nulls for null."""
    run = normaliser(terms)

    @F.pandas_udf(_MADE)
    def made(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else run(t.replace("\0", "")) for t in s]
        return pd.DataFrame(rows, columns=["text", "changes"])

    return made(c)


def term_counts(df: DataFrame, c: Column, terms: dict[str, str]) -> DataFrame:
    """(term, n): how often each term would be replaced, over all rows."""
    return df.select(F.explode(normalise_terms(c, terms)["changes"]).alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n"))
