"""Column functions on text: words, sentences, phrase rules, token sets. None is a Python UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: ASCII white space.
SPACES = " \t\n\x0b\f\r"


def trimmed(text: Column) -> Column:
    """Without white space at both ends; looks at the ends alone, where a pattern would try every place of the text."""
    return F.trim(text, F.lit(SPACES))


def word_count(text: Column) -> Column:
    """Runs of characters that aren't white space, counted without building them."""
    return F.regexp_count(text, F.lit(r"\S+"))


def sentences(text: Column) -> Column:
    """Parts after . ! ? and white space, trimmed, without empty ones; a part that lacks an end gets a full stop."""
    # White space first, then a look behind it: most places of a text fail the first test.
    parts = F.filter(F.transform(F.split(text, r"\s(?<=[.!?]\s)\s*"), trimmed), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.rlike(r"[.!?]$"), p).otherwise(F.concat(p, F.lit("."))))


def alternation(phrases) -> str:
    return "|".join(re.escape(p) for p in phrases) or r"[^\s\S]"


def starts_with_any(text: Column, phrases) -> Column:
    return F.lower(text).rlike(rf"^(?:{alternation(phrases)})")


def contains_any(text: Column, phrases) -> Column:
    return F.lower(text).rlike(alternation(phrases))


def phrase_hits(text: Column, phrases) -> Column:
    """How many of the phrases occur."""
    low, total = F.lower(text), F.lit(0)
    for p in phrases:
        total = total + low.contains(p).cast("int")
    return total


def has_word(text: Column, words) -> Column:
    """One of the words stands between characters that are no letters, digits or underscores."""
    return F.lower(text).rlike(rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{alternation(words)})(?:$|[^\p{{L}}\p{{N}}_])")


def tokens(text: Column, pattern: str = "[a-z0-9]+", stopwords=()) -> Column:
    """Distinct matches of the pattern in the lower-cased text, longer than two, without stopwords, sorted."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))
    kept = F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*stopwords) if stopwords else F.length(t) > 2)
    return F.array_sort(F.array_distinct(kept))


def size0(array: Column) -> Column:
    return F.coalesce(F.when(array.isNotNull(), F.size(array)), F.lit(0))


def let(value: Column, use) -> Column:
    """``use`` of a column value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chain(*pairs: tuple[Column, str], otherwise: str = "") -> Column:
    """The label of the first condition that holds."""
    out = F.when(F.lit(False), F.lit(""))
    for condition, label in pairs:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def with_once(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however often and in whatever filters they are used: a generator of one row, which no rule of
    the optimiser copies into what reads it."""
    for name, value in values.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df
