"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import INTENT_PHRASES, READ_TYPES

# Runs of at least four letters, numbers or underscores. Java's own \w differs on accents and
# on number-like signs such as the superscript two, so the classes are spelled out.
WORD = r"[\p{L}\p{N}_]{4,}"
INTENT = "|".join(INTENT_PHRASES)


def words(text: Column) -> Column:
    """Lower-cased words longer than three characters; none for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def has_conversion_intent(text: Column) -> Column:
    """Whether any intent phrase occurs anywhere in the text, even inside a longer word."""
    return F.coalesce(F.lower(text).rlike(INTENT), F.lit(False))


def event_words(kind: Column, element_text: Column, target_text: Column) -> Column:
    """Distinct words of one event; only reading events have any."""
    both = F.array_distinct(F.concat(words(element_text), words(target_text)))
    return F.when(kind.isin(*READ_TYPES), both)
