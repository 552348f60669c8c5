"""Words a session-batch interacted with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import event_words, words
from ..settings import KEYS, MAX_WORDS


def distinct_words(rows: DataFrame) -> DataFrame:
    """Distinct (batch, session, word). Shuffled by all three, so a hot session spreads out."""
    return _one_per_word(rows, words_of_event()).select(*KEYS, "word").distinct()


def words_of_event() -> Column:
    """The words of an event that can be among the first ones of its session-batch; null for none.

    The smallest 15 of a union are among the smallest 15 of its parts.
    """
    found = event_words(F.col("type"), F.col("el_text"), F.col("tgt_text"))
    return F.slice(F.sort_array(found), 1, MAX_WORDS)


def first_words(rows: DataFrame) -> DataFrame:
    """The 15 smallest distinct words per session-batch, in code-point order.

    The rank limit is applied before the shuffle as well (window group limit), so at most 15
    rows per session-batch and map task travel and at most 15 are gathered.
    """
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("word"))
    kept = distinct_words(rows).withColumn("rank", rank).where(F.col("rank") <= MAX_WORDS)
    return kept.groupBy(*KEYS).agg(F.sort_array(F.collect_list("word")).alias("words"))


def text_words(texts: DataFrame, text: str) -> DataFrame:
    """Every word of every text, one row per occurrence."""
    return _one_per_word(texts, words(F.col(text))).drop(text)


def _one_per_word(rows: DataFrame, found: Column) -> DataFrame:
    """For a plain explode the optimizer adds a size filter that splits each text once more."""
    return rows.withColumn("word", F.explode_outer(found)).where(F.col("word").isNotNull())
