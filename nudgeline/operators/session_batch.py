"""All events of a session in one batch, reduced to one row.

Every number is a sum, count, minimum, maximum or bit-or with a fixed-width buffer, so Spark
combines it before the shuffle: a session that holds a third of the rows reaches the reducer
as one row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import feedback, labels
from ..functions.hashing import ID_PREFIX, bucket_set, injection_id
from ..settings import (
    KEYS,
    MAX_WORDS,
    READ_MILLIS,
    READ_TYPES,
    SCROLL,
    SWIPE,
    SWIPES_PER_STEP,
    Policy,
)
from . import choice, pair_scan
from .tokens import words_of_event

KEY_LIST = list(KEYS)


def with_codes(rows: DataFrame) -> DataFrame:
    """Adds the small user-agent and URL codes that the label scan runs over."""
    return rows.withColumn("ua", labels.user_agent_code(F.col("user_agent"))).withColumn(
        "link", labels.url_code(F.col("url"))
    )


def points() -> Column:
    return feedback.event_points(
        F.col("type"), F.col("tgt_text"), F.col("el_text"), F.col("scroll_depth")
    )


def touched_id(n_suggestions: int) -> Column:
    """Bit n is set when the event touches the session's n-th suggestion.

    A session gets at most one suggestion per arm and their ids are known in advance, so a hit
    needs neither a join nor a list of all ids that were touched.
    """

    def bit(n):
        wanted = injection_id(F.col("session_id"), F.lit(n))
        hit = (F.col("tgt_id") == wanted) | (F.col("el_id") == wanted)
        return F.when(hit, F.lit(1 << n)).otherwise(F.lit(0))

    marked = F.col("tgt_id").startswith(ID_PREFIX) | F.col("el_id").startswith(ID_PREFIX)
    bits = reduce(lambda a, b: a.bitwiseOR(b), [bit(n) for n in range(n_suggestions)])
    return F.when(marked, bits).otherwise(F.lit(0))


def with_feedback(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds what each event says for the feedback."""
    return rows.withColumns(
        {
            "points": points(),
            "stamp": F.when(F.col("ts_ms") > 0, F.col("ts_ms")),
            "unstamped": F.col("is_event") & F.col("ts_ms").isNull(),
            "exits": feedback.is_exit(F.col("type")),
            "touched": touched_id(len(policy.arms)),
        }
    )


def feedback_aggregates() -> list[Column]:
    return [
        F.count_if("is_item").alias("n_items"),
        F.coalesce(F.bool_or("unstamped"), F.lit(False)).alias("lacks_timestamp"),
        F.sum("points").alias("score"),
        F.min("stamp").alias("first_ms"),
        F.max("stamp").alias("last_ms"),
        F.bool_or("exits").alias("has_exit"),
        F.bit_or("touched").alias("hit_mask"),
    ]


def with_activity(rows: DataFrame) -> DataFrame:
    """Adds what each event says for the activity counts."""
    kind = F.col("type")
    long_read = kind.isin(*READ_TYPES) & (F.col("duration") > READ_MILLIS)
    return rows.withColumns({"swiped": kind == SWIPE, "long_read": long_read})


def activity_aggregates() -> list[Column]:
    return [F.count_if("swiped").alias("swipes"), F.count_if("long_read").alias("reads")]


def collect_session_batches(rows: DataFrame) -> DataFrame:
    """Extent of each session-batch and the last component it reported as shown."""
    shown = F.when(F.col("shown_component").isNotNull(), F.col("ord"))
    return rows.groupBy(*KEYS).agg(
        F.count_if("is_item").alias("n_events"),
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.max_by("shown_component", shown).alias("shown_component"),
    )


def behaviour_counts(rows: DataFrame) -> DataFrame:
    """Swipes, long reads and the deepest scroll; the last is reported only."""
    depth = F.when(F.col("type") == SCROLL, F.col("scroll_depth"))
    deepest = F.greatest(F.lit(0.0), F.max(depth)).alias("max_scroll")
    return with_activity(rows).groupBy(*KEYS).agg(*activity_aggregates(), deepest)


def engagement(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Score, velocity and feedback flags of each session-batch."""
    told = with_feedback(rows, policy).groupBy(*KEYS).agg(*feedback_aggregates())
    return told.withColumn("velocity", _velocity())


def _velocity() -> Column:
    return feedback.velocity(F.col("score"), F.col("first_ms"), F.col("last_ms"))


def context_labels(rows: DataFrame) -> DataFrame:
    """Device, source and intent of each session-batch."""
    codes = pair_scan.scan(with_codes(rows), "ua", "link", KEYS, n_codes=labels.N_CODES)
    return codes.select(*KEYS, *_labels(F.col("ua"), F.col("link")))


def _labels(ua: Column, link: Column) -> list[Column]:
    return [
        labels.device(ua).alias("device"),
        labels.source(ua, link).alias("source"),
        labels.intent(link).alias("intent"),
    ]


def feature_strings(words: Column) -> Column:
    """The named features: three labels, one activity count, up to 15 words."""

    def named(name, value):
        return F.concat(F.lit(name + "="), value.cast("string"))

    steps = F.floor(F.col("swipes") / SWIPES_PER_STEP)
    activity = F.when(F.col("device") == "mobile", named("swipes", steps)).otherwise(
        named("reads", F.col("reads"))
    )
    fixed = F.array(
        named("dev", F.col("device")),
        named("src", F.col("source")),
        named("intent", F.col("intent")),
        activity,
    )
    return F.concat(fixed, F.transform(words, lambda w: F.concat(F.lit("word="), w)))


_WORD = "word"


def _told(rows: DataFrame, policy: Policy) -> DataFrame:
    """Aggregates and first words of every session-batch, from one reading of the events.

    Each event is a row without a word and one row per word; both go through one aggregate by session-
    batch and word, combined before the shuffle. Its rows without a word are the aggregates of the
    events, the others say which words there are. Of those at most 15 per task go on to the session-
    batch's partition.
    """
    told = with_activity(with_feedback(rows, policy)).withColumn(
        "shown_bit", choice.shown_bit(policy)
    )
    own = F.array(F.lit(None).cast("string"))
    words = F.coalesce(words_of_event(), F.array().cast("array<string>"))
    needed = (
        *KEYS, "ord", "ua", "link", "is_item", "points", "stamp", "unstamped", "exits", "touched",
        "swiped", "long_read", "shown_bit",
    )
    tagged = told.select(*needed, F.explode_outer(F.concat(own, words)).alias(_WORD))
    aggregates = [
        *feedback_aggregates(),
        *activity_aggregates(),
        F.bit_or("shown_bit").alias("shown"),
        *pair_scan.scan_aggregates("ua", "link", n_codes=labels.N_CODES),
    ]
    by_word = tagged.groupBy(*KEYS, _WORD).agg(*aggregates)
    # Null comes first: the row of the events themselves.
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col(_WORD).asc_nulls_first()))
    kept = by_word.withColumn("rank", rank).where(F.col("rank") <= MAX_WORDS + 1)
    names = [c for c in by_word.columns if c not in (*KEYS, _WORD)]
    events = F.when(F.col(_WORD).isNull(), F.struct(*names))
    return kept.groupBy(*KEYS).agg(
        F.first(events, ignorenulls=True).alias("told"),
        F.sort_array(F.collect_list(_WORD)).alias("words"),
    )


def summarize(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Everything the decision needs to know about a session-batch, in one row.

    The events are read once for aggregates and words. The few session-batches whose labels these leave
    undecided are looked up in a second, narrow reading (``pair_scan.late_values``).
    """
    coded = pair_scan.keyed(with_codes(rows), KEYS)
    told = _told(coded, policy)
    # Asking for the words as well keeps both uses alike, so that the engine works them out once.
    undecided = told.where(F.size("words") >= 0).select(*KEYS, "told.*")
    late = pair_scan.late_values(coded, undecided, "ua", "link", KEYS, n_codes=labels.N_CODES)
    ua = pair_scan.resolve("ua", "link", "late_value", labels.N_CODES)
    link = pair_scan.resolve("link", "ua", "late_value", labels.N_CODES)
    return (
        told.join(late, KEY_LIST, "left")
        .select(*KEYS, "told.*", "words", "late_value")
        .withColumns({"ua_found": ua, "link_found": link})
        .withColumns(
            dict(
                zip(
                    ("device", "source", "intent"),
                    _labels(F.col("ua_found"), F.col("link_found")),
                )
            )
        )
        .withColumn("velocity", _velocity())
        .withColumn("features", feature_strings(F.col("words")))
        .select(
            *KEYS,
            "n_items",
            "lacks_timestamp",
            "velocity",
            "has_exit",
            "hit_mask",
            "shown",
            "swipes",
            "reads",
            "device",
            "source",
            "intent",
            "features",
            bucket_set(F.col("features"), policy.n_features).alias("buckets"),
        )
    )


def usable(summaries: DataFrame) -> DataFrame:
    """Session-batches that may be decided or judged; the others go to quarantine."""
    return summaries.where(~F.col("lacks_timestamp"))

