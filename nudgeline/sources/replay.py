"""Bounded replay: the plain ``events`` table read as browser behaviour, one batch per day.

The rules that turn a generic event into behaviour are those of FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import injection_id
from ..settings import ARMS

EPOCH = "2024-01-01"
EPOCH_SECONDS = 1704067200


def batch_time(batch_id: Column) -> Column:
    """The one timestamp of a replayed batch, in seconds."""
    return (F.lit(EPOCH_SECONDS) + batch_id * 86400).cast("double")


def batch_seconds(batch_id: int) -> float:
    return float(EPOCH_SECONDS + batch_id * 86400)


def _session_id() -> Column:
    return F.concat(F.lit("session_"), F.col("user_id").cast("string"))


def read_behaviour(spark: SparkSession, folder: str) -> DataFrame:
    """Behaviour rows (``schemas.BEHAVIOUR``) of the ``events`` table in a folder."""
    return behaviour_of(spark.read.parquet(f"{folder}/events.parquet"))


def behaviour_of(events: DataFrame) -> DataFrame:
    raw = F.col("event_type")
    k = F.col("k")
    no_text = F.lit(None).cast("string")
    base = events.select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    kind = (
        F.when(raw == "view", F.when(k % 3 == 0, "swipe").otherwise("scroll"))
        .when(raw == "click", "click")
        .when(raw == "purchase", "button_click")
        .when(raw == "signup", F.when(k % 2 == 0, "hover").otherwise("touch_start"))
        .otherwise(
            F.when(k % 10 <= 1, "window_blur")
            .when(k % 10 == 2, "page_unload")
            .when(k % 10 == 3, "session_end")
            .otherwise("visibility_change")
        )
    )
    reads = raw.isin("click", "purchase", "signup")
    url = (
        F.when(F.col("event_id") % 10 == 0, "")
        .when(F.col("event_id") % 10 == 1, "https://shop.example/Cart")
        .when(F.col("event_id") % 10 == 2, "https://shop.example/?utm_source=feed")
        .otherwise(F.concat(F.lit("https://shop.example/p/"), k.cast("string")))
    )
    agent = (
        F.when(F.col("event_id") % 4 == 0, "")
        .when(F.col("user_id") % 5 == 0, "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0)")
        .when(F.col("user_id") % 5 == 1, "Mozilla/5.0 (Linux; Android 14)")
        .when(F.col("user_id") % 5 == 2, "facebookexternalhit/1.1")
        .otherwise("Mozilla/5.0 (Windows NT 10.0; Win64; x64)")
    )
    element_text = (
        F.when(k % 6 == 0, " cart now")
        .when(k % 6 == 1, "Reviews")
        .when(k % 6 == 2, no_text)
        .when(k % 6 == 3, "Chat with us")
        .when(k % 6 == 4, "Buyer guide")
        .otherwise("Café menu")
    )
    target_text = (
        F.when(k % 4 == 0, "Add to").when(k % 4 == 1, "Chat").when(k % 4 == 3, "Proceed to payment")
    )
    suggestion_no = F.floor(k / 4) % 3
    target_id = F.when(
        raw.isin("click", "purchase") & (k % 4 == 0), injection_id(_session_id(), suggestion_no)
    ).otherwise(F.concat(F.lit("tg_"), k.cast("string")))
    shown = F.when(
        k % 7 == 0, F.when(k % 3 == 0, ARMS[0]).when(k % 3 == 1, ARMS[1]).otherwise(ARMS[2])
    )
    return base.select(
        F.datediff(F.to_date("ts"), F.lit(EPOCH).cast("date")).cast("bigint").alias("batch_id"),
        _session_id().alias("session_id"),
        F.col("event_id").alias("ord"),
        F.lit(True).alias("is_item"),
        F.lit(True).alias("is_event"),
        kind.alias("type"),
        # Wall-clock difference, so the session's time zone does not matter.
        F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts").alias(
            "ts_ms"
        ),
        url.alias("url"),
        agent.alias("user_agent"),
        F.when((raw == "view") & (k % 5 != 0), k / 100.0).alias("scroll_depth"),
        F.when(reads, (k * 30).cast("bigint")).alias("duration"),
        F.when(reads, element_text).alias("el_text"),
        F.when(reads, target_text).alias("tgt_text"),
        F.concat(F.lit("el_"), k.cast("string")).alias("el_id"),
        target_id.alias("tgt_id"),
        shown.alias("shown_component"),
    )


def _event(stamp: Column) -> Column:
    element = F.struct(F.col("el_text").alias("textContent"), F.col("el_id").alias("id"))
    target = F.struct(F.col("tgt_text").alias("textContent"), F.col("tgt_id").alias("id"))
    return F.struct(
        F.col("type"),
        stamp.alias("timestamp"),
        F.col("url"),
        F.col("user_agent").alias("userAgent"),
        F.struct(
            F.col("scroll_depth").alias("scrollDepth"),
            F.col("duration"),
            element.alias("element"),
            target.alias("target"),
        ).alias("data"),
    )


def as_nested_messages(behaviour: DataFrame) -> DataFrame:
    """Behaviour rows written back as messages of several payloads and events.

    Up to eight neighbouring events of a session-batch make a message, numbered by the first. Its
    first payload has the even ones, the second the odd ones and, in every third message, a null at
    the end. Of four messages one has a third payload without a list of events, one with an empty one.
    """
    event = F.struct("ord", _event(F.col("ts_ms")).alias("event"))
    bundles = behaviour.groupBy("batch_id", "session_id", F.floor(F.col("ord") / 8).alias("bundle")).agg(
        F.min("ord").alias("arrival"), F.sort_array(F.collect_list(event)).alias("events")
    )
    number = F.col("arrival")

    def part(odd):
        own = F.filter("events", lambda e: e.ord % 2 == odd)
        return F.transform(own, lambda e: e.event)

    none = F.filter(part(0), lambda e: F.lit(False))
    missing = F.get(F.array(none), F.lit(1))
    ending = F.concat(part(1), F.array(F.get(none, F.lit(0))))

    def payload(events):
        return F.struct(F.struct(F.col("session_id").alias("sessionId"), events.alias("events")).alias("payload"))

    first = F.array(payload(part(0)), payload(F.when(number % 3 == 0, ending).otherwise(part(1))))
    extra = F.when(number % 4 == 0, F.array(payload(missing))).when(number % 4 == 1, F.array(payload(none)))
    body = F.to_json(F.concat(first, F.coalesce(extra, F.filter(first, lambda p: F.lit(False)))))
    return bundles.select("batch_id", "arrival", body.cast("binary").alias("body"))


def as_messages(behaviour: DataFrame, damaged: bool = False) -> DataFrame:
    """Behaviour rows written back as raw messages, one event each.

    ``damaged`` breaks some of them on purpose: missing or empty session ids, unreadable
    bodies and events without a timestamp.
    """
    sid = F.col("session_id")
    stamp = F.col("ts_ms")
    own, fallback = sid, sid
    if damaged:
        n = F.col("ord") % 50
        own = F.when(n == 1, "").when(~n.isin(0, 2), sid)
        fallback = F.when(n != 2, sid)
        stamp = F.when(F.col("ord") % 100 != 4, stamp)
    payload = F.struct(
        own.alias("sessionId"),
        F.col("shown_component").alias("shownComponent"),
        F.struct(fallback.alias("sessionId")).alias("metadata"),
        F.array(_event(stamp)).alias("events"),
    )
    body = F.to_json(F.array(F.struct(payload.alias("payload"))))
    if damaged:
        body = F.when(F.col("ord") % 100 == 3, "not json").otherwise(body)
    return behaviour.select(
        "batch_id",
        F.col("ord").alias("arrival"),
        body.cast("binary").alias("body"),
        F.create_map(F.lit("arrival"), F.col("ord").cast("string")).alias("properties"),
    )
