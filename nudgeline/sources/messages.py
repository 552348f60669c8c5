"""Raw messages: reading them from a stream and decoding them into behaviour rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MESSAGE

# Arrival numbers have up to 94 bits (offset and partition) and positions in a message 31, so the
# order of events is a whole decimal: wide enough for all of them, and of fixed width.
PLACES = 1 << 31
ORDER = "decimal(38,0)"


def read_message_stream(spark: SparkSession, fmt: str, options: Mapping[str, str]) -> DataFrame:
    """Any streaming source that yields a binary ``body``; nothing about it is hard-coded."""
    stream = spark.readStream.format(fmt).options(**options).load()
    return _with_body(stream)


def read_message_batch(spark: SparkSession, fmt: str, options: Mapping[str, str]) -> DataFrame:
    """The same source, read once and bounded."""
    return _with_body(spark.read.format(fmt).options(**options).load())


def _with_body(raw: DataFrame) -> DataFrame:
    """Name the columns alike: log sources call the body ``value`` and carry an offset, which
    is the arrival order of a message within its partition."""
    if "body" not in raw.columns:
        raw = raw.withColumnRenamed("value", "body")
    if "properties" not in raw.columns and "headers" in raw.columns:
        # Log sources carry properties as an array of key and bytes; the last of a key counts.
        pairs = F.transform("headers", lambda h: F.struct(h.key, h.value.cast("string")))
        newest = F.array_distinct(F.transform("headers", lambda h: h.key))
        last = F.map_from_arrays(
            newest,
            F.transform(newest, lambda k: F.element_at(F.filter(pairs, lambda p: p.key == k), -1)["col2"]),
        )
        raw = raw.withColumn("properties", last)
    if "properties" not in raw.columns:
        raw = raw.withColumn("properties", F.lit(None).cast("map<string,string>"))
    if "arrival" not in raw.columns and {"offset", "partition"} <= set(raw.columns):
        # Sessions are keyed to a partition; the partition number only parts equal offsets.
        raw = raw.withColumn("arrival", _joined(F.col("offset"), F.col("partition")))
    return raw.withColumn("body", F.col("body").cast("binary"))


def with_arrival(messages: DataFrame) -> DataFrame:
    """Number the messages of a bounded batch in reading order where the source has no number."""
    if "arrival" in messages.columns:
        return messages
    return messages.withColumn("arrival", F.monotonically_increasing_id())


def _joined(high: Column, low: Column) -> Column:
    """Two whole numbers as one that is ordered by the first, then by the second."""
    return high.cast(ORDER) * F.lit(PLACES).cast("decimal(10,0)") + low.cast("decimal(10,0)")


def decode(messages: DataFrame) -> DataFrame:
    """Adds ``body_str`` and the parsed ``wrappers``; unreadable bodies give null.

    Messages that are decoded already stay as they are.
    """
    if "wrappers" in messages.columns:
        return messages
    text = F.col("body").cast("string")
    return messages.withColumn("body_str", text).withColumn("wrappers", F.from_json(text, MESSAGE))


def payloads(messages: DataFrame) -> DataFrame:
    """One row per payload; unreadable and empty messages vanish."""
    payload = F.col("col.payload")
    parsed = decode(messages).select("batch_id", "arrival", F.posexplode_outer("wrappers"))
    # For a plain posexplode the optimizer adds a filter that parses each body two more times.
    return parsed.where(F.col("pos").isNotNull()).select(
        "batch_id",
        "arrival",
        F.col("pos").alias("payload_no"),
        session_key(payload).alias("session_id"),
        payload.shownComponent.alias("shown_component"),
        payload.events.alias("events"),
    )


def session_key(payload: Column) -> Column:
    """First non-null of the two places; an empty one counts as found."""
    return F.coalesce(payload.sessionId, payload.metadata.sessionId)


def has_key() -> Column:
    return F.col("session_id").isNotNull() & (F.col("session_id") != "")


def _items(messages: DataFrame) -> DataFrame:
    """One row per item of each message; one empty row for messages without any.

    Payloads are flattened before they are numbered, so that one running position orders all
    events of a message. A payload without events keeps one row: its session is still there.
    """
    items = F.flatten(F.transform("wrappers", _payload_items))
    return decode(messages).select(
        F.col("batch_id").cast("bigint").alias("batch_id"),
        "arrival",
        F.when(F.col("wrappers").isNull(), F.struct("body_str")).alias("unreadable"),
        F.posexplode_outer(items).alias("pos", "item"),
    )


def behaviour(messages: DataFrame) -> DataFrame:
    """Behaviour rows of raw messages, without those that have no session key."""
    return numbered_behaviour(messages).drop("arrival", "pos")


def numbered_behaviour(messages: DataFrame) -> DataFrame:
    """The same with the number of the message and the position in it."""
    event = F.col("item.event")
    return _items(messages).select(
        "batch_id",
        "arrival",
        "pos",
        F.col("item.session_id").alias("session_id"),
        _joined(F.col("arrival"), F.col("pos")).cast(ORDER).alias("ord"),
        F.col("item.is_item").alias("is_item"),
        event.isNotNull().alias("is_event"),
        event.type.alias("type"),
        event.timestamp.alias("ts_ms"),
        event.url.alias("url"),
        event.userAgent.alias("user_agent"),
        event.data.scrollDepth.alias("scroll_depth"),
        event.data.duration.alias("duration"),
        event.data.element.textContent.alias("el_text"),
        event.data.target.textContent.alias("tgt_text"),
        event.data.element.id.alias("el_id"),
        event.data.target.id.alias("tgt_id"),
        F.col("item.shown_component").alias("shown_component"),
    ).where(has_key())  # also drops the empty rows of messages without items


def quarantine(messages: DataFrame) -> DataFrame:
    """What cannot be used: each unreadable message, and each session-batch that holds an event
    without a timestamp. One pass over the messages."""
    unreadable = F.col("unreadable").isNotNull()
    untimed = F.col("item.event").isNotNull() & F.col("item.event.timestamp").isNull()
    faults = _items(messages).select(
        "batch_id",
        F.when(~unreadable, F.col("item.session_id")).alias("session_id"),
        F.when(unreadable, "unreadable body")
        .when(untimed, "event without timestamp")
        .alias("reason"),
        F.col("unreadable.body_str").alias("body"),
        F.when(unreadable, F.col("arrival")).alias("arrival"),
    )
    # Events without a session key are of no use either way. The arrival number keeps unreadable
    # messages of the same content apart.
    kept = faults.where(F.col("reason").isNotNull() & (F.col("arrival").isNotNull() | has_key()))
    return kept.distinct().drop("arrival")


def _payload_items(wrapper: Column) -> Column:
    payload = wrapper.payload
    sid, shown = session_key(payload), payload.shownComponent

    def item(event, is_item):
        return F.struct(
            sid.alias("session_id"),
            shown.alias("shown_component"),
            F.lit(is_item).alias("is_item"),
            event.alias("event"),
        )

    filled = F.transform(payload.events, lambda e: item(e, True))
    return F.when(F.size(payload.events) > 0, filled).otherwise(
        F.array(item(F.get(payload.events, F.lit(0)), False))
    )


def raw_view(messages: DataFrame) -> DataFrame:
    """Messages with a readable body, for inspection."""
    return messages.withColumn("body_str", F.col("body").cast("string")).drop("body")
