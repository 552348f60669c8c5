"""Decoding raw messages: what is kept, dropped and set aside."""

import json

import pytest
from pyspark.sql import functions as F

from nudgeline.operators import session_batch
from nudgeline.sources import messages


def raw(spark, bodies):
    rows = [(0, i, None if b is None else bytearray(b, "utf8")) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "batch_id BIGINT, arrival BIGINT, body BINARY")


def payload(sid="s", events=(), **more):
    return {"payload": {"sessionId": sid, "events": events, **more}}


def rows(spark, *bodies):
    texts = [b if b is None or isinstance(b, str) else json.dumps(b) for b in bodies]
    return messages.behaviour(raw(spark, texts)).orderBy("ord").collect()


def test_unreadable_bodies_are_set_aside(spark):
    bodies = ["not json", None, "[]", '[{"payload": {"sessionId": "s", "events": [{', "[{}]"]
    assert rows(spark, *bodies) == []
    aside = messages.quarantine(raw(spark, [*bodies, "not json"])).collect()
    assert sorted(str(r["body"]) for r in aside) == sorted(["not json"] * 2 + ["None", bodies[3]])
    assert {r["reason"] for r in aside} == {"unreadable body"}


def test_a_bare_object_counts_as_one_payload(spark):
    assert [r["session_id"] for r in rows(spark, payload(events=[{"type": "x"}]))] == ["s"]


def test_two_payloads_in_one_message(spark):
    got = rows(spark, [payload("a", [{"type": "x"}, {"type": "y"}]), payload("b", [{"type": "z"}])])
    assert [(r["session_id"], r["type"]) for r in got] == [("a", "x"), ("a", "y"), ("b", "z")]
    assert [r["ord"] for r in got] == [0, 1, 2]


@pytest.mark.parametrize("stamp", ["12", 1.5, None])
def test_wrong_numbers_become_null(spark, stamp):
    (got,) = rows(spark, [payload(events=[{"type": "x", "timestamp": stamp, "extra": {"a": 1}}])])
    assert got["ts_ms"] is None and got["type"] == "x" and got["is_event"]


def test_session_key(spark):
    inner = {"metadata": {"sessionId": "fallback"}, "events": [{"type": "x"}]}
    got = rows(
        spark,
        [{"payload": {"sessionId": "own", **inner}}],
        [{"payload": {"sessionId": None, **inner}}],
        [{"payload": inner}],
        [{"payload": {"sessionId": "", **inner}}],
        [{"payload": {"events": [{"type": "x"}]}}],
    )
    assert [r["session_id"] for r in got] == ["own", "fallback", "fallback"]


@pytest.mark.parametrize("events", [None, []])
def test_a_payload_without_events_keeps_its_session(spark, events):
    (got,) = rows(spark, [payload(events=events)])
    assert (got["is_item"], got["is_event"]) == (False, False)


def test_null_events_and_missing_parts(spark):
    got = rows(spark, [payload(events=[None, {"type": "click", "data": None}, {"type": "click",
               "data": {"target": None, "element": {"id": "e"}}}])])
    assert [(r["is_item"], r["is_event"], r["el_id"]) for r in got] == [
        (True, False, None),
        (True, True, None),
        (True, True, "e"),
    ]


def test_arrival_order_spans_messages(spark):
    bodies = [[payload(events=[{"url": f"{m}{e}"} for e in "ab"])] for m in "xyz"]
    assert [r["url"] for r in rows(spark, *bodies)] == ["xa", "xb", "ya", "yb", "za", "zb"]


def test_order_numbers_of_any_size(spark):
    """The widest offsets, partitions and positions keep their order and stay apart."""
    places = [(0, 0), (1, 0), (1, 1), (2**35, 300), (2**63 - 1, 2**31 - 2), (2**63 - 1, 2**31 - 1)]
    body = json.dumps([payload(events=[{"type": "a"}, {"type": "b"}])])
    log = spark.createDataFrame(
        [(body, o, p) for o, p in places[::-1]], "value STRING, offset BIGINT, partition INT"
    )
    sent = messages._with_body(log).withColumn("batch_id", F.lit(0))
    got = messages.numbered_behaviour(sent).orderBy("ord").collect()
    assert len({r["ord"] for r in got}) == 2 * len(places) and None not in {r["ord"] for r in got}
    assert [r["type"] for r in got] == ["a", "b"] * len(places)
    assert [int(r["arrival"]) for r in got[::2]] == [o * 2**31 + p for o, p in places]


def test_headers_become_properties(spark):
    log = spark.createDataFrame(
        [("x", [("user", b"u1"), ("k", b"1"), ("k", b"2")]), ("y", None)],
        "value STRING, headers ARRAY<STRUCT<key: STRING, value: BINARY>>",
    )
    got = {bytes(r["body"]): r["properties"] for r in messages._with_body(log).collect()}
    assert got == {b"x": {"user": "u1", "k": "2"}, b"y": None}


def test_numbering_of_unnumbered_batches(spark):
    plain = spark.range(1000, numPartitions=4).select(F.col("id").cast("string").alias("body"))
    numbered = messages.with_arrival(plain).orderBy("arrival").collect()
    assert [int(r["body"]) for r in numbered] == list(range(1000))


def test_log_source_columns(spark):
    log = spark.createDataFrame(
        [("b", 7, 3)], "value STRING, offset BIGINT, partition INT"
    )
    got = messages._with_body(log).first()
    assert bytes(got["body"]) == b"b" and got["arrival"] == 7 * 2**31 + 3


def test_null_timestamp_reaches_quarantine(spark):
    bad = [payload("bad", [{"type": "click"}, {"type": "swipe"}])]
    good = [payload("good", [{"type": "click", "timestamp": 5}, None]), payload("empty")]
    nobody = [{"payload": {"events": [{"type": "click"}]}}]
    sent = raw(spark, [json.dumps(b) for b in (bad, bad, good, nobody)])
    aside = messages.quarantine(sent).collect()
    assert [tuple(r) for r in aside] == [(0, "bad", "event without timestamp", None)]
    kept = session_batch.usable(session_batch.summarize(messages.behaviour(sent))).collect()
    assert {r["session_id"] for r in kept} == {"good", "empty"}
