"""Session-batch features and feedback against worked examples and the plain-Python account."""

import model
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rows import event, frame

from nudgeline.functions import feedback
from nudgeline.functions.hashing import bucket
from nudgeline.functions.text import has_conversion_intent, words
from nudgeline.operators import pair_scan, session_batch, tokens
from nudgeline.settings import KEYS, Policy

SUMMARY = (
    "device source intent swipes reads features buckets velocity has_exit hit_mask n_items"
).split()


def summaries(spark, batches):
    got = session_batch.summarize(frame(spark, batches)).collect()
    return {(r["batch_id"], r["session_id"]): r.asDict() for r in got}


def test_buckets(spark):
    known = {
        "dev=desktop": 9, "dev=mobile": 99, "src=direct": 58, "src=ads": 44, "intent=browse": 79,
        "intent=checkout": 14, "reads=0": 68, "reads=1": 60, "reads=3": 78, "swipes=0": 50,
        "swipes=1": 24, "word=chat": 72, "word=body": 72, "word=button": 75, "word=wrapper": 65,
        "word=café": 39, "word=checkout": 59,
    }
    rows = spark.createDataFrame([(k,) for k in known], "f STRING")
    got = {r[0]: r[1] for r in rows.select("f", bucket(F.col("f"), 100)).collect()}
    assert got == known
    other = {r[0]: r[1] for r in rows.select("f", bucket(F.col("f"), 977)).collect()}
    assert other == {k: int(model.md5(k), 16) % 977 for k in known}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=30), min_size=1, max_size=60))
def test_words(spark, texts):
    # Spark and Python may know different Unicode versions; unassigned characters are left out.
    texts = ["".join(c for c in t if c.isprintable()) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = {r[0]: set(r[1]) for r in rows.select("i", words(F.col("t"))).collect()}
    assert got == {i: model.words(t) for i, t in enumerate(texts)}


def test_words_of_other_scripts(spark):
    texts = ["Ünïcode_9 x²³①", "Crème brûlée", "日本語テキスト", "naïve café’s", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = {r[0]: set(r[1]) for r in rows.select("i", words(F.col("t"))).collect()}
    assert got == {i: model.words(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    "text, converts",
    [("Add to cart now", True), ("Buyer guide", True), ("reapply", True), ("Chat", False),
     ("", False), (None, False), ("ADD TO  CART", False), ("CheckOut", True)],
)
def test_conversion_intent(spark, text, converts):
    row = spark.createDataFrame([(text,)], "t STRING").select(has_conversion_intent(F.col("t")))
    assert row.first()[0] is converts


WINDOWS = "Mozilla/5.0 (Windows NT 6.1; Win64; x64)"


def test_first_batch(spark):
    events = [
        event("session_start", ts_ms=5000, url="http://shop.example/", user_agent=WINDOWS,
              el_text="Body", tgt_text="Window"),
        event("scroll", ts_ms=5200, scroll_depth=0.05, el_text="Body", tgt_text="Main Wrapper"),
    ]
    got = summaries(spark, {(0, "s"): events})[0, "s"]
    assert got["features"] == ["dev=desktop", "src=direct", "intent=browse", "reads=0"]
    assert got["buckets"] == [9, 58, 68, 79]
    assert got["velocity"] == 0.025


def test_click_on_the_suggestion(spark):
    own = model.injection_id("s", 0)
    events = [
        event("click", ts_ms=9000, tgt_id=own, tgt_text="Chat Button", el_id="w", el_text="Chat"),
        event("visibility_change", ts_ms=10000),
    ]
    got = summaries(spark, {(1, "s"): events, (1, "other"): events})
    assert got[1, "s"]["buckets"] == [50, 58, 72, 75, 79, 99]
    assert got[1, "s"]["velocity"] == 2.0
    assert (got[1, "s"]["hit_mask"], got[1, "other"]["hit_mask"]) == (1, 0)


def test_ids_of_later_suggestions(spark):
    ids = [model.injection_id("s", n) for n in range(3)]
    batches = {(n, "s"): [event("hover", el_id=i)] for n, i in enumerate(ids)}
    batches[3, "s"] = [event("hover", el_id=ids[0], tgt_id=ids[2])]
    got = summaries(spark, batches)
    assert [got[n, "s"]["hit_mask"] for n in range(4)] == [1, 2, 4, 5]


def test_leaving(spark):
    got = summaries(spark, {(1, "s"): [event("window_blur")]})[1, "s"]
    assert got["buckets"] == [50, 58, 79, 99]
    assert got["velocity"] == 0.0 and got["has_exit"]


def test_no_events_and_null_events(spark):
    got = summaries(spark, {(0, "none"): [], (0, "null"): [None]})
    assert got[0, "none"]["n_items"] == 0 and got[0, "null"]["n_items"] == 1
    for row in got.values():
        assert row["buckets"] == [50, 58, 79, 99]
        assert row["velocity"] == 0.0 and not row["lacks_timestamp"]


def test_missing_timestamp_sets_a_session_batch_aside(spark):
    batches = {
        (0, "bad"): [event("click"), event("click", ts_ms=None)],
        (0, "good"): [event("click"), None],
    }
    rows = frame(spark, batches)
    kept = session_batch.usable(session_batch.summarize(rows)).collect()
    assert [r["session_id"] for r in kept] == ["good"]


def test_timestamps_not_above_zero_do_not_count(spark):
    batches = {(0, "s"): [event("click", ts_ms=t) for t in (0, -5, 3000, 7000)]}
    assert summaries(spark, batches)[0, "s"]["velocity"] == 2.0


@pytest.mark.parametrize(
    "n_items, hit, left, now, before, verdict, reward",
    [
        (1, True, True, 0.0, 9.0, "positive", 1.0),
        (1, False, True, 9.0, 0.0, "negative", -0.5),
        (1, False, False, 2.0, 0.025, "neutral", 0.5),
        (1, False, False, 0.5, 0.0, "neutral", None),
        (1, False, False, 0.0, -1.0, "neutral", 0.5),
        (0, False, False, 9.0, 0.0, None, None),
    ],
)
def test_outcome_and_reward(spark, n_items, hit, left, now, before, verdict, reward):
    row = spark.createDataFrame(
        [(n_items, hit, left, now, before)],
        "n INT, hit BOOLEAN, gone BOOLEAN, now DOUBLE, before DOUBLE",
    ).withColumn("verdict", feedback.outcome(F.col("n"), F.col("hit"), F.col("gone")))
    earned = feedback.reward(F.col("verdict"), F.col("now"), F.col("before"))
    got = row.select("verdict", earned.alias("reward"), feedback.label(earned)).first()
    assert tuple(got) == (verdict, reward, None if reward is None else int(reward > 0))


AGENTS = [None, "", "", "X (iPhone)", "Android 9", "facebookbot", "facebook Mobile", WINDOWS]
URLS = [None, "", "", "http://a/Cart", "http://a/?utm_source=x", "http://a/", "HTTP://A/b"]
TEXTS = [None, "", "Add to", " cart now", "Café menu", "Chat with us", "Buyer guide", "Pay Apply"]
TYPES = sorted(model.READS | model.CLICKS | model.EXITS) + ["scroll", "swipe", "swipe", None]
EVENTS = st.fixed_dictionaries(
    {
        "type": st.sampled_from(TYPES),
        "ts_ms": st.sampled_from([-1, 0, 1, 500, 1500, 4000, 60000]),
        "url": st.sampled_from(URLS),
        "user_agent": st.sampled_from(AGENTS),
        "scroll_depth": st.sampled_from([None, 0.0, 0.25, 1.5, -2.0]),
        "duration": st.sampled_from([None, 0, 1000, 1001, 5000]),
        "el_text": st.sampled_from(TEXTS),
        "tgt_text": st.sampled_from(TEXTS),
        "el_id": st.sampled_from([None, "e", model.injection_id("s0", 1)]),
        "tgt_id": st.sampled_from([None, "t", model.injection_id("s1", 2)]),
    }
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(EVENTS, min_size=1, max_size=12), min_size=1, max_size=25))
def test_summaries_follow_the_rules(spark, sessions):
    batches = {(n // 3, f"s{n % 3}"): events for n, events in enumerate(sessions)}
    got = summaries(spark, {k: [event(**e) for e in v] for k, v in batches.items()})
    for (batch_id, session), events in batches.items():
        want = model.summary(session, events)
        assert {n: got[batch_id, session][n] for n in SUMMARY} == want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.lists(st.tuples(st.sampled_from(AGENTS), st.sampled_from(URLS)), min_size=1, max_size=30),
        min_size=1,
        max_size=12,
    ),
    st.sampled_from([1, 32]),
)
def test_walk_over_salted_groups(spark, sessions, salts):
    """Order numbers far apart, with one join key per group and with many."""
    flat = [
        (0, f"s{n}", i * 2**48, ua or None, url or None)
        for n, pairs in enumerate(sessions)
        for i, (ua, url) in enumerate(pairs)
    ]
    rows = spark.createDataFrame(
        flat, "batch_id INT, session_id STRING, ord BIGINT, ua STRING, url STRING"
    ).select(*KEYS, "ord", F.lower("ua").alias("ua"), F.lower("url").alias("url"))
    stats = rows.groupBy(*KEYS).agg(*pair_scan.scan_aggregates("ua", "url"))
    late = pair_scan.late_values(rows, stats, "ua", "url", KEYS, salts=salts)
    got = {
        r["session_id"]: (r["a"] or "", r["b"] or "")
        for r in stats.join(late, list(KEYS), "left")
        .select(
            "session_id",
            pair_scan.resolve("ua", "url", "late_value").alias("a"),
            pair_scan.resolve("url", "ua", "late_value").alias("b"),
        )
        .collect()
    }
    for n, pairs in enumerate(sessions):
        assert got[f"s{n}"] == model.walk([{"user_agent": a, "url": b} for a, b in pairs])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.lists(
            st.tuples(*[st.sampled_from([None, None, None, 0, 1, 2, 3])] * 2),
            min_size=1,
            max_size=20,
        ),
        min_size=1,
        max_size=20,
    ),
    st.sampled_from([1, 32]),
)
def test_walk_over_codes(spark, sessions, salts):
    flat = [
        (0, f"s{n}", i, left, right)
        for n, pairs in enumerate(sessions)
        for i, (left, right) in enumerate(pairs)
    ]
    rows = spark.createDataFrame(flat, "batch_id INT, session_id STRING, ord BIGINT, a INT, b INT")
    stats = rows.groupBy(*KEYS).agg(*pair_scan.scan_aggregates("a", "b", n_codes=4))
    late = pair_scan.late_values(rows, stats, "a", "b", KEYS, salts=salts, n_codes=4)
    got = stats.join(late, list(KEYS), "left").select(
        "session_id",
        pair_scan.resolve("a", "b", "late_value", 4).alias("x"),
        pair_scan.resolve("b", "a", "late_value", 4).alias("y"),
    )
    got = {r["session_id"]: (r["x"], r["y"]) for r in got.collect()}
    for n, pairs in enumerate(sessions):
        want = [None, None]
        for pair in pairs:
            want = [w if p is None else p for w, p in zip(want, pair)]
            if None not in want:
                break
        assert got[f"s{n}"] == tuple(want)


def test_a_session_with_most_of_the_rows(spark):
    """One session holds nearly everything; user agents change until the only URL comes last."""
    hot = [event("swipe", ts_ms=i + 1, user_agent=f"agent {i % 7} x") for i in range(3000)]
    hot[-2]["user_agent"] = "Some Mobile"
    hot[-1]["user_agent"] = None
    hot[-1]["url"] = "http://a/cart"
    events = {(0, "hot"): hot, (0, "cold"): [event("click", user_agent="x")]}
    got = summaries(spark, events)
    want = model.summary("hot", hot)
    assert {n: got[0, "hot"][n] for n in SUMMARY} == want
    assert want["device"] == "mobile" and want["intent"] == "checkout"


def test_at_most_fifteen_words(spark):
    texts = [f"word{n:02d}" for n in range(40)]
    rows = frame(spark, {(0, "s"): [event("click", el_text=t) for t in reversed(texts)]})
    assert tokens.first_words(rows).first()["words"] == texts[:15]


def test_last_shown_component(spark):
    shown = [None, "chat-widget", "faq-component", None]
    rows = frame(spark, {(0, "s"): [event("x", shown_component=c) for c in shown]})
    got = session_batch.collect_session_batches(rows).first()
    assert got["shown_component"] == "faq-component" and got["n_events"] == 4


def test_policy_needs_arms():
    with pytest.raises(ValueError):
        Policy(arms=())
