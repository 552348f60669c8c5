"""Streams: the same results as the bounded replay, across restarts."""

import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from nudgeline.models import weights
from nudgeline.operators import session_batch
from nudgeline.plans import learned_loop, lifecycle
from nudgeline.plans.ledger import Ledger
from nudgeline.settings import Policy
from nudgeline.sources import messages, replay
from nudgeline.streaming import inspect, live, loop

POLICY = Policy()
BATCHES = 5
NOW = {"availableNow": True}
OPTIONS = {"maxFilesPerTrigger": "1"}


@pytest.fixture(scope="module")
def rows(spark, small):
    return replay.read_behaviour(spark, small).where(F.col("batch_id") < BATCHES).cache()


@pytest.fixture(scope="module")
def inbox(spark, rows, tmp_path_factory):
    """One file of raw messages per batch, in arrival order."""
    folder = tmp_path_factory.mktemp("inbox")
    sent = replay.as_messages(rows).orderBy("arrival").collect()
    for batch_id in range(BATCHES):
        own = [bytes(r["body"]).decode() for r in sent if r["batch_id"] == batch_id]
        if batch_id == 1:
            own.insert(0, "not json")
        path = folder / f"{batch_id}.txt"
        path.write_text("\n".join(own))
        # Files are taken in the order of their time stamps.
        os.utime(path, (1_700_000_000 + batch_id, 1_700_000_000 + batch_id))
    return str(folder)


def stream(spark, inbox):
    return messages.read_message_stream(spark, "text", {"path": inbox, **OPTIONS})


def steps_of(table):
    dropped = {"buckets", "seen", "open_arm", "score"}
    columns = sorted(set(table.columns) - dropped)
    return sorted(str(r) for r in table.select(columns).collect())


def test_learning_stream_equals_replay(spark, rows, inbox, tmp_path):
    folder = str(tmp_path / "live")
    reports = []
    query = loop.start(
        stream(spark, inbox), folder, POLICY, clock=replay.batch_seconds, report=reports.append, trigger=NOW
    )
    query.awaitTermination()
    ledger = Ledger(spark, f"{folder}/ledger", POLICY)
    assert ledger.newest["batch_id"] == BATCHES - 1

    whole = learned_loop.replay_batches(
        spark, rows, str(tmp_path / "replay"), replay.batch_seconds, POLICY
    )
    assert steps_of(ledger.steps()) == steps_of(whole.steps())
    for one, other in zip(ledger.models(), whole.models()):
        for a, b in zip(one.layers, other.layers):
            assert a.ravel().tolist() == pytest.approx(b.ravel().tolist(), abs=1e-9)

    kinds = {(r["batch_id"], r["kind"]): r["count"] for r in ledger.steps().groupBy("batch_id", "kind").count().collect()}
    sessions = {r["batch_id"]: r["n"] for r in rows.groupBy("batch_id").agg(F.count_distinct("session_id").alias("n")).collect()}
    assert [(r.batch_id, r.sessions, r.suggestions, r.judgements) for r in reports] == [
        (b, sessions[b], kinds.get((b, "suggest"), 0), kinds.get((b, "judge"), 0)) for b in range(BATCHES)
    ]

    aside = spark.read.parquet(f"{folder}/quarantine").collect()
    assert [(r["batch_id"], r["body"]) for r in aside] == [(1, "not json")]
    sent = [json.loads(r["body"]) for r in spark.read.json(f"{folder}/suggestions").collect()]
    assert set(sent[0]) == {"session_id", "component", "injection_id", "timestamp"}
    made = ledger.steps().where("kind = 'suggest'").collect()
    assert {s["injection_id"] for s in sent} == {r["injection_id"] for r in made}
    judged = ledger.steps().where("kind = 'judge'").count()
    assert spark.read.parquet(f"{folder}/metrics").count() == judged > 0

    # Nothing new arrived: started again, nothing happens.
    again = loop.start(stream(spark, inbox), folder, POLICY, trigger=NOW)
    again.awaitTermination()
    assert Ledger(spark, f"{folder}/ledger", POLICY).newest == ledger.newest


def test_static_policy_over_two_streams(spark, rows, inbox, tmp_path):
    """Messages to session-batches in one stream, the state machine in the next."""
    folder = str(tmp_path)
    loop.start_summaries(stream(spark, inbox), folder, POLICY, trigger=NOW).awaitTermination()
    summaries = session_batch.usable(session_batch.summarize(rows, POLICY))
    models = weights.initial_models(POLICY)

    def run():
        live.start(
            spark,
            f"{folder}/summaries",
            summaries.schema,
            f"{folder}/steps",
            f"{folder}/state",
            models,
            POLICY,
            ttl_ms=3_600_000,
            trigger=NOW,
        ).awaitTermination()
        return spark.read.schema(live.STEPS).parquet(f"{folder}/steps")

    want = lifecycle.replay(summaries, models, POLICY).drop("buckets", "seen", "open_arm")
    assert steps_of(run()) == steps_of(want)
    # A batch written again after it was consumed changes nothing.
    first = spark.read.parquet(f"{folder}/summaries/batch_id=0")
    first.write.mode("append").parquet(f"{folder}/summaries/batch_id=0")
    assert steps_of(run()) == steps_of(want)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" not in provider


def test_handover_from_the_learning_loop(spark, rows, tmp_path):
    """The loop runs some batches; a stream under fixed models goes on from its ledger."""
    policy = replace(POLICY, learning_rate=0.0)
    summaries = session_batch.usable(session_batch.summarize(rows, policy)).cache()
    ledger = Ledger(spark, str(tmp_path / "ledger"), policy)
    runner = learned_loop.LearningLoop(ledger)
    for batch_id in range(3):
        runner.run(summaries.where(F.col("batch_id") == batch_id), batch_id, 0.0)
    live.initial_state(ledger.state(3)).write.parquet(str(tmp_path / "state"))
    summaries.where("batch_id >= 3").write.parquet(str(tmp_path / "arrived"))
    for _ in range(2):  # started again, it does not begin anew
        live.start(
            spark,
            str(tmp_path / "arrived"),
            summaries.schema,
            str(tmp_path / "steps"),
            str(tmp_path / "checkpoint"),
            ledger.models(),
            policy,
            ttl_ms=3_600_000,
            trigger=NOW,
            begin_with=str(tmp_path / "state"),
        ).awaitTermination()
    late = spark.read.schema(live.STEPS).parquet(str(tmp_path / "steps"))
    both = ledger.steps().select(late.columns).unionByName(late)
    want = lifecycle.replay(summaries, ledger.models(), policy).drop("buckets", "seen", "open_arm")
    assert steps_of(both) == steps_of(want)
    # The state store's own account of the sessions, expiry or not.
    kept = live.session_states(spark, str(tmp_path / "checkpoint"))
    touched = {r["session_id"]: r["last_batch"] for r in kept.collect()}
    newest = summaries.groupBy("session_id").agg(F.max("batch_id").alias("n")).collect()
    assert all(touched[r["session_id"]] == r["n"] for r in newest if r["n"] >= 3)
    summaries.unpersist()


def test_a_batch_without_sessions(spark, rows, tmp_path):
    summaries = session_batch.usable(session_batch.summarize(rows, POLICY))
    reports, sent = [], []
    ledger = Ledger(spark, str(tmp_path), POLICY)
    runner = learned_loop.LearningLoop(
        ledger, lambda r, b: sent.append(r), lambda r, b: sent.append(r), reports.append
    )
    assert runner.run(summaries.limit(0), 0, 0.0)
    assert sent == [None, None] and ledger.is_committed(0)
    assert reports == [learned_loop.BatchReport(0, 0, 0, 0)]


def test_inspection(spark, inbox, tmp_path):
    shown = []
    query = inspect.start(
        stream(spark, inbox),
        str(tmp_path),
        lambda batch_id, count, rows: shown.append((batch_id, count, len(rows))),
        trigger=NOW,
    )
    query.awaitTermination()
    assert [b for b, *_ in shown] == list(range(BATCHES))
    assert all(n == min(10, count) for _, count, n in shown)


def test_failing_sink_fails_the_stream_and_is_tried_again(spark, inbox, tmp_path):
    folder = str(tmp_path)

    def broken(rows, batch_id):
        raise OSError("service away")

    query = loop.start(stream(spark, inbox), folder, POLICY, send=broken, trigger=NOW)
    with pytest.raises(Exception, match="service away"):
        query.awaitTermination()
    assert Ledger(spark, f"{folder}/ledger", POLICY).newest is None
    query = loop.start(stream(spark, inbox), folder, POLICY, trigger=NOW)
    query.awaitTermination()
    assert Ledger(spark, f"{folder}/ledger", POLICY).newest["batch_id"] == BATCHES - 1
