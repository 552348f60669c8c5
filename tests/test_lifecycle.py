"""The state machine: replay, learning loop, restarts and repeats."""

from dataclasses import replace

import model
import pytest
from pyspark.sql import functions as F
from rows import event, frame

from nudgeline.models import network, weights
from nudgeline.operators import course, phases, session_batch
from nudgeline.plans import learned_loop, lifecycle, outputs
from nudgeline.plans.ledger import Ledger
from nudgeline.settings import Policy
from nudgeline.sources import replay

POLICY = Policy()
TAKEN = ("batch_id", "kind", "arm_idx", "suggestion_no", "is_exploring", "reward")


def courses(steps):
    out = {}
    for r in steps.orderBy("session_id", "batch_id").collect():
        out.setdefault(r["session_id"], []).append(tuple(r[c] for c in TAKEN))
    return out


@pytest.fixture(scope="module")
def summaries(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("summaries"))
    rows = replay.read_behaviour(spark, small)
    session_batch.usable(session_batch.summarize(rows, POLICY)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_replay_follows_the_rules(spark, summaries):
    models = weights.initial_models(POLICY)
    got = courses(lifecycle.replay(summaries, models, POLICY))
    sessions = {}
    for r in summaries.collect():
        sessions.setdefault(r["session_id"], {})[r["batch_id"]] = r.asDict()

    def score(batch):
        block = network.dense([batch["buckets"]], 100)
        return [float(network.probability(m, block)[0]) for m in models]

    want = {s: model.lifecycle(s, b, score) for s, b in sessions.items()}
    assert got == {s: steps for s, steps in want.items() if steps}


def test_a_session_step_by_step(spark):
    own = [model.injection_id("s", n) for n in range(3)]
    batches = {
        (0, "s"): [event("scroll", scroll_depth=0.05)],
        (1, "s"): [event("visibility_change")],  # nothing to judge: stays open
        (2, "s"): [event("click", tgt_id=own[0]), event("window_blur")],  # hit beats exit
        (3, "s"): [event("swipe")],
        (4, "s"): [event("click", tgt_id=own[0])],  # another suggestion's id: only a spike
        (5, "s"): [],  # a session without events still gets a suggestion
        (6, "s"): [],  # and without events there is nothing to judge
        (7, "s"): [event("page_unload")],
        (8, "s"): [event("click")],  # no arm is left
    }
    table = session_batch.usable(session_batch.summarize(frame(spark, batches)))
    steps = lifecycle.replay(table, weights.initial_models(POLICY), POLICY)
    got = courses(steps)["s"]
    assert [(b, k, r) for b, k, _, _, _, r in got] == [
        (0, "suggest", None),
        (2, "judge", 1.0),
        (3, "suggest", None),
        (4, "judge", 0.5),
        (5, "suggest", None),
        (7, "judge", -0.5),
    ]
    assert sorted(a for _, k, a, *_ in got if k == "suggest") == [0, 1, 2]
    split = {r["batch_id"]: r["phase"] for r in phases.split_phases(table, steps).collect()}
    assert [b for b, p in sorted(split.items()) if p == "judge"] == [1, 2, 4, 6, 7]
    hits = phases.direct_hits(frame(spark, batches), steps).collect()
    assert [(r["batch_id"], r["n_hits"]) for r in hits] == [(2, 1)]


def test_a_session_of_many_batches(spark):
    """All that is held of it are its marks; which they are is plain to see here."""
    n = 200_000
    at = F.col("id")
    table = spark.range(n, numPartitions=3).select(
        at.alias("batch_id"),
        F.lit("s").alias("session_id"),
        F.when(at == n - 1, 9.0).otherwise(F.pmod(at * 7, F.lit(5)) / 10.0).alias("velocity"),
        (at == 70_000).alias("has_exit"),
        F.when(at == 150_000, 2).otherwise(0).alias("hit_mask"),
        F.when(at % 2 == 0, 1).otherwise(0).cast("bigint").alias("n_items"),
        F.lit("mobile").alias("device"),
        F.array(F.lit(1)).alias("buckets"),
    )
    (row,) = course.courses(table, 3).collect()
    got = [(m["batch_id"], m["suggestion_no"], m["reward"]) for m in row["marks"]]
    assert got == [(0, 0, None), (70_000, 0, -0.5), (70_001, 1, None), (150_000, 1, 1.0), (150_001, 2, None)]


def test_training_vector(spark, summaries):
    models = weights.initial_models(POLICY)
    early = replace(POLICY, train_on_decision_vector=True)
    for policy, kind in ((POLICY, "judge"), (early, "suggest")):
        steps = lifecycle.replay(summaries, models, policy)
        learned = outputs.training_examples(steps).select(
            "session_id", "arm_idx", F.col("buckets").alias("learned")
        )
        batch = steps.where(F.col("kind") == kind).select("session_id", "arm_idx", "batch_id")
        seen = learned.join(batch, ["session_id", "arm_idx"]).join(
            summaries, ["session_id", "batch_id"]
        )
        assert seen.count() == learned.count() > 0
        assert seen.where(F.col("learned") != F.col("buckets")).count() == 0


def run_loop(spark, summaries, folder, policy, stop_before=None, ledger=None):
    ledger = ledger or Ledger(spark, folder, policy)
    loop = learned_loop.LearningLoop(ledger)
    for batch_id in range(8):
        if batch_id == stop_before:
            break
        loop.run(summaries.where(F.col("batch_id") == batch_id), batch_id, float(batch_id))
    return ledger


@pytest.mark.parametrize("snapshot_every", [2, 100])
def test_loop_without_learning_equals_replay(spark, summaries, tmp_path, snapshot_every):
    policy = replace(POLICY, learning_rate=0.0, snapshot_every=snapshot_every)
    ledger = run_loop(spark, summaries, str(tmp_path), policy)
    models = weights.fresh_models(policy)
    whole = lifecycle.replay(summaries.where("batch_id < 8"), models, policy)
    columns = [c for c in whole.columns if c != "buckets"]
    assert sorted(map(str, ledger.steps().select(columns).collect())) == sorted(
        map(str, whole.select(columns).collect())
    )


def contents(ledger):
    steps = sorted(str(r) for r in ledger.steps().drop("score").collect())
    numbers = [w for m in ledger.models() for layer in m.layers for w in layer.ravel()]
    return steps, numbers


def test_restart_and_repeat(spark, summaries, tmp_path):
    """Stopped and reopened half-way, with a batch left half-done: the same log and models."""
    policy = replace(POLICY, snapshot_every=3)
    straight = run_loop(spark, summaries, str(tmp_path / "a"), policy)

    class Stopped(Exception):
        pass

    def fail(rows, batch_id):
        if batch_id == 4:
            raise Stopped

    half = Ledger(spark, str(tmp_path / "b"), policy)
    loop = learned_loop.LearningLoop(half, record=fail)
    with pytest.raises(Stopped):
        for batch_id in range(8):
            loop.run(summaries.where(F.col("batch_id") == batch_id), batch_id, 0.0)
    assert half.newest["batch_id"] == 3

    again = run_loop(spark, summaries, "", policy, ledger=Ledger(spark, str(tmp_path / "b"), policy))
    steps, numbers = contents(again)
    want_steps, want_numbers = contents(straight)
    assert steps == want_steps
    assert numbers == pytest.approx(want_numbers, abs=1e-9)

    before = contents(again)
    repeat = learned_loop.LearningLoop(again)
    assert repeat.run(summaries.where("batch_id = 7"), 7, 0.0) is False
    assert contents(again) == before


def test_learning_changes_models(spark, summaries, tmp_path):
    ledger = run_loop(spark, summaries, str(tmp_path), POLICY)
    fresh = weights.fresh_models(POLICY)
    assert ledger.newest["model_version"] is not None
    assert any(m.step > f.step for m, f in zip(ledger.models(), fresh))
    reread = Ledger(spark, str(tmp_path), POLICY).models()
    assert [m.step for m in reread] == [m.step for m in ledger.models()]


def test_models_start_over_when_arms_change(spark, summaries, tmp_path):
    run_loop(spark, summaries, str(tmp_path), POLICY, stop_before=4)
    other = replace(POLICY, arms=("x", "y", "z"))
    assert [m.step for m in Ledger(spark, str(tmp_path), other).models()] == [1, 1, 1]


def test_missing_models_start_over(spark, summaries, tmp_path):
    run_loop(spark, summaries, str(tmp_path), POLICY, stop_before=4)
    ledger = Ledger(spark, str(tmp_path), POLICY)
    ledger.newest["model_version"] = 999
    assert [m.step for m in ledger.models()] == [1, 1, 1]


def test_forgetting(spark, tmp_path):
    batches = {(0, "s"): [event("click")], (5, "s"): [event("window_blur")]}
    table = session_batch.summarize(frame(spark, batches)).cache()
    for ttl, kinds in ((None, ["suggest", "judge"]), (3, ["suggest", "suggest"])):
        policy = replace(POLICY, ttl_batches=ttl)
        ledger = run_loop(spark, table, str(tmp_path / str(ttl)), policy)
        got = ledger.steps().orderBy("batch_id").collect()
        assert [r["kind"] for r in got] == kinds
    table.unpersist()


def test_ties_go_to_the_earliest_arm(spark):
    from nudgeline.operators.choice import choose

    rows = spark.createDataFrame(
        [(0, False), (1, False), (3, False), (7, False), (2, True), (7, True)],
        "seen INT, explores BOOLEAN",
    )
    scores = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5))
    arm = choose(scores, F.col("seen"), F.col("explores"), F.lit(5), POLICY)
    assert [r[0] for r in rows.select(arm).collect()] == [0, 1, 2, None, 2, None]
