"""The session state machine as a bounded replay.

A session without an open suggestion gets one, as long as an arm is left; a session with an open
suggestion is judged. Both never happen in the same batch.

When a session is decided and judged does not depend on which arm it gets. So the few batches that
matter, at most two per arm, are marked first (``operators.course``); with fixed models only those are
scored, and the arms follow from the scores. That takes one shuffle by session, of rows that are
already one per session and batch; Python is met by the scorer alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import injection_id
from ..models.scoring import list_scorer
from ..models.weights import ArmModel
from ..operators import choice, course
from ..schemas import STEP_LOG
from ..settings import Policy

NONE_OPEN = -1

_PICK = "STRUCT<arm_idx: INT, score: DOUBLE, is_exploring: BOOLEAN, seen: INT>"
_PICKS = f"STRUCT<seen: INT, picks: ARRAY<{_PICK}>>"


def chosen_arm(batch, state, policy: Policy) -> Column:
    """The arm to suggest; null while a suggestion is open and when no arm is left."""
    arm = choice.choose(batch.scores, state.seen, batch.explores, batch.pick, policy)
    return F.when(state.open_arm == NONE_OPEN, arm)


def earned_reward(state) -> Column:
    """The reward of the open suggestion; null without one and while it stays open."""
    earned = course.earned(state.suggestion_no, state.pre_velocity)
    return F.when(state.open_arm != NONE_OPEN, earned)


def step_fields(
    batch, state, arm: Column, reward: Column, session_id: Column, policy: Policy
) -> dict[str, Column]:
    """The step that suggests ``arm`` or, without one, judges with ``reward``."""
    suggests = arm.isNotNull()

    def either(if_suggested: Column, if_judged: Column) -> Column:
        return F.when(suggests, if_suggested).otherwise(if_judged)

    number = either(F.bit_count(state.seen), state.suggestion_no)
    learned_from = batch.buckets
    if policy.train_on_decision_vector:
        learned_from = either(batch.buckets, state.buckets)
    return {
        "batch_id": batch.batch_id,
        "kind": either(F.lit("suggest"), F.lit("judge")),
        "arm_idx": F.coalesce(arm, state.open_arm),
        "suggestion_no": number,
        "injection_id": injection_id(session_id, number),
        "score": either(F.get(batch.scores, arm), state.score),
        "is_exploring": either(batch.explores, state.is_exploring),
        "pre_velocity": either(batch.velocity, state.pre_velocity),
        "velocity": batch.velocity,
        "reward": reward,
        "device": batch.device,
        "buckets": learned_from,
        "seen": state.seen.bitwiseOR(choice.arm_bit(arm, policy)),
        "open_arm": F.coalesce(arm, F.lit(NONE_OPEN)),
    }


def _picks(decisions: Column, scores: Column, policy: Policy) -> Column:
    """The arm of each suggestion of a session, given the scores of each."""
    sid = F.col("session_id")

    def merge(so_far, at):
        scored = F.get(scores, at)
        drawn = choice.draws(policy, sid, F.get(decisions, at).batch_id)
        arm = choice.choose(scored, so_far.seen, drawn["explores"], drawn["pick"], policy)

        def add(chosen):
            seen = so_far.seen.bitwiseOR(choice.arm_bit(chosen, policy))
            pick = F.struct(
                chosen.alias("arm_idx"),
                F.get(scored, chosen).alias("score"),
                drawn["explores"].alias("is_exploring"),
                seen.alias("seen"),
            ).cast(_PICK)
            picks = F.array_append(so_far.picks, pick)
            return F.struct(seen.alias("seen"), picks.alias("picks")).cast(_PICKS)

        # Binding the arm to a one-element array evaluates it once.
        return F.get(F.transform(F.array(arm), add), F.lit(0))

    places = F.transform(decisions, lambda _, at: at)
    start = F.struct(
        F.lit(0).alias("seen"), F.array().cast(f"array<{_PICK}>").alias("picks")
    ).cast(_PICKS)
    return F.aggregate(places, start, merge, lambda end: end.picks)


def replay(summaries: DataFrame, models: list[ArmModel], policy: Policy = Policy()) -> DataFrame:
    """The step log (``schemas.STEP_LOG``) of usable session-batches under fixed models."""
    marked = course.courses(summaries, len(policy.arms)).withColumn(
        "decisions", F.filter("marks", lambda m: m.reward.isNull())
    )
    vectors = F.transform("decisions", lambda d: d.buckets)
    picked = marked.withColumn("scores", list_scorer(models, policy)(vectors)).withColumn(
        "picks", _picks(F.col("decisions"), F.col("scores"), policy)
    )
    steps = picked.select(
        "session_id", "decisions", "picks", F.explode("marks").alias("mark")
    ).select(
        "session_id",
        "mark.*",
        F.get("picks", F.col("mark.suggestion_no")).alias("pick"),
        F.get("decisions", F.col("mark.suggestion_no")).buckets.alias("decided_on"),
    )
    suggests = F.col("reward").isNull()
    arm = F.col("pick.arm_idx")
    learned_from = F.col("decided_on" if policy.train_on_decision_vector else "buckets")
    fields = {
        **{name: F.col(name) for name in [c.split(" ")[0] for c in STEP_LOG.split(", ")]},
        "kind": F.when(suggests, "suggest").otherwise("judge"),
        "arm_idx": arm,
        "injection_id": injection_id(F.col("session_id"), F.col("suggestion_no")),
        "score": F.col("pick.score"),
        "is_exploring": F.col("pick.is_exploring"),
        "buckets": learned_from,
        "seen": F.col("pick.seen"),
        "open_arm": F.when(suggests, arm).otherwise(F.lit(NONE_OPEN)),
    }
    return steps.select(*[value.alias(name) for name, value in fields.items()])
