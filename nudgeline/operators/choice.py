"""Choosing an arm: epsilon-greedy with replayable draws.

The same column functions serve plain columns and the inside of a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..settings import KEYS, Policy

DRAW_RANGE = 10000


def arm_name(arm_idx: Column, policy: Policy) -> Column:
    return F.get(F.array(*[F.lit(a) for a in policy.arms]), arm_idx)


def arm_index(action: Column, policy: Policy) -> Column:
    """Position of an arm, null for an unknown one."""
    place = F.array_position(F.array(*[F.lit(a) for a in policy.arms]), action)
    return F.when(place > 0, (place - 1).cast("int"))


def arm_bit(arm_idx: Column, policy: Policy) -> Column:
    """Bit of an arm in a ``seen`` mask; 0 for null."""
    bits = F.array(*[F.lit(1 << i) for i in range(len(policy.arms))])
    return F.coalesce(F.get(bits, arm_idx), F.lit(0))


def open_arms(seen: Column, policy: Policy) -> Column:
    """Arms that a session has not seen, in arm order."""
    every = F.array(*[F.lit(i) for i in range(len(policy.arms))])
    return F.filter(every, lambda i: F.getbit(seen, i) == 0)


def best_arm(candidates: Column, scores: Column) -> Column:
    """Highest score; the earliest arm on ties."""
    ranked = F.transform(
        candidates, lambda i: F.struct(F.get(scores, i).alias("s"), (-i).alias("back"))
    )
    return -F.array_max(ranked)["back"]


def draws(policy: Policy, session_id: Column, batch_id: Column) -> dict[str, Column]:
    """Whether to explore, and the number that picks the arm then."""
    limit = int(round(policy.epsilon * DRAW_RANGE))
    return {
        "explores": draw(session_id, batch_id, "u1") % DRAW_RANGE < limit,
        "pick": draw(session_id, batch_id, "u2"),
    }


def choose(scores: Column, seen: Column, explores: Column, pick: Column, policy: Policy) -> Column:
    """The chosen arm, null when every arm has been seen."""
    candidates = open_arms(seen, policy)
    n = F.size(candidates)
    explored = F.get(candidates, (pick % F.greatest(n, F.lit(1))).cast("int"))
    return F.when(n == 0, F.lit(None).cast("int")).when(explores, explored).otherwise(
        best_arm(candidates, scores)
    )


def shown_mask(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Arms that a session-batch itself reports as shown, as a bit mask."""
    return rows.groupBy(*KEYS).agg(F.bit_or(shown_bit(policy)).alias("seen"))


def shown_bit(policy: Policy) -> Column:
    return arm_bit(arm_index(F.col("shown_component"), policy), policy)


def candidate_arms(masks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row per session-batch and arm still open to it."""
    exploded = masks.select(*KEYS, F.explode(open_arms(F.col("seen"), policy)).alias("arm_idx"))
    return exploded.withColumn("action", arm_name(F.col("arm_idx"), policy))
