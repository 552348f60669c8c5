"""The state machine on a stream, under fixed models.

Session state lives in Spark's state store (RocksDB), survives restarts and can expire. The
input has one row per session and batch (``loop.start_summaries``), whatever a session's traffic.
A running plan cannot pick up new weights; ``loop.start`` is for learning.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.hashing import injection_id
from ..models.scoring import with_scores
from ..models.weights import ArmModel
from ..operators import choice
from ..settings import REWARD_EXIT, REWARD_HIT, REWARD_SPIKE, SPIKE_GAIN, Policy

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
STATE = (
    "seen INT, open_arm INT, suggestion_no INT, score DOUBLE, is_exploring BOOLEAN, "
    "pre_velocity DOUBLE, last_batch BIGINT"
)
_STATE_COLUMNS = [c.split(" ")[0] for c in STATE.split(", ")]
EMPTY = (0, -1, None, None, None, None, -1)
STEPS = (
    "session_id STRING, batch_id BIGINT, kind STRING, arm_idx INT, suggestion_no INT, "
    "injection_id STRING, score DOUBLE, is_exploring BOOLEAN, pre_velocity DOUBLE, "
    "velocity DOUBLE, reward DOUBLE, device STRING"
)


class SessionMachine(StatefulProcessor):
    """Suggests or judges, one session-batch after the other."""

    def __init__(self, n_arms: int, ttl_ms: int | None = None):
        self.n_arms, self.ttl_ms = n_arms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("session", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = tuple(self.store.get()) if self.store.exists() else EMPTY
        # At most one row per batch.
        for batch in sorted(rows, key=lambda r: r["batch_id"]):
            if batch["batch_id"] <= state[-1]:
                continue  # delivered again
            state, step = advance(state, batch, self.n_arms)
            if step is not None:
                yield Row(session_id=key[0], **step)
        self.store.update(state)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """A session as a replay or the learning loop left it."""
        self.store.update(tuple(initialState[c] for c in _STATE_COLUMNS))

    def close(self) -> None:
        pass


def earned(
    number: int, before: float, velocity: float, has_exit: bool, hit_mask: int, n_items: int
) -> float | None:
    """What a batch earns for the open suggestion; None leaves it open. The rule that
    ``operators.course`` states for columns."""
    if not n_items:
        return None
    if hit_mask >> number & 1:
        return REWARD_HIT
    if has_exit:
        return REWARD_EXIT
    return REWARD_SPIKE if round(velocity - before, 6) > SPIKE_GAIN else None


def advance(state: tuple, batch: Row, n_arms: int) -> tuple[tuple, dict | None]:
    """State after one session-batch, and the step taken, if any."""
    seen, open_arm, number, score, exploring, before, _ = state
    now = batch["batch_id"]
    unchanged = (*state[:-1], now)
    if open_arm < 0:
        free = [i for i in range(n_arms) if not seen >> i & 1]
        if not free:
            return unchanged, None
        scores = batch["scores"]
        if batch["explores"]:
            arm = free[batch["pick"] % len(free)]
        else:
            arm = max(free, key=lambda i: (scores[i], -i))
        number, score, exploring = seen.bit_count(), scores[arm], batch["explores"]
        before, reward, kind = batch["velocity"], None, "suggest"
        after = (seen | 1 << arm, arm, number, score, exploring, before, now)
    else:
        judged_by = ("velocity", "has_exit", "hit_mask", "n_items")
        reward = earned(number, before, *(batch[c] for c in judged_by))
        if reward is None:
            return unchanged, None
        arm, kind = open_arm, "judge"
        after = (seen, -1, None, None, None, None, now)
    step = {
        "batch_id": now,
        "kind": kind,
        "arm_idx": arm,
        "suggestion_no": number,
        "injection_id": batch["suggestion_ids"][number],
        "score": score,
        "is_exploring": exploring,
        "pre_velocity": before,
        "velocity": batch["velocity"],
        "reward": reward,
        "device": batch["device"],
    }
    return after, step


def initial_state(steps: DataFrame) -> DataFrame:
    """The state of every session after some steps (``schemas.STEP_LOG``, or ``Ledger.state``): one row
    per session, to begin a stream with."""
    fields = [c for c in _STATE_COLUMNS if c not in ("seen", "open_arm", "last_batch")]
    is_open = F.col("s.open_arm") >= 0
    last = F.max_by(F.struct("seen", "open_arm", *fields), "batch_id").alias("s")
    newest = steps.groupBy("session_id").agg(F.max("batch_id").alias("last_batch"), last)
    return newest.select(
        "session_id",
        "s.seen",
        "s.open_arm",
        *[F.when(is_open, F.col(f"s.{c}")).alias(c) for c in fields],
        "last_batch",
    )


def steps(
    summaries: DataFrame,
    models: list[ArmModel],
    policy: Policy,
    ttl_ms: int | None = None,
    begin_with: DataFrame | None = None,
) -> DataFrame:
    """Steps of streamed session-batches. All hashing and scoring happens before the state.

    ``begin_with`` (``initial_state``) are sessions that are under way when the stream first starts; a
    stream that goes on from its checkpoint has them in its state already.
    """
    sid = F.col("session_id")
    ids = F.array(*[injection_id(sid, F.lit(n)) for n in range(len(policy.arms))])
    ready = (
        with_scores(summaries, models, policy)
        .withColumns(choice.draws(policy, sid, F.col("batch_id")))
        .withColumn("suggestion_ids", ids)
        .drop("buckets", "features")
    )
    return ready.groupBy("session_id").transformWithState(
        statefulProcessor=SessionMachine(len(policy.arms), ttl_ms),
        outputStructType=STEPS,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
        initialState=None if begin_with is None else begin_with.groupBy("session_id"),
    )


def start(
    spark: SparkSession,
    summaries: str,
    schema,
    output: str,
    checkpoint: str,
    models: list[ArmModel],
    policy: Policy = Policy(),
    ttl_ms: int | None = None,
    trigger: dict | None = None,
    begin_with: str | None = None,
) -> StreamingQuery:
    """Starts the static policy on a folder of session-batches and writes its steps to another.

    The state keeps the number of shuffle partitions it is first started with.

    ``begin_with`` names a folder with an ``initial_state``, for the first start.

    The state store is chosen in a session of its own; the caller's settings stay as they are.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Expired values are not returned, and are removed along with the next data; without this a
    # query that is to stop when all is read would run empty batches for ever.
    own.conf.set(PARTITIONS, spark.conf.get(PARTITIONS))
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = own.readStream.schema(schema).parquet(summaries)
    known = own.read.parquet(begin_with) if begin_with else None
    out = steps(stream, models, policy, ttl_ms, known)
    writer = out.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start(output)


def session_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the stream knows of each session, read back from its state store after the last
    micro-batch that was committed."""
    reader = spark.read.format("statestore").option("path", checkpoint)
    kept = reader.option("stateVarName", "session").load()
    value = "value.value" if "ttlExpirationMs" in kept.schema["value"].dataType.names else "value"
    return kept.select(F.col("key.session_id").alias("session_id"), f"{value}.*")
