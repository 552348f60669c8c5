"""Learning from every example in turn, in parallel: local steps and periodic averaging.

One optimizer step per example, in session order, is what a single process does. Here an arm's examples
are dealt to shards; each shard takes a step per example, in order, from the same models. After
``average_every`` examples the shards' weights and moments are averaged, each shard counting by how
many examples it had, and the next round goes on from there. An arm with one shard's worth of examples or
fewer is learned exactly as by the single process.

Which shard an example belongs to follows from its session and batch alone, and what is added up are
whole numbers, so that the result does not depend on how the rows were split into tasks or in what order
they arrive. A shard holds about ``shard_examples`` rows. The part of it that a round learns is one row
of the dealt table, in order, so a round shuffles no examples: a task learns its rows and sums their
models as it goes, and the tasks' sums are added in parts of ``_PART`` numbers. What reaches the driver
after a round is three numbers per weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..settings import Policy
from . import network
from .weights import BETA_1, BETA_2, EPSILON, ArmModel

ORDER = ("batch_id", "session_id")
_STATE = "arm_idx INT, n BIGINT, state ARRAY<DOUBLE>"
# The part of a shard that a round learns.
_BLOCK = "round INT, arm_idx INT, buckets ARRAY<ARRAY<INT>>, labels ARRAY<INT>"
# Sums over shards, by parts of a state: as exact digits, and as one number each.
_PART = 4096
_DIGITS = "arm_idx INT, part INT, n BIGINT, squares BIGINT, high ARRAY<DOUBLE>, middle ARRAY<DOUBLE>, low ARRAY<DOUBLE>"
_SUMS = "arm_idx INT, part INT, n BIGINT, squares BIGINT, x ARRAY<DOUBLE>"
# Bits per digit. Digits are whole numbers, so sums of up to 2^18 of them do not depend on the order of
# their terms; the last one counts 2^-104, as moments may be as small as 1e-20.
_BITS = 35
_HIGHEST = 34


def one_by_one(
    model: ArmModel, block: np.ndarray, labels: np.ndarray, learning_rate: float, l2: float
) -> ArmModel:
    """The model after one step per row: the steps of ``ArmModel.adam``, on copies that change in place."""
    model = ArmModel(model.layers, model.m, model.v, model.step)
    w, m, v = np.split(_state(model), 3)
    model.layers = model.shaped(w)
    gradient, spare = np.empty_like(w), np.empty_like(w)
    parts = model.shaped(gradient)
    # Biases carry no penalty.
    weighs = np.concatenate([np.repeat([l2, 0.0], [x[:-1].size, x[-1].size]) for x in model.layers])
    for k in range(len(block)):
        row, label = block[k : k + 1], labels[k : k + 1]
        for part, found in zip(parts, network.loss_gradient(model, row, label)):
            part[:] = found
        gradient += np.multiply(weighs, w, out=spare)
        model.step += 1
        rate = learning_rate * (1 - BETA_2**model.step) ** 0.5 / (1 - BETA_1**model.step)
        m *= BETA_1
        m += np.multiply(1 - BETA_1, gradient, out=spare)
        v *= BETA_2
        np.multiply(1 - BETA_2, gradient, out=spare)
        v += np.multiply(spare, gradient, out=spare)
        np.sqrt(v, out=spare)
        spare += EPSILON
        w -= np.divide(np.multiply(rate, m, out=gradient), spare, out=gradient)
    return ArmModel(model.layers, model.shaped(m), model.shaped(v), model.step)


def _state(model: ArmModel) -> np.ndarray:
    """Weights and both moments in a row."""
    return np.concatenate([part.ravel() for part in (*model.layers, *model.m, *model.v)])


def _from_state(model: ArmModel, state: np.ndarray, step: int) -> ArmModel:
    weights, m, v = (model.shaped(part) for part in np.split(state, 3))
    return ArmModel(weights, m, v, step)


def _learn(models: list[ArmModel], policy: Policy):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        arm = int(rows["arm_idx"].iloc[0])
        rows = rows.sort_values(list(ORDER), kind="stable")
        block = network.dense(rows["buckets"].tolist(), policy.n_features)
        labels = rows["label"].to_numpy(dtype=float)
        model = one_by_one(models[arm], block, labels, policy.learning_rate, policy.l2)
        return pd.DataFrame({"arm_idx": [arm], "n": [len(rows)], "state": [_state(model)]})

    return run


def shard(n_shards: dict[int, int]) -> Column:
    """The shard of an example among those of its arm."""
    counts = F.create_map(*[F.lit(x) for pair in n_shards.items() for x in pair])
    return F.pmod(F.xxhash64(*ORDER), counts[F.col("arm_idx")]).cast("int")


def _strictly(rows: DataFrame, models: list[ArmModel], policy: Policy) -> list[ArmModel]:
    """Models after examples that are one shard per arm."""
    learned = rows.groupBy("arm_idx", "shard").applyInPandas(_learn(models, policy), _STATE)
    out = list(models)
    for arm, n, state in learned.toPandas().itertuples(index=False):
        out[arm] = _from_state(models[arm], np.array(state), models[arm].step + int(n))
    return out


def _digits(x: np.ndarray) -> np.ndarray:
    """Numbers as three rows of whole ones, each a digit; what is not finite stays so."""
    out, rest = np.empty((3, len(x))), x * 2.0**_HIGHEST
    for k in range(3):
        out[k] = np.trunc(rest)
        rest = (rest - out[k]) * 2.0**_BITS
    return out


def _number(digits: np.ndarray) -> np.ndarray:
    """The numbers that sums of digits stand for."""
    high, middle, low = digits
    return ((low * 2.0**-_BITS + middle) * 2.0**-_BITS + high) * 2.0**-_HIGHEST


def _learn_blocks(models: list[ArmModel], policy: Policy):
    """Sums over a task's blocks: every model counts by its examples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, list] = {}
        for batch in batches:
            for arm, buckets, labels in zip(batch["arm_idx"], batch["buckets"], batch["labels"]):
                block = network.dense(list(buckets), policy.n_features)
                labels = np.asarray(labels, dtype=float)
                n, start = len(labels), models[arm]
                model = one_by_one(start, block, labels, policy.learning_rate, policy.l2)
                digits = _digits(_state(model) * (n / policy.average_every))
                total = totals.setdefault(arm, [0, 0, np.zeros_like(digits)])
                total[0] += n
                total[1] += n * n
                total[2] += digits
        for arm, (n, squares, digits) in totals.items():
            cuts = range(0, digits.shape[1], _PART)
            high, middle, low = ([row[c : c + _PART] for c in cuts] for row in digits)
            yield pd.DataFrame(
                {
                    "arm_idx": arm,
                    "part": range(len(cuts)),
                    "n": n,
                    "squares": squares,
                    "high": high,
                    "middle": middle,
                    "low": low,
                }
            )

    return run


def _add_parts(rows: pd.DataFrame) -> pd.DataFrame:
    digits = np.stack([np.sum(rows[name].tolist(), axis=0) for name in ("high", "middle", "low")])
    first = rows.iloc[0]
    return pd.DataFrame(
        {
            "arm_idx": [first["arm_idx"]],
            "part": [first["part"]],
            "n": [rows["n"].sum()],
            "squares": [rows["squares"].sum()],
            "x": [_number(digits)],
        }
    )


def _averaged(blocks: DataFrame, models: list[ArmModel], policy: Policy) -> list[ArmModel]:
    """The shards' models after a round, averaged."""
    learned = blocks.select("arm_idx", "buckets", "labels").mapInPandas(
        _learn_blocks(models, policy), _DIGITS
    )
    sums = learned.groupBy("arm_idx", "part").applyInPandas(_add_parts, _SUMS)
    out = list(models)
    for arm, parts in sums.toPandas().groupby("arm_idx"):
        parts = parts.sort_values("part")
        n, squares = int(parts["n"].iloc[0]), int(parts["squares"].iloc[0])
        # The shards' mean number of steps, each counting by its examples.
        step = models[arm].step + round(squares / n)
        mean = np.concatenate(parts["x"].tolist()) / (n / policy.average_every)
        out[arm] = _from_state(models[arm], mean, step)
    return out


def _deal(
    examples: DataFrame, shards: dict[int, int], policy: Policy, path: str
) -> tuple[DataFrame, int]:
    """Writes the examples as one row per shard and round; gives the table and its number of rounds."""
    spark = examples.sparkSession
    # As many files as a round can make use of, each with its shards' part of every round.
    n_files = min(sum(shards.values()), 2 * spark.sparkContext.defaultParallelism)
    before = {arm: sum(n for other, n in shards.items() if other < arm) for arm in shards}
    first = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    file = F.pmod(first[F.col("arm_idx")] + F.col("shard"), F.lit(n_files)).cast("int")
    dealt = examples.withColumn("file", file).repartitionById(n_files, F.col("file"))
    place = ("file", "arm_idx", "shard")
    turn = F.row_number().over(Window.partitionBy(*place).orderBy(*ORDER))
    # An arm with one shard has nothing to average, so all of it is one round.
    alone = F.col("arm_idx").isin([arm for arm, n in shards.items() if n == 1])
    number = F.when(alone, 0).otherwise(F.floor((turn - 1) / policy.average_every)).cast("int")
    taken = F.sort_array(F.collect_list(F.struct(*ORDER, "buckets", "label")))
    blocks = (
        dealt.withColumn("round", number)
        .groupBy(*place, "round")
        .agg(taken.alias("taken"))
        .select("round", "arm_idx", F.col("taken.buckets").alias("buckets"), F.col("taken.label").alias("labels"))
    )
    seen = Observation()
    blocks.observe(seen, F.max("round").alias("last")).write.mode("overwrite").parquet(path)
    return spark.read.schema(_BLOCK).parquet(path), seen.get["last"] + 1


def update(
    examples: DataFrame,
    models: list[ArmModel],
    policy: Policy,
    folder: str | None = None,
    counts: dict[int, int] | None = None,
) -> list[ArmModel] | None:
    """Models after all examples; None when there was nothing to learn from.

    ``counts`` are the examples per arm where they are known already. ``folder`` is where the dealt
    examples are kept when several rounds read them; without one a single round is all there is, so it
    is needed once an arm has more than ``policy.shard_examples``.
    """
    if counts is None:
        found = examples.groupBy("arm_idx").count().collect()
        counts = {r["arm_idx"]: r["count"] for r in found}
    counts = {arm: n for arm, n in counts.items() if n}
    if not counts:
        return None
    shards = {arm: -(-n // policy.shard_examples) for arm, n in counts.items()}
    dealt = examples.select("arm_idx", *ORDER, "buckets", "label").withColumn("shard", shard(shards))
    if max(shards.values()) == 1:
        return _strictly(dealt, models, policy)
    if folder is None:
        raise ValueError("several rounds need a folder")
    blocks, n_rounds = _deal(dealt, shards, policy, f"{folder.rstrip('/')}/dealt")
    for number in range(n_rounds):
        models = _averaged(blocks.where(F.col("round") == number), models, policy)
    return models
