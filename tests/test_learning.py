"""Models: scores, gradients, updates, tables."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nudgeline.models import local_sgd, network, refit, training, weights
from nudgeline.models.scoring import list_scorer, scorer
from nudgeline.plans.ledger import Ledger
from nudgeline.settings import Policy

POLICY = Policy()


def flat(layers):
    return np.concatenate([w.ravel() for w in layers])


def random_vectors(n, seed=1):
    draw = np.random.default_rng(seed)
    return [sorted(map(int, draw.choice(100, size=draw.integers(4, 20), replace=False)))
            for _ in range(n)]


def loss(model, block, labels):
    p = network.activations(model, block)[-1][:, 0]
    return -np.sum(labels * np.log(p) + (1 - labels) * np.log(1 - p))


def test_size_of_a_model():
    model = weights.initial_models(POLICY)[0]
    assert [w.size for w in model.layers] == [3232, 528, 17]


def test_gradient_is_the_slope_of_the_loss():
    model = weights.initial_models(POLICY)[1]
    block = network.dense(random_vectors(20), 100)
    labels = np.arange(20) % 2.0
    gradients = network.loss_gradient(model, block, labels)
    draw = np.random.default_rng(3)
    for k, layer in enumerate(model.layers):
        for _ in range(10):
            i, j = draw.integers(layer.shape[0]), draw.integers(layer.shape[1])
            kept = layer[i, j]
            layer[i, j] = kept + 1e-6
            up = loss(model, block, labels)
            layer[i, j] = kept - 1e-6
            down = loss(model, block, labels)
            layer[i, j] = kept
            assert gradients[k][i, j] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_scores_in_tasks_equal_scores_here(spark):
    models = weights.initial_models(POLICY)
    vectors = random_vectors(50)
    rows = spark.createDataFrame(list(enumerate([*vectors, None])), "i INT, buckets ARRAY<INT>")
    got = rows.repartition(3).select("i", scorer(models, POLICY)("buckets").alias("s")).collect()
    want = np.column_stack([network.probability(m, network.dense(vectors, 100)) for m in models])
    scores = {r["i"]: r["s"] for r in got}
    assert scores.pop(50) is None
    assert [scores[i] for i in range(50)] == want.tolist()
    nested = rows.where("i < 50").groupBy((F.col("i") % 4).alias("g")).agg(
        F.sort_array(F.collect_list(F.struct("i", "buckets"))).alias("v")
    )
    lists = nested.select("v.i", list_scorer(models, POLICY)("v.buckets").alias("s")).collect()
    assert {i: s for r in lists for i, s in zip(r["i"], r["s"])} == scores
    none = rows.limit(1).select(list_scorer(models, POLICY)(F.array().cast("array<array<int>>")))
    assert none.first()[0] == []


def test_a_broken_model_scores_one_half():
    model = weights.initial_models(POLICY)[0]
    model.layers[2][:] = np.nan
    assert network.probability(model, network.dense([[1, 2]], 100)).tolist() == [0.5]


def examples(spark, n=300):
    vectors = random_vectors(n, seed=5)
    # Learnable: the label tells whether slot 7 is set, and every third vector gets it.
    rows = [(0, f"s{i}", i % 2, sorted({*v, 7} if i % 3 == 0 else set(v) - {7}), int(i % 3 == 0))
            for i, v in enumerate(vectors)]
    schema = "batch_id BIGINT, session_id STRING, arm_idx INT, buckets ARRAY<INT>, label INT"
    return spark.createDataFrame(rows, schema), rows


def test_update_equals_one_step_on_one_machine(spark):
    table, rows = examples(spark)
    models = weights.fresh_models(POLICY)
    got = training.update(table.repartition(7), models, POLICY)
    for arm in (0, 1):
        own = [r for r in rows if r[2] == arm]
        block = network.dense([r[3] for r in own], 100)
        summed = network.loss_gradient(models[arm], block, np.array([r[4] for r in own], float))
        mean = network.penalized(models[arm], summed, len(own), POLICY.l2)
        want = models[arm].adam(mean, POLICY.learning_rate)
        assert np.allclose(flat(got[arm].layers), flat(want.layers), atol=1e-12)
        assert got[arm].step == 2
    assert got[2] is models[2]


def test_nothing_to_learn(spark):
    table, _ = examples(spark, 3)
    assert training.update(table.where("label > 1"), weights.initial_models(POLICY), POLICY) is None


def test_loss_falls(spark):
    table, rows = examples(spark)
    table = table.coalesce(2).cache()
    policy = replace(POLICY, learning_rate=0.02)
    models = weights.fresh_models(policy)
    own = [r for r in rows if r[2] == 0]
    block, labels = network.dense([r[3] for r in own], 100), np.array([r[4] for r in own], float)
    before = loss(models[0], block, labels)
    for _ in range(12):
        models = training.update(table, models, policy)
    assert loss(models[0], block, labels) < 0.8 * before
    table.unpersist()


def test_table_keeps_models(spark):
    models = weights.fresh_models(POLICY)
    rows = weights.to_table(spark, models, POLICY, 4).collect()
    back = weights.from_rows(rows, POLICY)
    for one, other in zip(models, back):
        for a, b in zip((*one.layers, *one.m, *one.v), (*other.layers, *other.m, *other.v)):
            assert np.array_equal(a, b)
        assert one.step == other.step == 1


def test_models_of_another_shape_are_not_taken(spark):
    rows = weights.to_table(spark, weights.initial_models(POLICY), POLICY, 0).collect()
    assert weights.from_rows(rows, replace(POLICY, n_features=50)) is None
    assert weights.from_rows(rows, replace(POLICY, arms=("a", "b", "c"))) is None
    assert weights.from_rows(rows, replace(POLICY, hidden=(8, 4))) is None
    assert weights.from_rows(rows[:-1], POLICY) is None


def test_seed_changes_weights():
    one, other = (weights.initial_models(replace(POLICY, seed=s))[0] for s in ("", "x"))
    assert not np.array_equal(one.layers[0], other.layers[0])


def in_turn(rows, models, policy, n_shards, shard_of):
    """Local steps and averaging on one machine, written out."""
    out = list(models)
    for arm in sorted({r[2] for r in rows}):
        shards = {}
        for r in sorted((r for r in rows if r[2] == arm), key=lambda r: (r[0], r[1])):
            shards.setdefault(shard_of[r[1]] if n_shards[arm] > 1 else 0, []).append(r)
        model, start = models[arm], 0
        every = policy.average_every if len(shards) > 1 else 10**9
        while any(len(s) > start for s in shards.values()):
            ends = []
            for own in shards.values():
                m, part = model, own[start : start + every]
                for r in part:
                    x, y = network.dense([r[3]], policy.n_features), np.array([float(r[4])])
                    grads = network.penalized(m, network.loss_gradient(m, x, y), 1, policy.l2)
                    m = m.adam(grads, policy.learning_rate)
                if part:
                    ends.append((len(part), m))
            n = sum(k for k, _ in ends)

            def mean(kind):
                return [sum(k * getattr(m, kind)[i] for k, m in ends) / n for i in range(len(model.layers))]

            steps = model.step + round(sum(k * k for k, _ in ends) / n)
            model = weights.ArmModel(mean("layers"), mean("m"), mean("v"), steps)
            start += every
        out[arm] = model
    return out


def close(one, other):
    for a, b in zip(one, other):
        assert a.step == b.step
        for x, y in zip((*a.layers, *a.m, *a.v), (*b.layers, *b.m, *b.v)):
            assert np.allclose(x, y, atol=1e-12, rtol=0)


@pytest.mark.parametrize("shard_examples", [1000, 40])
def test_steps_in_turn_equal_those_on_one_machine(spark, tmp_path, shard_examples):
    policy = replace(POLICY, shard_examples=shard_examples, average_every=15)
    table, rows = examples(spark)
    models = weights.fresh_models(policy)
    n_shards = {arm: -(-150 // shard_examples) for arm in (0, 1)}
    dealt = table.select("session_id", local_sgd.shard(n_shards).alias("shard")).collect()
    got = local_sgd.update(table.repartition(5), models, policy, str(tmp_path))
    close(got, in_turn(rows, models, policy, n_shards, {r["session_id"]: r["shard"] for r in dealt}))
    assert got[2] is models[2]
    if shard_examples == 1000:
        assert got[0].step == models[0].step + 150


def test_shards_give_the_same_however_rows_are_split(spark, tmp_path):
    policy = replace(POLICY, shard_examples=40, average_every=15)
    table, _ = examples(spark)
    models = weights.fresh_models(policy)
    first, again = (
        local_sgd.update(table.repartition(n), models, policy, str(tmp_path / str(n))) for n in (2, 7)
    )
    for a, b in zip(first, again):
        assert all(np.array_equal(x, y) for x, y in zip((*a.layers, *a.m, *a.v), (*b.layers, *b.m, *b.v)))


def test_steps_in_turn_learn_more_than_one_per_batch(spark, tmp_path):
    table, rows = examples(spark)
    table = table.coalesce(2).cache()
    fresh = weights.fresh_models(POLICY)
    local = replace(POLICY, shard_examples=50, average_every=25)
    by_example, by_batch = fresh, fresh
    for batch in range(10):
        by_example = local_sgd.update(table, by_example, local, str(tmp_path / str(batch)))
        by_batch = training.update(table, by_batch, POLICY)
    own = [r for r in rows if r[2] == 0]
    block, labels = network.dense([r[3] for r in own], 100), np.array([r[4] for r in own], float)
    assert network.loss_sum(by_example[0], block, labels) < 0.6 * network.loss_sum(by_batch[0], block, labels)
    table.unpersist()


def test_a_round_shuffles_no_examples(spark, tmp_path):
    """A round is two jobs: blocks learned and summed where they are read, and the sums added."""
    policy = replace(POLICY, shard_examples=40, average_every=15)
    table, rows = examples(spark)
    counts = {arm: sum(r[2] == arm for r in rows) for arm in (0, 1)}
    n_shards = {arm: -(-n // 40) for arm, n in counts.items()}
    dealt = table.select("session_id", "arm_idx", local_sgd.shard(n_shards).alias("shard")).collect()
    sizes = [sum((r["arm_idx"], r["shard"]) == k for r in dealt) for k in {(r["arm_idx"], r["shard"]) for r in dealt}]
    n_rounds = -(-max(sizes) // 15)
    spark.sparkContext.setJobGroup("rounds", "rounds of a fit")
    local_sgd.update(table, weights.fresh_models(policy), policy, str(tmp_path), counts)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")
    spark.sparkContext._jsc.clearJobGroup()
    blocks = spark.read.parquet(f"{tmp_path}/dealt")
    assert blocks.groupBy("round").count().count() == n_rounds > 2
    assert blocks.count() == sum(-(-n // 15) for n in sizes)
    assert len(jobs) <= 2 + 2 * n_rounds


def test_sums_of_digits_do_not_depend_on_the_order():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(50, 300)) * 10.0 ** draw.integers(-20, 1, size=(50, 300))
    digits = [local_sgd._digits(row) for row in x]
    assert np.allclose([local_sgd._number(d) for d in digits], x, atol=1e-31, rtol=1e-15)
    one, other = sum(digits), sum(digits[::-1])
    assert np.array_equal(one, other)
    assert np.allclose(local_sgd._number(one), x.sum(axis=0), atol=1e-14, rtol=0)
    assert np.isnan(local_sgd._number(local_sgd._digits(np.array([np.nan, 1.0])))).tolist() == [True, False]


def test_nothing_to_learn_in_turn(spark):
    table, _ = examples(spark, 3)
    assert local_sgd.update(table.where("label > 1"), weights.initial_models(POLICY), POLICY) is None
    with pytest.raises(ValueError, match="folder"):
        local_sgd.update(table, weights.initial_models(POLICY), replace(POLICY, shard_examples=1))


def test_loss_from_logits():
    model = weights.initial_models(POLICY)[0]
    block, labels = network.dense(random_vectors(30), 100), np.arange(30) % 2.0
    assert network.loss_sum(model, block, labels) == pytest.approx(loss(model, block, labels))
    model.layers[2][-1] = 1e6
    assert np.isfinite(network.loss_sum(model, block, labels))


def penalized_loss(model, block, labels):
    penalty = POLICY.l2 / 2 * sum((w[:-1] ** 2).sum() for w in model.layers)
    return (network.loss_sum(model, block, labels) + penalty) / len(block)


def test_one_pass_gives_loss_and_slope_of_all_arms(spark):
    table, rows = examples(spark, 60)
    models = weights.initial_models(POLICY)
    found = refit.evaluate(table.repartition(3), dict(enumerate(models)), POLICY)
    assert set(found) == {0, 1}
    for arm, (value, gradient) in found.items():
        own = [r for r in rows if r[2] == arm]
        block, labels = network.dense([r[3] for r in own], 100), np.array([r[4] for r in own], float)
        assert value == pytest.approx(penalized_loss(models[arm], block, labels), abs=1e-12)
        flat_weights = models[arm].flat()
        for i in (0, 500, 3231, 3300, 3776):
            sides = []
            for change in (1e-6, -1e-6):
                moved = flat_weights.copy()
                moved[i] += change
                sides.append(penalized_loss(weights.ArmModel(models[arm].shaped(moved)), block, labels))
            assert gradient[i] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-6)


def test_descent_finds_the_lowest_point():
    """A narrow valley whose bottom is known."""
    run = refit.Descent(np.array([-1.2, 1.0]), tolerance=1e-8)
    for _ in range(300):
        x, y = run.point
        slope = np.array([-400 * x * (y - x * x) - 2 * (1 - x), 200 * (y - x * x)])
        run.tell(100 * (y - x * x) ** 2 + (1 - x) ** 2, slope)
        if run.done:
            break
    assert run.done and np.allclose(run.at, 1.0, atol=1e-4)


def test_refit_serves(spark, tmp_path):
    table, rows = examples(spark, 120)
    fitted = refit.refit(table.coalesce(2).cache(), POLICY, max_passes=40)
    assert set(fitted.after) == {0, 1}
    assert all(fitted.after[arm] < 0.3 * fitted.before[arm] for arm in fitted.after)
    own = [r for r in rows if r[2] == 0]
    guess = network.probability(fitted.models[0], network.dense([r[3] for r in own], 100)) > 0.5
    assert (guess == np.array([r[4] for r in own])).mean() > 0.95
    assert np.array_equal(fitted.models[2].flat(), weights.initial_models(POLICY)[2].flat())
    # They are loaded as the next batch's models, also after a restart.
    ledger = Ledger(spark, str(tmp_path), POLICY)
    ledger.adopt(weights.initial_models(POLICY))
    ledger.adopt(fitted.models)
    for known in (ledger, Ledger(spark, str(tmp_path), POLICY)):
        assert not known.is_committed(0)
        for one, other in zip(known.models(), fitted.models):
            assert np.array_equal(one.flat(), other.flat()) and one.step == 0
    ledger.commit(0, None)
    again = Ledger(spark, str(tmp_path), POLICY)
    assert again.is_committed(0) and np.array_equal(again.models()[0].flat(), fitted.models[0].flat())
    fresh = weights.fresh_models(POLICY)
    again.commit(1, fresh)
    assert np.array_equal(Ledger(spark, str(tmp_path), POLICY).models()[0].flat(), fresh[0].flat())


def test_refit_of_one_sided_and_missing_arms(spark):
    table, _ = examples(spark, 60)
    one_sided = table.withColumn("label", F.when(F.col("arm_idx") == 1, 1).otherwise(F.col("label")))
    fitted = refit.refit(one_sided, POLICY, max_passes=30)
    assert {r["beats_constant"] for r in refit.with_fit(one_sided, fitted).collect()} == {True}
    none = refit.refit(table.limit(0), POLICY)
    assert none.after == {} and none.passes == 1
    assert refit.with_fit(table.limit(0), none).collect() == []
