import collections
import random
import re

import fixtures
import numpy as np

from nudgeline.llm import quality


def plain_counts(text):
    words = fixtures.WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    again = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if fixtures.WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(again),
    )


def test_plain_counts(spark):
    extra = ["a b c a b c", "x\nx\n \n \nx ", "a a a a", "a b", "p q r s p q r t\n" * 3]
    rows = [(r[0], r[1]) for r in fixtures.texts()] + [(900 + i, t) for i, t in enumerate(extra)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = fixtures.by_id(quality.score(docs, None))
    for doc_id, text in rows:
        r = found[doc_id]
        want = plain_counts(text)
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def labelled(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["river", "stone", "garden", "window", "letter", "music"]) + str(rng.randrange(99)) for _ in range(90)]
        if not good:
            words = [w.upper() + "!!" if rng.random() < 0.6 else w + "***" for w in words]
        rows.append((seed * 10_000 + i, " ".join(words), int(good)))
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, quality INT")


def test_held_out_accuracy(spark):
    learn, test = labelled(spark, 400, 1), labelled(spark, 300, 2)
    model = quality.train(learn, learn.select("doc_id", "quality"))
    found = quality.score(test, model).join(test.select("doc_id", "quality"), "doc_id").collect()
    right = sum((r["probability"] >= 0.5) == (r["quality"] == 1) for r in found)
    assert right >= 0.97 * len(found)
    kept = quality.keep(test, model)
    assert kept.columns == test.columns
    verdicts = {r["doc_id"] for r in found if r["kept"]}
    assert {r["doc_id"] for r in kept.collect()} == verdicts


def test_training_is_repeatable_and_bounded(spark):
    docs = labelled(spark, 300, 3)
    labels = docs.select("doc_id", "quality")
    a = quality.train(docs, labels, max_rows=100)
    b = quality.train(docs.repartition(5), labels.repartition(3), max_rows=100)
    assert np.array_equal(a.weights, b.weights) and a.slope == b.slope


def test_a_large_sample_is_fitted_in_tasks(spark, tmp_path, monkeypatch):
    docs = labelled(spark, 120, 3)
    labels = docs.select("doc_id", "quality")
    near = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows: near(rows, steps=12))
    here = quality.train(docs, labels)
    monkeypatch.setattr(quality, "fit", None)  # nothing is collected for it
    far = quality.fit_in_tasks
    monkeypatch.setattr(quality, "FIT_TASKS", 3)
    monkeypatch.setattr(quality, "fit_in_tasks", lambda m, f, r: far(m, f, r, steps=12))
    there = quality.train(docs, labels, fit_limit=1000, folder=str(tmp_path))
    assert np.abs(here.weights).max() > 0.1
    np.testing.assert_allclose(there.weights, here.weights, atol=1e-4)
    np.testing.assert_allclose(
        [there.bias, there.slope, there.shift], [here.bias, here.slope, here.shift], rtol=1e-3
    )


def test_without_usable_labels(spark):
    docs = fixtures.documents(spark)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id BIGINT, quality INT")
    assert quality.train(docs, none) is None
    one = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id BIGINT, quality INT")
    assert quality.train(docs, one) is None


def test_calibrated_probabilities():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    slope, shift = quality._calibrated(z, y)
    assert abs(slope - 0.5) < 0.1 and abs(shift + 1) < 0.15
