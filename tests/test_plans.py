"""What the plans look like: shuffles, pushed-down columns, no Python where none is needed."""

import re
import time
from pathlib import Path

import pytest

import nudgeline
from nudgeline import catalog
from nudgeline.operators import course
from nudgeline.session import CHECKPOINT_KEY, working_folder


# Queries that run batch after batch before they return a plan.
RUN_BATCHES = {
    "model_update", "model_local_update", "model_refit", "learned_loop", "lifecycle_stream",
    "lifecycle_handover", "session_states", "phase_split",
}


def plan(frame):
    """The physical plan."""
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def large(spark):
    """Plans as they are for tables too large to broadcast, with reuse shown."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def shuffles(text):
    """Keys of each shuffle; one that is used again counts once."""
    return re.findall(r"(?<!\], )Exchange hashpartitioning\(([^)]*)\)", text)


@pytest.mark.parametrize(
    "name", ["session_batch", "behaviour_counts", "engagement_velocity", "feedback_flags"]
)
def test_plain_aggregates_take_one_shuffle(large, small, name):
    text = plan(catalog.queries()[name](large, small))
    assert len(shuffles(text)) == 1
    assert "partial_" in text
    assert "collect_list" not in text and "Python" not in text


@pytest.mark.parametrize("name", ["engagement_velocity", "behaviour_counts", "feedback_flags"])
def test_fixed_width_aggregates_hash(large, small, name):
    text = plan(catalog.queries()[name](large, small))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_summaries_join_without_further_shuffles(large, small):
    text = plan(catalog._summaries(large, small))
    keys = [s for s in shuffles(text) if "batch_id" in s and "salt" not in s and "word" not in s]
    # What the events tell, and late values.
    assert len(keys) <= 2 and len(shuffles(text)) <= 5
    # The second reading is for the late values alone.
    assert text.count("FileScan") == 2 and "ReusedExchange" in text
    assert "Python" not in text and "CartesianProduct" not in text
    assert not re.search(r"SortAggregate\(key", text)


def test_replay_adds_one_shuffle_by_session(large, small):
    text = plan(catalog.lifecycle_replay(large, small))
    by_session = [s for s in shuffles(text) if "batch_id" not in s and "session_id" in s]
    assert len(by_session) == 1 and "session_id" in by_session[0]


def test_at_most_fifteen_words_per_task_reach_a_session_batch(large, small):
    text = plan(catalog._summaries(large, small))
    assert "row_number(), 16, Partial" in text  # the events' own row and fifteen words
    before = text[text.index("row_number(), 16, Final") : text.index("row_number(), 16, Partial")]
    assert "Exchange hashpartitioning(batch_id" in before


def test_the_state_machine_is_one_sort_without_python(large, small):
    summaries = catalog._summaries(large, small)
    text = plan(course.courses(summaries, 3))
    assert "Python" not in text and "InArrow" not in text
    # One sort by session and one shuffle serve all rounds; the joins sort by batch and session.
    assert len(re.findall(r"Sort \[session_id#\d+ ASC", text)) == 1
    assert text.count("Window [min(") == 6
    assert sum("batch_id" not in keys for keys in shuffles(text)) == 1


def test_limits_apply_before_the_shuffle(large, small):
    for name in ("raw_sample", "session_tokens"):
        text = plan(catalog.queries()[name](large, small))
        assert "row_number(), 10, Partial" in text or "row_number(), 15, Partial" in text


def test_only_needed_columns_are_read(large, small):
    text = plan(catalog.queries()["conversion_intent"](large, small))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in text
    text = plan(catalog.queries()["raw_profile"](large, small))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text


def test_texts_are_parsed_once(large, small):
    text = plan(catalog.queries()["session_key"](large, small))
    assert text.count("from_json(") == 1
    text = plan(catalog.queries()["text_tokens"](large, small))
    assert text.count("regexp_extract_all(") == 1


def test_nothing_is_gathered_or_cut_off():
    for path in Path(nudgeline.__file__).parent.rglob("*.py"):
        code = path.read_text()
        assert "localCheckpoint" not in code
        assert "crossJoin" not in code
        if "llm" not in path.parts:
            assert "broadcast(" not in code, "left to Spark, which checks sizes"


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - RUN_BATCHES))
def test_plans_are_made_quickly(spark, small, name):
    took = []
    for _ in range(2):  # the first one may load classes
        frame = catalog.queries()[name](spark, small)
        start = time.perf_counter()
        plan(frame)
        took.append(time.perf_counter() - start)
    assert min(took) < 3


def test_working_folder(spark):
    assert working_folder(spark) == spark.conf.get(CHECKPOINT_KEY)
