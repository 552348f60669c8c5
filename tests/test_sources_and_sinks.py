"""Data sources of our own: a message stream with offsets, and outputs that appear together."""

import json
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from nudgeline.models import weights
from nudgeline.operators import session_batch
from nudgeline.plans import learned_loop, lifecycle, outbox, outputs
from nudgeline.plans.ledger import Ledger
from nudgeline.settings import Policy
from nudgeline.sources import messages, replay, segments
from nudgeline.streaming import loop

POLICY = Policy()


@pytest.fixture(scope="module")
def steps(spark, small):
    summaries = session_batch.usable(session_batch.summarize(replay.read_behaviour(spark, small)))
    table = lifecycle.replay(summaries, weights.initial_models(POLICY)).cache()
    yield table
    table.unpersist()


def published(spark, path):
    return {k: sorted(map(str, outbox.read(spark, path, k).collect())) for k in outbox.KINDS}


def wanted(steps, batch_ids):
    own = steps.where(F.col("batch_id").isin(*batch_ids))
    when = F.col("batch_id").cast("double")
    return {
        "suggestions": sorted(map(str, outputs.suggestions(own, when).collect())),
        "metrics": sorted(map(str, outputs.metrics(own, when).collect())),
    }


def batch_rows(steps, batch_id):
    own = steps.where(F.col("batch_id") == batch_id).repartition(3)
    return outbox.rows_of(own, F.col("batch_id").cast("double"))


def test_outputs_appear_together_and_are_replaced(spark, steps, tmp_path):
    path = str(tmp_path / "outbox")
    assert published(spark, path) == {"suggestions": [], "metrics": []}
    publish = outbox.publisher(spark, path)
    for batch_id in (4, 5):
        publish(batch_rows(steps, batch_id), batch_id)
    both = wanted(steps, [4, 5])
    assert both["suggestions"] and both["metrics"]
    assert published(spark, path) == both
    publish(batch_rows(steps, 5), 5)  # tried again
    assert published(spark, path) == both
    assert len(list(Path(path).glob("suggestions/batch_id=5/attempt=*"))) == 1
    publish(None, 4)  # the repeat has no rows
    assert published(spark, path) == wanted(steps, [5])


class Broken(Exception):
    pass


class LostBeforeTheCommit(outbox.OutboxWriter):
    """A driver that stops when both kinds are written and nothing is said yet."""

    def commit(self, messages):
        raise Broken("stopped")

    def abort(self, messages):
        pass


class LostSource(outbox.OutboxSource):
    @classmethod
    def name(cls):
        return "lost_outbox"

    def writer(self, schema, overwrite):
        return LostBeforeTheCommit(self.options["path"], int(self.options["batch_id"]))


class FailsBetween(outbox.OutboxWriter):
    """A task that fails when one kind is written and the other is not."""

    def write(self, iterator):
        import pyarrow.compute as pc

        def one_kind():
            for batch in iterator:
                yield batch.filter(pc.equal(batch.column("kind"), "suggestions"))
            raise Broken("between the two")

        return super().write(one_kind())


class FailingSource(outbox.OutboxSource):
    @classmethod
    def name(cls):
        return "failing_outbox"

    def writer(self, schema, overwrite):
        return FailsBetween(self.options["path"], int(self.options["batch_id"]))


@pytest.mark.parametrize("source", [LostSource, FailingSource])
def test_a_crash_between_the_two_leaves_neither(spark, steps, tmp_path, source):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    path = str(tmp_path / "outbox")
    good = outbox.publisher(spark, path)
    good(batch_rows(steps, 4), 4)
    with pytest.raises(Exception, match="stopped|between"):
        outbox.publisher(spark, path, source)(batch_rows(steps, 5), 5)
    assert published(spark, path) == wanted(steps, [4])
    with pytest.raises(Exception, match="stopped|between"):
        outbox.publisher(spark, path, source)(batch_rows(steps, 4), 4)
    assert published(spark, path) == wanted(steps, [4])
    good(batch_rows(steps, 5), 5)
    assert published(spark, path) == wanted(steps, [4, 5])


def test_the_loop_publishes(spark, small, tmp_path):
    rows = replay.read_behaviour(spark, small).where("batch_id < 4")
    ledger = learned_loop.replay_batches(spark, rows, str(tmp_path), float, POLICY)
    found = published(spark, str(tmp_path / "outbox"))
    assert found == wanted(ledger.steps(), range(4))
    assert found["suggestions"] and found["metrics"]


# --- the message stream ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sent(spark, small):
    """Messages with their partition (a session's are in one) and offset."""
    rows = replay.read_behaviour(spark, small).where("batch_id < 5")
    found = replay.as_messages(rows).orderBy("arrival").select("body").collect()
    out = {0: [], 1: []}
    for r in found:
        body = bytes(r["body"]).decode()
        sid = json.loads(body)[0]["payload"]["sessionId"]
        out[int(sid.rsplit("_", 1)[1]) % 2].append(body)
    return out


def put(folder, number, first, lines):
    own = folder / f"partition={number}"
    own.mkdir(parents=True, exist_ok=True)
    (own / f"{first:020d}.log").write_text("".join(x + "\n" for x in lines))


LIMIT = 25


def test_offsets_and_limit_end_to_end(spark, sent, tmp_path):
    """The learning loop on partitions and offsets, in two runs, against a replay of the same batches."""
    segments.register(spark)
    log = tmp_path / "log"
    for number, lines in sent.items():
        put(log, number, 0, lines[:30])
        put(log, number, 30, lines[30:60])
    options = {"path": str(log), "limit": str(LIMIT), "progress": str(tmp_path / "live/progress"), "rows_per_task": "10"}

    def run():
        stream = messages.read_message_stream(spark, segments.FORMAT, options)
        query = loop.start(
            stream, str(tmp_path / "live"), POLICY, clock=float, trigger={"processingTime": "0 seconds"}
        )
        query.processAllAvailable()
        query.stop()

    run()
    first = Ledger(spark, str(tmp_path / "live/ledger"), POLICY).newest["batch_id"]
    assert first == 2  # 60 messages a partition, 25 at a time
    for number, lines in sent.items():
        put(log, number, 60, lines[60:])
    (log / "partition=0" / f"{60:020d}.log").open("a").write("half a line")
    run()
    ledger = Ledger(spark, str(tmp_path / "live/ledger"), POLICY)
    longest = max(map(len, sent.values()))
    assert ledger.newest["batch_id"] == 2 + -(-(longest - 60) // LIMIT)

    # Batches as they were admitted: 25 a time, and a shorter third one before the second run.
    def admitted(offset):
        return offset // LIMIT if offset < 60 else 3 + (offset - 60) // LIMIT

    listed = [
        (admitted(i), n, i, line.encode()) for n, lines in sent.items() for i, line in enumerate(lines)
    ]
    table = spark.createDataFrame(listed, "batch_id BIGINT, partition INT, offset BIGINT, body BINARY")
    rows = messages.behaviour(messages.decode(messages._with_body(table)))
    whole = learned_loop.replay_batches(spark, rows, str(tmp_path / "replay"), float, POLICY)
    columns = [c for c in whole.steps().columns if c != "score"]
    got, want = (sorted(map(str, x.steps().select(columns).collect())) for x in (ledger, whole))
    assert got == want and len(want) > 10


def test_a_reader_admits_what_is_left(tmp_path):
    put(tmp_path, 0, 0, ["a", "b", "c"])
    put(tmp_path, 3, 0, ["x"])
    put(tmp_path, 0, 3, ["d"])
    note = str(tmp_path / "note")
    reader = segments.SegmentReader(str(tmp_path), 2, note, 100)
    assert reader.initialOffset() == {}
    assert reader.latestOffset() == {"0": 2, "3": 1}
    reader.partitions({}, {"0": 2, "3": 1})
    assert reader.latestOffset() == {"0": 4, "3": 1}
    again = segments.SegmentReader(str(tmp_path), 2, note, 100)
    assert again.latestOffset() == {"0": 4, "3": 1}
    parts = again.partitions({"0": 2, "3": 1}, {"0": 4, "3": 1})
    rows = [r for p in parts for b in again.read(p) for r in b.to_pylist()]
    assert rows == [
        {"partition": 0, "offset": 2, "body": b"c"},
        {"partition": 0, "offset": 3, "body": b"d"},
    ]
    with pytest.raises(ValueError, match="progress"):
        segments.SegmentReader(str(tmp_path), 2, None, 100)
    assert segments.SegmentReader(str(tmp_path / "none"), None, None, 100).latestOffset() == {}
