"""Durable tables of the learning loop: step log, state snapshots, models, commits.

The step log is the state: each row carries its session's state after the step, so the state
before a batch is the newest row per session. Only sessions that changed are written per batch.
Snapshots keep the part of the log that must be read short. They are cut into buckets of sessions:
a batch reads the buckets of its own sessions, and a new snapshot rewrites the buckets that have
changed, so neither grows with all sessions ever seen.

Everything of batch n lies in a folder of its own that is overwritten as a whole; the commit is
written last. A batch that is run again after a crash therefore reads the same state and models
and replaces what it left behind, and a committed batch is skipped. What a commit no longer refers
to (older models, replaced buckets) is removed after it. The log itself is output and stays.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..models import weights
from ..models.weights import ArmModel
from ..schemas import MODEL, STEP_LOG
from ..session import observed, remove
from ..settings import Policy

# ``snapshots`` has the version of each bucket, null for one without sessions.
COMMIT = (
    "batch_id BIGINT, model_version BIGINT, snapshots ARRAY<BIGINT>, snapshot_upto BIGINT"
)
ADOPTION = "batch_id BIGINT, model_version BIGINT"
SLOTS = 64
BUCKETS = 64
_COLUMNS = [c.split(" ")[0] for c in STEP_LOG.split(", ")]


def _bucket() -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _buckets(rows: DataFrame) -> list[int]:
    """The buckets that occur; at most ``BUCKETS`` numbers."""
    return sorted(r["bucket"] for r in rows.select(_bucket()).distinct().collect())


def _is_missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (error.getCondition() or "")


@dataclass(frozen=True)
class StepCounts:
    """How many suggestions a batch made, and how many it judged by arm."""

    suggested: int
    judged: dict[int, int]


class Ledger:
    """Tables under one folder. Holds the newest commit and models in memory; all else is read."""

    def __init__(self, spark: SparkSession, folder: str, policy: Policy):
        self.spark, self.folder, self.policy = spark, folder.rstrip("/"), policy
        # Commits take turns in a ring of folders, so that a restart reads few of them: all that
        # counts are the newest and those since its snapshot.
        self._slots = max(SLOTS, 2 * policy.snapshot_every)
        commits = self._read_commits()
        self.newest = commits[-1] if commits else None
        floor = self.newest["snapshot_upto"] if self.newest else -1
        # Batches whose log is newer than the snapshot.
        self.tail = [c["batch_id"] for c in commits if c["batch_id"] > floor]
        self._models: list[ArmModel] | None = None
        # Models adopted since the newest batch.
        at = self.newest["batch_id"] if self.newest else -1
        adopted = [a["model_version"] for a in self._read_adoptions() if a["batch_id"] == at]
        if adopted:
            self._take(at, min(adopted))

    def _path(self, table: str, column: str, value: int) -> str:
        return f"{self.folder}/{table}/{column}={value}"

    def _read_commits(self):
        try:
            commits = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits")
            # One small row per slot.
            return [r.asDict() for r in commits.orderBy("batch_id").collect()]
        except AnalysisException as error:
            if _is_missing(error):
                return []
            raise

    # --- models ---

    def models(self) -> list[ArmModel]:
        """Committed models. Fresh ones if there are none, or if arms or vector size changed;
        any other trouble with reading fails the batch rather than dropping what was learned."""
        if self._models is None:
            self._models = self._read_models() or weights.fresh_models(self.policy)
        return self._models

    def _read_models(self) -> list[ArmModel] | None:
        version = self.newest["model_version"] if self.newest else None
        if version is None:
            return None
        try:
            table = self.spark.read.schema(MODEL).parquet(
                self._path("models", "version", version)
            )
            return weights.from_rows(table.collect(), self.policy)
        except AnalysisException as error:
            if _is_missing(error):
                return None
            raise

    def write_models(self, models: list[ArmModel], version: int) -> None:
        table = weights.to_table(self.spark, models, self.policy, version).coalesce(1)
        table.write.mode("overwrite").parquet(self._path("models", "version", version))

    def adopt(self, models: list[ArmModel]) -> None:
        """Publishes models that were made elsewhere, as by a refit; the next batch is scored with
        them. A note beside the commits says so; two take turns, so a crash leaves one whole."""
        # Versions of batches are their numbers; these are below zero and never used again.
        version = -time.time_ns()
        self.write_models(models, version)
        at = self.newest["batch_id"] if self.newest else -1
        turn = 1 - max(self._read_adoptions(), key=lambda a: -a["model_version"], default={"turn": 1})["turn"]
        row = self.spark.createDataFrame([(at, version)], ADOPTION).coalesce(1)
        row.write.mode("overwrite").parquet(self._path("adopted", "turn", turn))
        old = self.newest["model_version"] if self.newest else None
        self._take(at, version)
        self._models = models
        if old is not None:
            remove(self.spark, self._path("models", "version", old))

    def _read_adoptions(self) -> list[dict]:
        try:
            rows = self.spark.read.schema(ADOPTION + ", turn INT").parquet(f"{self.folder}/adopted")
            return [r.asDict() for r in rows.collect()]
        except AnalysisException as error:
            if _is_missing(error):
                return []
            raise

    def _take(self, batch_id: int, version: int) -> None:
        nothing = {"batch_id": batch_id, "snapshots": self._versions(), "snapshot_upto": -1}
        self.newest = {**(self.newest or nothing), "model_version": version}

    def scratch(self, batch_id: int) -> str:
        """A folder for tables that a batch needs while it runs; a repeat replaces them."""
        return f"{self.folder}/scratch/slot={batch_id % self._slots}"

    # --- step log and state ---

    def is_committed(self, batch_id: int) -> bool:
        return self.newest is not None and batch_id <= self.newest["batch_id"]

    def write_steps(self, steps: DataFrame, batch_id: int) -> tuple[DataFrame, StepCounts]:
        """Writes a batch's part of the log; gives it as read back, and its counts, which are observed
        on the way."""
        path = self._path("steps", "batch_id", batch_id)
        judged = F.col("kind") == "judge"
        arms = range(len(self.policy.arms))
        seen = Observation()
        counted = steps.observe(
            seen,
            F.count_if(F.col("kind") == "suggest").alias("suggested"),
            *[F.count_if(judged & (F.col("arm_idx") == arm)).alias(f"judged_{arm}") for arm in arms],
        )
        counted.drop("batch_id").write.mode("overwrite").parquet(path)
        found = observed(seen)
        by_arm = {arm: found.get(f"judged_{arm}", 0) for arm in arms}
        counts = StepCounts(found.get("suggested", 0), by_arm)
        return self._read_steps([batch_id]), counts

    def _read_steps(self, batch_ids: list[int]) -> DataFrame:
        paths = [self._path("steps", "batch_id", b) for b in batch_ids]
        reader = self.spark.read.schema(STEP_LOG).option("basePath", f"{self.folder}/steps")
        return reader.parquet(*paths).select(*_COLUMNS)

    def steps(self) -> DataFrame:
        """The whole committed log."""
        table = self.spark.read.schema(STEP_LOG).parquet(f"{self.folder}/steps")
        upto = self.newest["batch_id"] if self.newest else -1
        return table.select(*_COLUMNS).where(F.col("batch_id") <= upto)

    def state(self, batch_id: int, sessions: DataFrame | None = None) -> DataFrame:
        """Newest step per session before a batch: snapshot plus the log written since.

        With ``sessions`` only theirs: a batch usually touches few of all sessions, and then
        their ids travel to the state instead of the state to them. Sessions untouched for
        longer than the policy's ``ttl_batches`` are left out.
        """
        touched = range(BUCKETS)
        if sessions is not None and any(v is not None for v in self._versions()):
            touched = _buckets(sessions)
        rows = self._newest(batch_id, touched, sessions)
        return rows if rows is not None else self.spark.createDataFrame([], STEP_LOG)

    def _newest(
        self, batch_id: int, buckets: Iterable[int], sessions: DataFrame | None = None
    ) -> DataFrame | None:
        """Newest step per session from the given buckets and the log since their snapshot."""
        versions = self._versions()
        paths = [self._bucket_path(versions[b], b) for b in buckets if versions[b] is not None]
        parts = []
        if paths:
            parts.append(self.spark.read.schema(STEP_LOG).parquet(*paths).select(*_COLUMNS))
        if self.tail:
            parts.append(self._read_steps(self.tail))
        if not parts:
            return None
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if self.policy.ttl_batches is not None:
            rows = rows.where(F.col("batch_id") >= batch_id - self.policy.ttl_batches)
        if sessions is not None:
            rows = rows.join(sessions.select("session_id"), "session_id", "left_semi")
        others = [c for c in _COLUMNS if c not in ("session_id", "batch_id")]
        newest = F.max_by(F.struct(*others), "batch_id").alias("s")
        state = rows.groupBy("session_id").agg(F.max("batch_id").alias("batch_id"), newest)
        return state.select("session_id", "batch_id", "s.*").select(*_COLUMNS)

    def _versions(self) -> list[int | None]:
        found = self.newest and self.newest["snapshots"]
        return list(found) if found else [None] * BUCKETS

    def _bucket_path(self, version: int, bucket: int) -> str:
        return f"{self._path('snapshots', 'version', version)}/bucket={bucket}"

    def _write_snapshot(self, batch_id: int) -> list[int | None]:
        """Writes the buckets that the log has changed since their last version anew; gives the
        versions of all."""
        touched = _buckets(self._read_steps(self.tail))
        path = self._path("snapshots", "version", batch_id)
        state = self._newest(batch_id + 1, touched).withColumn("bucket", _bucket())
        state.write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = set(_buckets(self.spark.read.schema(STEP_LOG).parquet(path)))
        versions = self._versions()
        for b in touched:
            versions[b] = batch_id if b in written else None
        return versions

    # --- commit ---

    def commit(self, batch_id: int, models: list[ArmModel] | None) -> None:
        """Publishes a batch. ``models`` are new ones, None when nothing was learned."""
        version = self.newest["model_version"] if self.newest else None
        if models is not None:
            version = batch_id
            self.write_models(models, version)
        before, versions = self._versions(), self._versions()
        upto = self.newest["snapshot_upto"] if self.newest else -1
        tail = [*self.tail, batch_id]
        if len(tail) >= self.policy.snapshot_every:
            self.tail = tail
            versions, upto, tail = self._write_snapshot(batch_id), batch_id, []
        old_model = self.newest["model_version"] if self.newest else None
        entry = {
            "batch_id": batch_id,
            "model_version": version,
            "snapshots": versions,
            "snapshot_upto": upto,
        }
        row = self.spark.createDataFrame([tuple(entry.values())], COMMIT).coalesce(1)
        path = self._path("commits", "slot", batch_id % self._slots)
        row.write.mode("overwrite").parquet(path)
        self.newest = entry
        self.tail = tail
        if models is not None:
            self._models = models
        # Nothing refers to these any more.
        if old_model is not None and old_model != version:
            remove(self.spark, self._path("models", "version", old_model))
        for b, (old, new) in enumerate(zip(before, versions)):
            if old is not None and old != new:
                remove(self.spark, self._bucket_path(old, b))
