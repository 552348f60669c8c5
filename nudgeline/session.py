"""Session building and the shared working folder."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "nudgeline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tested with.

    How many partitions a shuffle has at most is for the caller to set by the size of the input
    (``spark.sql.shuffle.partitions``); AQE merges small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Call sites of column expressions cost more than building the plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def observed(seen: Observation) -> dict[str, int]:
    """Numbers observed in a job that has run; none where the optimizer saw beforehand that there are
    no rows, as the observation went with them."""
    try:
        return seen.get
    except Py4JJavaError as error:
        if error.java_exception.getClass().getName() == "java.lang.AssertionError":
            return {}
        raise


def file_system(path: str):
    """Arrow's file system of a path, as tasks reach it, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, wherever it lies; nothing happens when it is not there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def working_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables, named in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine takes a folder in its warehouse; a cluster must name
    one that all executors reach.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors reach")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return folder.rstrip("/")
