"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tsrisk", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package relies on; on a cluster leave `master` out."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: `spark.checkpoint.dir`, or the checkpoint folder set on the context.

    Only a local session, where driver and tasks share one disk, gets a
    temporary folder when neither is set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = context.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="tsrisk-")
    return _local_dirs[application]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used for aggregates that several later steps read: the fact table behind
    them is scanned once, a lost executor costs no re-scan, the lineage is cut,
    and the file sizes give the optimizer true statistics, so it decides by
    size which join side to broadcast.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def unstage(*staged: DataFrame) -> None:
    """Remove tables that `stage` wrote, once no later step reads them."""
    for df in staged:
        if path := getattr(df, "_staged_path", None):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's part of the shared folder."""
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


_run_dirs: dict[str, str] = {}


def _run_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder; the file system removes it when the driver ends."""
    application = spark.sparkContext.applicationId
    if application not in _run_dirs:
        path = f"{shared_dir(spark)}/tsrisk/{application}"
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(target)
        system.deleteOnExit(target)
        _run_dirs[application] = path
    return _run_dirs[application]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative library code checkpoint to the shared folder as well."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))


_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@contextmanager
def shuffles_sized_for(spark: SparkSession, input_bytes: int, per_partition: int = 512 << 20) -> Iterator[int]:
    """Start shuffles with a partition count that fits the input; adaptive execution merges small ones.

    Counting shrinks rows before they are shuffled, hence half a gigabyte of
    input per partition. Adaptive execution cannot split partitions that are all
    too large, so the count has to be high enough from the start.
    """
    before = spark.conf.get(_INITIAL_PARTITIONS, None)
    floor = int(before or spark.conf.get("spark.sql.shuffle.partitions"))
    count = max(floor, -(-input_bytes // per_partition))
    spark.conf.set(_INITIAL_PARTITIONS, str(count))
    try:
        yield count
    finally:
        if before is None:
            spark.conf.unset(_INITIAL_PARTITIONS)
        else:
            spark.conf.set(_INITIAL_PARTITIONS, before)
