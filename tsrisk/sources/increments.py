"""An incident cube that grows with its files: a load reads only the files that no load has counted yet.

A store is a folder. `loads/<id>` holds the cube of the files of one load, `manifest/<n>` names for every file the
load that counted it. A load shows only once its manifest is whole, so one that stops half-way changes nothing and
can be run again; two at the same time want the same manifest, and the second one fails.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tsrisk.names import AREA, COUNT, DATE, HOUR, TYPE
from tsrisk.operators.counts import incident_cube
from tsrisk.session import stage, unstage

#: What tells one state of a file from another.
STATE = ("path", "length", "modified")
_MANIFEST = "path string, length long, modified timestamp, load string"


class Load(NamedTuple):
    """What a load did: files it read, files it left as counted, files whose counts it took out."""

    read: int
    kept: int
    dropped: int


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """`path, length, modified` of the files at `paths`, which may be patterns; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def _exact(path: str) -> str:
    """A path that stands for itself where patterns are allowed."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _entries(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """Names in a folder, and whether each holds a table that was written whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(folder)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.listStatus(target) if system.exists(target) else []
    return [(s.getPath().getName(), system.exists(hadoop.Path(s.getPath(), "_SUCCESS"))) for s in found]


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """`path, length, modified, load` of every file that counts; empty for a store that has no load yet."""
    whole = [int(name) for name, done in _entries(spark, f"{store}/manifest") if done]
    if not whole:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{store}/manifest/{max(whole)}")


def _commit(spark: SparkSession, store: str, files: DataFrame) -> None:
    number = max((int(name) for name, _ in _entries(spark, f"{store}/manifest")), default=0) + 1
    files.select(*STATE, "load").write.mode("error").parquet(f"{store}/manifest/{number}")


def _write(store: str, counted: DataFrame) -> str:
    """A load's cube, its files sorted by day, so that a period reads only the row groups it touches."""
    load = uuid.uuid4().hex
    counted.sortWithinPartitions(DATE).write.parquet(f"{store}/loads/{load}")
    return load


def load_files(
    spark: SparkSession, store: str, paths: list[str], read: Callable[[list[str]], DataFrame], dims=(AREA, TYPE, HOUR)
) -> Load:
    """Bring a store up to the files now at `paths`; `read` makes incidents from the names of files.

    New files are counted into a load of their own. If a file has changed or is gone, its load no longer counts, and
    the other files of that load are read again with the new ones. A file that changes while it is read is
    known by its older state and so read again next time. `dims` stay the same for all loads of a store. The
    driver holds the names of the files to be read, as any read of files does, and no counts.
    """
    files = stage(list_files(spark, *paths), "files")
    known = manifest(spark, store)
    stale = known.join(files, list(STATE), "left_anti").select("load").distinct()
    valid = stage(known.join(stale, "load", "left_anti"), "valid")
    new = stage(files.join(valid, list(STATE), "left_anti"), "new")
    names = [r.path for r in new.select("path").collect()]
    kept, before = valid.count(), known.count()
    if names or kept < before:
        load = _write(store, incident_cube(read([_exact(n) for n in names]), dims)) if names else ""
        _commit(spark, store, valid.select(*STATE, "load").unionByName(new.select(*STATE, F.lit(load).alias("load"))))
    unstage(files, valid, new)
    return Load(len(names), kept, before - kept)


def _loads(spark: SparkSession, store: str) -> list[str]:
    return sorted(r.load for r in manifest(spark, store).select("load").distinct().collect())


def stored_cube(spark: SparkSession, store: str) -> DataFrame:
    """The counts of all files of a store, one row per day and group, as `incident_cube` gives them.

    It reads the loads' cubes alone; filters on the day reach their scan.
    """
    loads = _loads(spark, store)
    if not loads:
        raise ValueError(f"{store} holds no load")
    parts = spark.read.parquet(*[f"{store}/loads/{load}" for load in loads])
    return parts.groupBy(*[c for c in parts.columns if c != COUNT]).agg(F.sum(COUNT).alias(COUNT))


def compact(spark: SparkSession, store: str) -> None:
    """Make all loads one, so that readers sum less; a file that changes later has them all counted again."""
    if len(_loads(spark, store)) > 1:
        load = _write(store, stored_cube(spark, store))
        _commit(spark, store, manifest(spark, store).withColumn("load", F.lit(load)))


def clean(spark: SparkSession, store: str) -> int:
    """Delete loads and manifests that no longer count, when nobody reads or loads; the number of folders deleted."""
    named, numbers = set(_loads(spark, store)), _entries(spark, f"{store}/manifest")
    newest = max((int(name) for name, done in numbers if done), default=0)
    old = [f"{store}/loads/{name}" for name, _ in _entries(spark, f"{store}/loads") if name not in named]
    old += [f"{store}/manifest/{name}" for name, _ in numbers if int(name) != newest]
    for folder in old:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(old)
