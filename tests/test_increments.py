"""The growing cube, and daily counts of a stream with corrections."""

from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from catalog import queries
from tsrisk.names import AREA, COUNT, DATE, TIME, TYPE
from tsrisk.operators.counts import incident_cube
from tsrisk.session import new_path
from tsrisk.sources import increments as I
from tsrisk.sources.adapters import incidents_orders, read_table
from tsrisk.streaming.daily import daily_counts_stream, upsert_daily_counts

DIMS = (AREA, TYPE)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture()
def made(spark, folder, tmp_path):
    """Incidents in files of three years' days, and a reader that notes what it reads."""
    base = incidents_orders(spark, folder)
    for n in range(3):
        base.where(F.pmod(F.hash(TIME), F.lit(3)) == n).coalesce(1).write.parquet(f"{tmp_path}/in/part [{n}]")
    seen = []

    def read(names):
        seen.append(len(names))
        return spark.read.parquet(*names)

    return base, f"{tmp_path}/in", f"{tmp_path}/store", read, seen


def parts(spark, folder, *numbers):
    return [f"{folder}/part \\[{n}\\]/*.parquet" for n in numbers]


def test_two_loads_equal_one_and_nothing_is_read_twice(spark, made):
    base, source, store, read, seen = made
    with pytest.raises(ValueError):
        I.stored_cube(spark, store)
    assert I.load_files(spark, store, parts(spark, source, 0), read, DIMS) == I.Load(1, 0, 0)
    assert I.load_files(spark, store, parts(spark, source, 0, 1, 2), read, DIMS) == I.Load(2, 1, 0)
    assert I.load_files(spark, store, parts(spark, source, 0, 1, 2), read, DIMS) == I.Load(0, 3, 0)
    assert seen == [1, 2]
    whole = rows(incident_cube(base, DIMS))
    assert rows(I.stored_cube(spark, store)) == whole
    I.compact(spark, store)
    assert rows(I.stored_cube(spark, store)) == whole and I.clean(spark, store) == 4 and rows(I.stored_cube(spark, store)) == whole
    assert I.load_files(spark, store, parts(spark, source, 0, 1, 2), read, DIMS) == I.Load(0, 3, 0)


def test_changed_and_missing_files_are_counted_anew(spark, made):
    base, source, store, read, seen = made
    I.load_files(spark, store, parts(spark, source, 0, 1), read, DIMS)
    I.load_files(spark, store, parts(spark, source, 0, 1, 2), read, DIMS)
    spark.read.parquet(*parts(spark, source, 0)).limit(7).write.mode("overwrite").parquet(f"{source}/part [0]")
    assert I.load_files(spark, store, parts(spark, source, 0, 1, 2), read, DIMS) == I.Load(2, 1, 2)
    assert rows(I.stored_cube(spark, store)) == rows(incident_cube(spark.read.parquet(*parts(spark, source, 0, 1, 2)), DIMS))
    assert I.load_files(spark, store, parts(spark, source, 0, 1), read, DIMS) == I.Load(0, 2, 1)
    assert rows(I.stored_cube(spark, store)) == rows(incident_cube(spark.read.parquet(*parts(spark, source, 0, 1)), DIMS))


def test_a_load_that_stops_changes_nothing(spark, made):
    base, source, store, read, _ = made
    I.load_files(spark, store, parts(spark, source, 0), read, DIMS)
    before = rows(I.stored_cube(spark, store))

    def broken(names):
        return read(names).withColumn(TYPE, F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        I.load_files(spark, store, parts(spark, source, 0, 1, 2), broken, DIMS)
    assert rows(I.stored_cube(spark, store)) == before
    # A manifest that was begun and not finished is neither read nor in the way.
    I.manifest(spark, store).write.parquet(f"{store}/manifest/2")
    (__import__("pathlib").Path(store) / "manifest/2/_SUCCESS").unlink()
    assert I.load_files(spark, store, parts(spark, source, 0, 1, 2), read, DIMS) == I.Load(2, 1, 0)
    assert rows(I.stored_cube(spark, store)) == rows(incident_cube(base, DIMS))


def test_two_loads_at_a_time_cannot_both_commit(spark, made, monkeypatch):
    _, source, store, read, _ = made

    def while_another_commits(names):
        monkeypatch.undo()
        I.load_files(spark, store, parts(spark, source, 1), read, DIMS)
        monkeypatch.setattr(I, "_entries", lambda *_: [])
        return read(names)

    with pytest.raises(AnalysisException):
        I.load_files(spark, store, parts(spark, source, 0), while_another_commits, DIMS)


def test_a_period_reaches_the_scan_of_the_loads(spark, made):
    _, source, store, read, _ = made
    I.load_files(spark, store, parts(spark, source, 0, 1, 2), read, DIMS)
    plan = I.stored_cube(spark, store).where(F.col(DATE) < "1995-01-01")._jdf.queryExecution().toString()
    assert "LessThan(date,1995-01-01)" in plan


def test_stream_upserts_open_days_and_late_rows(spark, tmp_path):
    def put(name, *times):
        df = spark.createDataFrame([(t, a) for t, a in times], "t string, district int").select(F.col("t").cast("timestamp_ntz").alias(TIME), AREA)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(f"{TIME} timestamp_ntz, {AREA} int").parquet(f"{tmp_path}/in")
        counts = daily_counts_stream(stream, [AREA], late="30 days")
        upsert_daily_counts(counts, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out").orderBy(DATE, AREA).collect()
        return [(str(r[DATE])[8:], r[AREA], r[COUNT]) for r in got]

    put("a", ("2020-01-01 10:00:00", 1), ("2020-01-01 11:00:00", 2), ("2020-01-02 01:00:00", 1))
    assert run() == [("01", 1, 1), ("01", 2, 1), ("02", 1, 1)]
    put("b", ("2020-01-01 23:00:00", 1), ("2020-01-03 01:00:00", 3), ("2020-01-03 02:00:00", None))
    assert run() == [("01", 1, 2), ("01", 2, 1), ("02", 1, 1), ("03", 3, 1)]
    # Nothing new, nothing changed.
    assert run() == [("01", 1, 2), ("01", 2, 1), ("02", 1, 1), ("03", 3, 1)]


def test_batches_of_a_replay_do_not_grow_with_its_files(spark, folder, tmp_path, monkeypatch):
    for name, files in (("orders", 12), ("customer", 1)):
        read_table(spark, folder, name).repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
    made = {}
    monkeypatch.setattr(queries, "new_path", lambda spark, name: made.setdefault(name, new_path(spark, name)))
    days = queries.QUERIES["daily_area_replayed"](spark, str(tmp_path))
    assert rows(days) == rows(queries.QUERIES["daily_area"](spark, folder))
    assert len(list(Path(made["replay"]).rglob("*.parquet"))) >= 40
    assert len(list(Path(f"{made['replay-state']}/commits").glob("[0-9]*"))) == 3
