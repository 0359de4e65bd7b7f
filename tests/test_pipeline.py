"""Sources, sinks, the whole run on a hand-made file, views, the stream, and plan checks."""

import contextlib
import csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from tsrisk import names as N
from tsrisk.functions.cleaning import parse_ts
from tsrisk.names import AREA, COUNT, DATE, RAW_COLUMNS, TYPE
from tsrisk.operators import counts, features, panel, risk
from tsrisk.plans import quality, views
from tsrisk.plans.pipeline import Pipeline, Settings
from tsrisk.session import shared_dir, shuffles_sized_for
from tsrisk.sources import delimited, tables
from tsrisk.streaming.daily import daily_counts_stream, write_daily_counts

START = dt.date(2020, 1, 1)
DAYS = 230


# ---------------------------------------------------------------- delimited text
MESSY = """ID,Date,Note
1,01/02/2003 04:05:06 PM,"a ""quoted"" word"
2,01/02/2003 04:05:06 PM,"comma, inside"
3,01/02/2003 04:05:06 PM
4,01/02/2003 04:05:06 PM,plain,extra
5,,

6,x,"a, b",extra
"""


@pytest.fixture
def messy(tmp_path):
    path = tmp_path / "messy.csv"
    path.write_text(MESSY)
    return str(path)


def test_short_rows_are_padded_and_long_ones_set_aside(spark, messy):
    raw = delimited.read_raw(spark, messy)
    rows = [tuple(r) for r in delimited.usable_rows(raw).orderBy("ID").collect()]
    assert [(r[0], r[2]) for r in rows] == [("1", 'a "quoted" word'), ("2", "comma, inside"), ("3", None), ("5", None)]
    lines = sorted(r["line"] for r in delimited.quarantined_rows(raw).collect())
    assert lines == ["4,01/02/2003 04:05:06 PM,plain,extra", '6,x,"a, b",extra']
    assert delimited.usable_rows(raw).count() == 4 and delimited.quarantined_rows(raw).count() == 2


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "multi.csv"
    path.write_text('ID,Note\n1,"two\nlines"\n2,x\n')
    raw = delimited.read_raw(spark, str(path), multiline=True)
    assert [tuple(r) for r in delimited.usable_rows(raw).collect()] == [("1", "two\nlines"), ("2", "x")]


def test_every_line_is_used_or_set_aside(spark, tmp_path):
    """Two files with their columns in different orders, a very long quoted field, and quotes that stay open."""
    long = "x" * 10_000
    (tmp_path / "a.csv").write_text(f'ID,Date,Note\n1,d1,"{long}"\n2,d2,n2,extra\n3,d3\n')
    (tmp_path / "b.csv").write_text('ID,Note,Date\n4,n4,d4\n5,"two\nlines",d5\n')
    raw = delimited.read_raw(spark, f"{tmp_path}/*.csv", multiline=False)
    rows = {r["ID"]: (r["Date"], r["Note"]) for r in delimited.usable_rows(raw).collect()}
    assert rows == {"1": ("d1", long), "3": ("d3", None), "4": ("d4", "n4")}
    assert sorted(r["line"] for r in delimited.quarantined_rows(raw).collect()) == ["2,d2,n2,extra", '5,"two', 'lines",d5']


def test_unknown_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Note\n1,x\n")
    (tmp_path / "b.csv").write_text("ID,Other\n2,y\n")
    with pytest.raises(ValueError, match="does not match"):
        delimited.read_raw(spark, f"{tmp_path}/*.csv")


@pytest.mark.parametrize("zone", ["UTC", "America/Chicago"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.createDataFrame([("03/13/2022 02:30:00 AM", "01/05/2022 11:30:00 PM")], "a string, b string")
        times = row.select(parse_ts(F.col("a")).alias("a"), parse_ts(F.col("b")).alias(N.TIME))
        assert times.first()["a"] == dt.datetime(2022, 3, 13, 2, 30)
        day = daily_counts_stream(times).first()
        assert (day[DATE], day[COUNT]) == (dt.date(2022, 1, 5), 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_file_reports(spark, messy):
    assert delimited.preview_lines(spark, messy, 2, 5).collect()[0]["line"] == "ID,Da"
    assert delimited.file_profile(spark, messy).first()["bytes"] == len(MESSY)
    text = spark.createDataFrame([(i, line) for i, line in enumerate(MESSY.splitlines())], "n int, line string")
    profile = {r["delimiter"]: tuple(r)[1:] for r in delimited.delimiter_profile(text, "line", "n").collect()}
    assert profile[","] == (MESSY.count(","), 3) and profile["|"] == (0, 1)
    assert delimited.detect_delimiter(text, "line").first()["delimiter"] == ","
    assert [r[0] for r in delimited.describe(text).collect()] == ["n", "line"]


# ---------------------------------------------------------------- the whole run
@pytest.fixture(scope="module")
def raw_file(tmp_path_factory):
    """A small raw file: about ten incidents a day, some rows broken, the last day incomplete."""
    rng = random.Random(8)
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(RAW_COLUMNS)
    n = 0
    for i in range(DAYS):
        for _ in range(1 if i == DAYS - 1 else rng.randint(8, 14)):
            n += 1
            at = dt.datetime.combine(START, dt.time()) + dt.timedelta(days=i, hours=rng.randint(0, 23), minutes=5)
            row = dict.fromkeys(RAW_COLUMNS, "")
            row |= {
                "ID": n, "Case Number": f"C{n}", "Date": at.strftime("%m/%d/%Y %I:%M:%S %p"),
                "Primary Type": rng.choice(["THEFT", "BATTERY", "ARSON"]), "Arrest": "true", "Domestic": "False",
                "District": rng.choice(["001", "2", "31"]), "Latitude": f"41.{rng.randint(600, 999)}",
                "Longitude": f"-87.{rng.randint(500, 900)}", "Description": 'said "no", left',
            }
            writer.writerow([row[c] for c in RAW_COLUMNS])
    writer.writerow(["x", "y", "no date"])
    path = tmp_path_factory.mktemp("raw") / "raw.csv"
    path.write_text(out.getvalue())
    return str(path), n


@pytest.fixture(scope="module")
def run(spark, raw_file, tmp_path_factory):
    settings = Settings(start=START, areas=(1, 2), top_types=2, min_group=20, min_slot=1, trees=2, depth=2)
    pipeline = Pipeline(spark, str(tmp_path_factory.mktemp("out")), settings)
    pipeline.run(raw_file[0])
    return pipeline


def test_run_keeps_every_readable_row(run, raw_file):
    assert run.done["crimes_clean"].count() == raw_file[1]
    assert run.done["crimes_quarantined"].count() == 0
    assert run.done["citywide_daily_counts"].agg(F.sum(COUNT)).first()[0] == raw_file[1]
    assert run.end == START + dt.timedelta(days=DAYS - 2)  # the incomplete day is left out


def test_run_panels_and_forecasts(run):
    done, days = run.done, DAYS - 1
    assert done["citywide_model_ready"].count() == days
    assert done["district_model_ready"].count() == 2 * days
    assert done["district_crime_type_model_ready"].count() == 4 * days
    assert done["features_daily"].count() == 4 * (days - 30)
    assert done["boosted_detail_30day"].count() == 4 * 30
    assert {r["model_group"] for r in done["model_comparison_current"].collect()} == {"Baseline", "ARIMA", "SARIMA"}
    assert done["published_citywide_forecast"].count() == 30
    assert done["boosted_model_comparison"].count() == 3
    assert done["district_map_points"].where("latitude is not null").count() == 2


def test_published_files_read_back(spark, run):
    folder = f"{run.folder}/published"
    for name in N.OUTPUT_SCHEMAS:
        stored = tables.read_output(spark, folder, name)
        assert stored.count() == run.done[f"published_{name}"].count(), name
    summary = tables.read_summary(spark, f"{folder}/summary").first()
    assert summary["total_training_days"] == DAYS - 1
    assert summary["raw_data_end_date"] == str(START + dt.timedelta(days=DAYS - 1))
    assert summary["top_district_by_risk"]["district"] in (1, 2)
    ahead = run.done["published_citywide_forecast"]
    assert summary["forecast_30_day_total"] == ahead.agg(F.sum("predicted_crime_count")).first()[0]


def test_saved_model_predicts_the_same(spark, run):
    from pyspark.ml import PipelineModel

    model = PipelineModel.load(f"{run.folder}/boosted_trees/model")
    meta = tables.read_model_metadata(spark, f"{run.folder}/boosted_trees")
    assert meta["feature_columns"] == list(features.FEATURES) and meta["max_training_date"] == str(run.end)
    assert model.transform(run.done["model_table"]).where("boosted is null").count() == 0


def test_quality_report(run):
    done = run.done
    report = quality.quality_report(
        done["crimes_clean"], done["incident_cube"], done["high_risk_time_periods"],
        done["district_risk_summary"], {"crimes_clean": done["crimes_clean"], "gone": None},
    )
    sizes = {name: table.count() for name, table in report.items()}
    assert sizes["top_types"] == 3 and sizes["top_areas"] == 3 and sizes["latest_days"] == 15
    assert sizes["yearly_totals"] == 1 and sizes["row_counts"] == 2 and sizes["missing_values"] == 1
    assert report["date_range"].first()["unique_days"] == DAYS


# ---------------------------------------------------------------- views
def test_views_check_their_arguments(run):
    history, ahead = run.done["published_district_history"], run.done["published_citywide_forecast"]
    periods = run.done["published_high_risk_time_periods"]
    assert views.city_forecast(ahead, 7).count() == 7
    assert views.area_history(history, 2, 40).count() == 40
    for call in (
        lambda: views.city_forecast(ahead, 31),
        lambda: views.city_history(history, 29),
        lambda: views.risk_period_view(periods, limit=9),
        lambda: views.risk_period_view(periods, limit=501),
    ):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(LookupError):
        views.area_history(history, 77)
    with pytest.raises(LookupError):
        views.type_history(run.done["published_crime_type_history"], "no-such-type")


def test_area_detail_falls_back_to_all_types(run):
    area_map, periods = run.done["published_district_risk_map"], run.done["published_high_risk_time_periods"]
    assert views.area_detail(area_map, periods, 1, "NONE").count() == views.area_detail(area_map, periods, 1).count()
    only = views.area_detail(area_map, periods, 1, "THEFT").select(TYPE).distinct().collect()
    assert [r[0] for r in only] in (["THEFT"], [None]) or len(only) > 1


def test_table_or_and_save_table(spark):
    with pytest.raises(LookupError):
        tables.table_or(spark, "not_there_v2", "not_there")
    tables.register(spark.range(3), "there_v1")
    assert tables.table_or(spark, "not_there_v2", "there_v1").count() == 3
    saved = tables.save_table(spark.range(2), "tsrisk_saved")
    assert tables.save_table(spark.range(5), "tsrisk_saved").count() == 5 and saved.columns == ["id"]
    spark.sql("DROP TABLE tsrisk_saved")


# ---------------------------------------------------------------- stream
def test_stream_equals_batch_for_final_days(spark, folder, tmp_path):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    named = stream.select(F.col("ts").alias(N.TIME), F.col("event_type").alias(TYPE))
    query = write_daily_counts(daily_counts_stream(named, [TYPE]), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    final = spark.read.parquet(str(tmp_path / "out"))
    batch = counts.daily_counts(
        spark.read.parquet(f"{folder}/events.parquet").select(
            F.col("ts").cast("date").alias(N.DAY), F.col("event_type").alias(TYPE)), [TYPE])
    last = final.agg(F.max(DATE)).first()[0]
    want = sorted(map(tuple, batch.where(F.col(DATE) <= F.lit(last)).select(DATE, TYPE, COUNT).collect()))
    assert sorted(map(tuple, final.select(DATE, TYPE, COUNT).collect())) == want and want


# ---------------------------------------------------------------- plans
def plan_of(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_no_python_in_the_jvm_queries(spark, folder):
    from catalog.queries import QUERIES

    for name in ("daily_area_type", "risk_periods", "forecast_mean_area_type", "clean_table", "area_risk_recent"):
        plan = plan_of(QUERIES[name](spark, folder))
        assert "Python" not in plan and "Pandas" not in plan, name


def test_counts_prune_columns_and_push_filters(spark, run):
    stored = spark.read.parquet(f"{run.folder}/crimes_clean")
    plan = plan_of(counts.daily_counts(stored, [AREA]))
    assert "PushedFilters: [IsNotNull(crime_date), IsNotNull(district)]" in plan
    assert "ReadSchema: struct<crime_date:date,district:int>" in plan
    assert "partial_count" in plan


def test_date_cut_reaches_the_scan(run):
    daily = run.done["district_daily_counts"]
    plan = plan_of(risk.area_risk_recent(daily, run.end, run.start, (1, 2)))
    assert f"GreaterThan(date,{run.end - dt.timedelta(days=395)})" in plan


def test_lag_features_take_one_shuffle(run):
    plan = plan_of(features.lag_features(run.done["district_crime_type_model_ready"]), "simple")
    assert plan.count("Exchange hashpartitioning") == 1


def test_top_keys_need_no_full_sort(run):
    assert "TakeOrderedAndProject" in plan_of(counts.top_keys(run.done["crimes_clean"], TYPE, 5))


def test_grids_need_no_cross_join(spark, run):
    daily = run.done["district_crime_type_daily_counts"]
    keys = run.done["top_types"].select(TYPE)
    plan = plan_of(panel.panel(daily, run.end, run.start, keys, {AREA: (1, 2)}))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_shared_dir_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or shared_dir(spark))


def test_shuffles_grow_with_the_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    floor = int(before or spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_sized_for(spark, 1 << 20) as small:
        assert small == floor
    with shuffles_sized_for(spark, 4 << 40) as large:
        assert large == 8192 and spark.conf.get(key) == "8192"
    with shuffles_sized_for(spark, 100 << 40) as huge:
        assert huge == 204_800
    assert spark.conf.get(key, None) == before
