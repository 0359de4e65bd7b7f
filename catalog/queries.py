"""Every registered query: (session, table folder) -> DataFrame over the whole tables."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import rawtext
from tsrisk.functions import cleaning as C, dates as D, scoring as S
from tsrisk.names import AREA, COUNT, DATE, DOW, HOUR, RAW_COLUMNS, TIME, TYPE, VALID_AREAS
from tsrisk.operators import arima, boosted, counts, features, forecast, metrics, panel, risk, sketches
from tsrisk.operators.centroids import centroids
from tsrisk.plans import pipeline, present, quality, views
from tsrisk.plans.clean import clean_incidents
from tsrisk.session import new_path, stage
from tsrisk.sources import delimited, increments, tables
from tsrisk.sources.adapters import incidents_events, incidents_lineitem, incidents_orders, read_table
from tsrisk.streaming.daily import daily_counts_stream, upsert_daily_counts

# Sizes that fit the sample tables: five types, small groups, coordinates that are amounts.
TOP, MIN_GROUP, MIN_SLOT = 4, 60, 2
BOX = {"latitude_box": (50_000, 450_000), "longitude_box": (-500, 9_000)}


_FITTED: dict[tuple, tuple] = {}


@dataclass
class Counted:
    """Incidents with their staged count cube: the fact table is read once."""

    incidents: DataFrame
    dims: tuple[str, ...]

    @cached_property
    def cube(self) -> DataFrame:
        return stage(counts.incident_cube(self.incidents, self.dims), "cube")

    @cached_property
    def bounds(self) -> tuple[dt.date, dt.date]:
        return panel.calendar_bounds(self.daily())

    @property
    def start(self) -> dt.date:
        return self.bounds[0]

    @property
    def end(self) -> dt.date:
        return self.bounds[1]

    def daily(self, *keys: str) -> DataFrame:
        return counts.roll_up_days(self.cube, keys)

    def until_end(self) -> DataFrame:
        return self.cube.where(F.col(DATE) <= F.lit(self.end))

    def top_types(self) -> DataFrame:
        return counts.top_keys(self.until_end(), TYPE, TOP).select(TYPE)

    def panel(self, *keys: str) -> DataFrame:
        types = self.top_types() if TYPE in keys else None
        extra = {AREA: VALID_AREAS} if AREA in keys else None
        return panel.panel(self.daily(*keys), self.end, self.start, types, extra)

    @cached_property
    def detail(self) -> DataFrame:
        """The mean forecast of every area and type."""
        return stage(
            forecast.iterative_mean_forecast(self.panel(AREA, TYPE), (AREA, TYPE), end=self.end, model=None), "detail"
        )

    def forecast_risk(self, key: str) -> DataFrame:
        totals = forecast.forecast_totals(self.detail, [key])
        baseline = risk.baseline_30(self.daily(key), [key], self.end, self.start, among=totals)
        return risk.forecast_risk(totals, baseline, [key])

    def map_points(self) -> DataFrame:
        return risk.map_points(self.forecast_risk(AREA), centroids(self.incidents, **BOX))

    def area_map(self) -> DataFrame:
        return present.present_area_map(self.map_points())

    def type_risk(self) -> DataFrame:
        return present.present_type_risk(self.forecast_risk(TYPE))

    @cached_property
    def dense(self) -> DataFrame:
        return stage(self.panel(AREA, TYPE), "panel")

    @cached_property
    def codes(self) -> DataFrame:
        return features.category_codes(self.top_types())

    def gbt(self):
        """The boosted-tree model and its test days; queries of one session share the fit while the files stay the same."""
        spark = self.incidents.sparkSession
        files = spark.read.format("binaryFile").load(list(self.incidents.inputFiles()))
        states = files.select("path", F.col("modificationTime").cast("string"), "length").orderBy("path").collect()
        key = (spark.sparkContext.applicationId, *map(tuple, states))
        if key not in _FITTED:
            table = stage(boosted.model_table(features.lag_features(self.dense), self.codes), "model-table")
            train, test = boosted.train_test(table, self.end)
            _FITTED[key] = boosted.fit_gbt(train), test
        return _FITTED[key]

    def gbt_forecast(self) -> DataFrame:
        return boosted.recursive_forecast(self.gbt()[0], self.dense, self.codes, self.end)

    def selected(self) -> DataFrame:
        city = self.panel()
        board = forecast.leaderboard({"Baseline": forecast.baseline_leaderboard(city)})
        return forecast.select_forecast(board, {"Baseline": forecast.iterative_mean_forecast(city, end=self.end)})

    def periods(self) -> DataFrame:
        slots = counts.slot_counts(self.until_end())
        return risk.risk_periods_supported(slots, self.top_types(), min_group=MIN_GROUP, min_slot=MIN_SLOT)


def orders(spark, folder, *dims) -> Counted:
    return Counted(incidents_orders(spark, folder), dims)


def events(spark, folder, *dims) -> Counted:
    return Counted(incidents_events(spark, folder), dims or (AREA, TYPE, HOUR))


def raw_text(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as raw-file text."""
    def fmt(pattern):
        return f"date_format(ts, '{pattern}')"

    cols = rawtext.raw_columns(
        fmt("MM/dd/yyyy hh:mm:ss a"), fmt("M/d/yyyy h:mm:ss a"), fmt("yyyy-MM-dd HH:mm:ss")
    )
    return read_table(spark, folder, "events").selectExpr(*[f"{sql} AS `{name}`" for name, sql in cols.items()])


QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- counts and panels
@query
def daily_city(spark, folder):
    return counts.daily_counts(incidents_orders(spark, folder))


@query
def daily_area(spark, folder):
    return counts.daily_counts(incidents_orders(spark, folder), [AREA])


@query
def daily_type(spark, folder):
    return counts.daily_counts(incidents_orders(spark, folder), [TYPE])


@query
def daily_area_type(spark, folder):
    return counts.daily_counts(incidents_orders(spark, folder), [AREA, TYPE])


@query
def daily_area_lineitem(spark, folder):
    return counts.daily_counts(incidents_lineitem(spark, folder), [AREA])


@query
def daily_from_cube(spark, folder):
    """All four daily levels from one pass over the incidents."""
    base = orders(spark, folder, AREA, TYPE)
    parts = []
    for level, keys in {"city": (), "area": (AREA,), "type": (TYPE,), "area_type": (AREA, TYPE)}.items():
        shown = [F.col(k) if k in keys else F.lit(None).cast(t).alias(k) for k, t in ((AREA, "int"), (TYPE, "string"))]
        parts.append(base.daily(*keys).select(F.lit(level).alias("level"), DATE, *shown, COUNT))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _in_files(incidents: DataFrame, path: str, files: int = 8) -> list[str]:
    """All incidents, dealt over folders by a hash of the row; the folders."""
    number = F.pmod(F.xxhash64(*incidents.columns), F.lit(files)).alias("file")
    incidents.select("*", number).write.partitionBy("file").parquet(path)
    return [f"{path}/file={n}" for n in range(files)]


@query
def cube_in_two_loads(spark, folder):
    """Files of one half of the incidents, then those of all: the cube of the store, and what the second load read."""
    store = new_path(spark, "store")
    files = _in_files(incidents_orders(spark, folder), new_path(spark, "incidents"))
    read = lambda names: spark.read.parquet(*names)
    increments.load_files(spark, store, files[:4], read, (AREA, TYPE))
    first = increments.manifest(spark, store).select("path")
    increments.load_files(spark, store, files, read, (AREA, TYPE))
    known = increments.manifest(spark, store)
    second = known.join(first, "path", "left_anti").select("load").distinct()
    again = known.join(second, "load", "left_semi").join(first, "path", "left_semi").count()
    return increments.stored_cube(spark, store).withColumn("files_read_again", F.lit(again).cast("bigint"))


@query
def daily_area_replayed(spark, folder):
    """A replay of the incidents in three batches, in no order of days: open days and late rows are in the counts."""
    path, out = new_path(spark, "replay"), new_path(spark, "days")
    incidents = incidents_orders(spark, folder).select(TIME, AREA)
    folders = _in_files(incidents, path)
    # Every task of the write leaves a part in each folder. A batch takes as many parts as three folders hold: it
    # writes every month anew, so the batches must not grow in number with the input.
    parts = spark.read.schema(incidents.schema).option("recursiveFileLookup", True).parquet(path).inputFiles()
    share = max(3, -(-3 * len(parts) // len(folders)))
    stream = spark.readStream.schema(incidents.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", share).parquet(path)
    counted = daily_counts_stream(stream, [AREA], late="36500 days")
    upsert_daily_counts(counted, out, new_path(spark, "replay-state")).awaitTermination()
    return spark.read.schema(", ".join(f"{n} {k}" for n, k in [*counted.dtypes, ("month", "string")])).parquet(out).drop("month")


@query
def safe_end_date(spark, folder):
    return panel.safe_end_date(counts.daily_counts(incidents_orders(spark, folder)))


@query
def rolling_median(spark, folder):
    return panel.rolling_median(counts.daily_counts(incidents_orders(spark, folder)))


@query
def calendar_days(spark, folder):
    base = orders(spark, folder)
    return panel.calendar(spark, base.start, base.end)


@query
def future_days(spark, folder):
    return panel.future_calendar(spark, orders(spark, folder).end, 30)


@query
def panel_city(spark, folder):
    return orders(spark, folder).panel()


@query
def panel_area(spark, folder):
    return orders(spark, folder, AREA).panel(AREA)


@query
def panel_type(spark, folder):
    return orders(spark, folder, TYPE).panel(TYPE)


@query
def panel_area_type(spark, folder):
    return orders(spark, folder, AREA, TYPE).panel(AREA, TYPE)


@query
def area_risk_recent(spark, folder):
    base = orders(spark, folder, AREA)
    return risk.area_risk_recent(base.daily(AREA), base.end, base.start)


# ---------------------------------------------------------------- text and cleaning
@query
def scan_delimited(spark, folder):
    """Write the events as raw text, scan the file again, and keep what comes back."""
    path = new_path(spark, "raw")
    raw_text(spark, folder).write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")
    rows = delimited.usable_rows(delimited.read_raw(spark, path))
    return rows.select(
        F.col("`Case Number`").alias("case_number"), F.col("Description").alias("description"),
        F.col("Location").alias("location"), F.col("IUCR").alias("iucr"), F.col("Block").alias("block"),
    )


@query
def raw_line_accounts(spark, folder):
    """Raw text of two column orders with long, short and broken rows: each line is clean, dropped or set aside."""
    events = read_table(spark, folder, "events")
    path = new_path(spark, "lines")
    for order, header in enumerate(("ID,Date,Note", "ID,Note,Date")):
        lines = events.where(f"event_id % 2 = {order}").select(F.explode(F.expr(rawtext.raw_lines(order))).alias(header))
        # One column, no quotes and a separator that never occurs: the lines are written as they are.
        lines.write.csv(f"{path}/{order}", header=True, quote="", sep="\u0001", escape="\u0002")
    raw = delimited.read_raw(spark, f"{path}/*", multiline=False)
    stamped = C.parse_ts(F.col("Date")).isNotNull()
    outcome = F.when(stamped, "clean").otherwise("dropped").alias("outcome")
    kept = delimited.usable_rows(raw).select(outcome).unionByName(
        delimited.quarantined_rows(raw).select(F.lit("set aside").alias("outcome"))
    )
    return kept.groupBy("outcome").agg(F.count(F.lit(1)).alias("lines"))


@query
def raw_records(spark, folder):
    """Write the events with notes of up to many lines, blank ones and quotes among them, and read them back split by split."""
    path = new_path(spark, "records")
    rows = read_table(spark, folder, "events").select(F.expr(rawtext.RECORD).alias("value"))
    header = spark.createDataFrame([("ID,Note,User",)], "value string")
    header.unionByName(rows).coalesce(1).write.text(path)
    raw = delimited.usable_rows(delimited.read_raw(spark, path))
    note = F.col("Note")
    return raw.select(
        F.col("ID").cast("bigint").alias("event_id"), F.col("User").cast("bigint").alias("user_id"), F.md5(note).alias("digest"),
        (F.length(note) - F.length(F.replace(note, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
    )


@query
def parse_timestamps(spark, folder):
    raw = raw_text(spark, folder)
    return raw.select(F.col("`Case Number`").alias("case_number"), C.parse_ts(F.col("Date")).alias(TIME))


@query
def clean_numbers(spark, folder):
    raw = raw_text(spark, folder)
    ward = F.col("Ward")
    return raw.select(
        F.col("`Case Number`").alias("case_number"),
        C.clean_int(ward).alias("as_int"),
        C.clean_long(ward).alias("as_long"),
        C.clean_double(ward).alias("as_double"),
    )


@query
def clean_booleans(spark, folder):
    raw = raw_text(spark, folder)
    return raw.select(
        F.col("`Case Number`").alias("case_number"),
        C.clean_bool(F.col("Arrest")).alias("arrest"),
        C.clean_bool(F.col("Domestic")).alias("domestic"),
    )


@query
def clean_table(spark, folder):
    return clean_incidents(raw_text(spark, folder).select(*[f"`{c}`" for c in RAW_COLUMNS]))


@query
def delimiter_profile(spark, folder):
    return delimited.delimiter_profile(read_table(spark, folder, "documents"), "text", "doc_id")


@query
def delimiter_consistency(spark, folder):
    return delimited.delimiter_consistency(read_table(spark, folder, "documents"), "text")


@query
def detect_delimiter(spark, folder):
    return delimited.detect_delimiter(read_table(spark, folder, "documents"), "text")


@query
def date_parts(spark, folder):
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    parts = ("hour", "day", "month", "year", "day_of_week", "week_of_year", "is_weekend")
    return D.with_date_parts(lines, "l_shipdate", parts).drop("l_shipdate")


@query
def text_functions(spark, folder):
    """First non-empty text, normalised match, ISO date and finite numbers."""
    found = read_table(spark, folder, "events")
    blank = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    ratio = F.when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).when(
        F.col("event_id") % 5 == 1, F.lit(float("nan"))
    ).otherwise(F.col("value"))
    shown = found.select(
        "event_id",
        S.first_nonempty(blank, F.lit(""), F.lit("unknown")).alias("label"),
        S.match_label(F.col("event_type"), "Purchase").alias("is_purchase"),
        D.iso_date(F.col("ts")).alias("iso_date"),
        ratio.alias("ratio"),
        S.clamp_zero(F.col("value") - 50).alias("above_fifty"),
    )
    return S.finite_or_null(shown).withColumn("above_fifty", F.round("above_fifty", 6))


# ---------------------------------------------------------------- slots and risk
@query
def slot_counts(spark, folder):
    return counts.slot_counts(incidents_events(spark, folder))


@query
def group_stats(spark, folder):
    stats = risk.group_stats(counts.slot_counts(incidents_events(spark, folder)))
    return stats.withColumn("avg_slot_count", F.round("avg_slot_count", 6))


@query
def risk_periods(spark, folder):
    return risk.risk_periods(counts.slot_counts(incidents_events(spark, folder)))


@query
def risk_periods_supported(spark, folder):
    return events(spark, folder).periods()


@query
def area_risk_history(spark, folder):
    base = orders(spark, folder, AREA)
    return risk.area_risk_history(base.cube, features.latest_date(base.cube))


@query
def risk_labels(spark, folder):
    slots = risk.risk_periods(counts.slot_counts(incidents_events(spark, folder)))
    percent = F.col(risk.SLOT_RISK)
    return slots.select(
        AREA, TYPE, DOW, HOUR,
        S.slot_band(percent).alias("slot_level"),
        S.band(percent).alias("area_level"),
        S.direction(percent).alias("risk_direction"),
        S.confidence(F.col(COUNT), 3).alias("risk_confidence"),
        D.day_name(F.col(DOW)).alias("day_name"),
        D.hour_label(F.col(HOUR)).alias("hour_label"),
    )


@query
def area_centroids(spark, folder):
    return centroids(incidents_orders(spark, folder), **BOX).select(
        AREA, F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude")
    )


@query
def area_centroids_lineitem(spark, folder):
    box = {"latitude_box": (0, 120_000), "longitude_box": (-1_000, 10_000)}
    return centroids(incidents_lineitem(spark, folder), **box).select(
        AREA, F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude")
    )


def _priced_lines(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    return lines.select(F.col("l_shipdate").cast("date").alias(DATE), "l_returnflag", "l_orderkey", "l_extendedprice")


@query
def distinct_orders_by_year(spark, folder):
    """Orders per flag and year from united daily sketches, held against the exact count, and against the sum of the days."""
    lines = _priced_lines(spark, folder)
    cube = stage(sketches.sketch_cube(lines, ["l_returnflag"], members=["l_orderkey"]), "sketch-cube")
    keys = ["l_returnflag", F.year(DATE).alias("year")]
    exact = lines.groupBy(*keys).agg(F.countDistinct("l_orderkey").alias("orders"))
    united = sketches.distinct_members(cube, "l_orderkey", keys)
    days = cube.groupBy(*keys).agg(F.sum(F.hll_sketch_estimate("members_l_orderkey")).alias("summed"))
    found = exact.join(united, ["l_returnflag", "year"]).join(days, ["l_returnflag", "year"])
    estimate = F.col("distinct_l_orderkey")
    return found.select(
        "l_returnflag", "year", "orders", (F.abs(estimate - F.col("orders")) <= 0.05 * F.col("orders") + 1).alias("close"),
        (estimate <= F.col("summed")).alias("no_more_than_the_days"),
    )


@query
def median_price_by_year(spark, folder):
    """Median price per flag and year from merged daily sketches: is its rank within two percent of the middle?"""
    lines = _priced_lines(spark, folder)
    cube = stage(sketches.sketch_cube(lines, ["l_returnflag"], measures=["l_extendedprice"]), "sketch-cube")
    keys = ["l_returnflag", F.year(DATE).alias("year")]
    middle = sketches.quantiles(cube, "l_extendedprice", keys).withColumnRenamed("l_extendedprice", "median")
    ranked = lines.withColumn("year", F.year(DATE)).join(middle, ["l_returnflag", "year"]).groupBy("l_returnflag", "year").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_extendedprice") < F.col("median")).alias("below"),
        F.count_if(F.col("l_extendedprice") <= F.col("median")).alias("upto"),
    )
    close = (F.col("below") <= 0.52 * F.col("n_lines")) & (F.col("upto") >= 0.48 * F.col("n_lines"))
    return ranked.select("l_returnflag", "year", "n_lines", close.alias("close"))


@query
def latest_rows_area(spark, folder):
    return features.tail_rows(counts.daily_counts(incidents_orders(spark, folder), [AREA]), [AREA], 5)


@query
def key_cardinality(spark, folder):
    return counts.key_cardinality(incidents_orders(spark, folder))


@query
def key_combinations(spark, folder):
    return counts.key_combinations(incidents_orders(spark, folder))


@query
def top_types(spark, folder):
    return counts.top_keys(incidents_orders(spark, folder).select(TYPE), TYPE, 3)


@query
def top_areas(spark, folder):
    return counts.top_keys(incidents_orders(spark, folder).select(AREA), AREA, 10)


# ---------------------------------------------------------------- features and simple forecasts
@query
def lag_features(spark, folder):
    table = features.lag_features(orders(spark, folder, AREA, TYPE).panel(AREA, TYPE))
    return table.withColumns({c: F.round(c, 6) for c in ("rolling_mean_7", "rolling_mean_30", "rolling_std_7")})


@query
def lag_features_sparse(spark, folder):
    """The features of `lag_features`, from the days that have counts."""
    base = orders(spark, folder, AREA, TYPE)
    dense = panel.sparse_panel(base.daily(AREA, TYPE), base.end, base.start, base.top_types(), {AREA: VALID_AREAS})
    table = features.lag_features(dense)
    return table.withColumns({c: F.round(c, 6) for c in ("rolling_mean_7", "rolling_mean_30", "rolling_std_7")})


def _stored_series(spark, folder) -> tuple[Counted, str]:
    """Counts of each area and type, stored in buckets of the series."""
    base = orders(spark, folder, AREA, TYPE)
    rows = panel.series_rows(base.daily(AREA, TYPE), base.end, base.start, base.top_types(), {AREA: VALID_AREAS})
    name = f"series_{uuid.uuid4().hex}"
    tables.save_buckets(rows, name, (AREA, TYPE), (DATE,))
    return base, name


@query
def lag_features_stored(spark, folder):
    """The features of `lag_features`, from a table in buckets of the series."""
    base, name = _stored_series(spark, folder)
    table = features.lag_features(panel.stored_panel(spark, name, base.end, (AREA, TYPE)))
    return table.withColumns({c: F.round(c, 6) for c in ("rolling_mean_7", "rolling_mean_30", "rolling_std_7")})


@query
def forecast_mean_stored(spark, folder):
    """The forecast of `forecast_mean_area_type`, fitted where the stored series are read."""
    base, name = _stored_series(spark, folder)
    dense = panel.stored_panel(spark, name, base.end, (AREA, TYPE))
    return forecast.iterative_mean_forecast(dense, (AREA, TYPE), end=base.end, model=None)


@query
def rolling_full_window(spark, folder):
    series = orders(spark, folder, AREA).panel(AREA)
    both = {f"mean_{n}": F.round(features.rolling([AREA], COUNT, n, full=True), 6) for n in (7, 30)}
    return series.select(DATE, AREA, COUNT, *[c.alias(name) for name, c in both.items()])


@query
def chrono_split(spark, folder):
    series = orders(spark, folder, AREA).panel(AREA).select(DATE, AREA, COUNT)
    split = features.chrono_split(series, [AREA])
    return split.groupBy("is_test", AREA).agg(
        F.count("*").alias("days"), F.min(DATE).alias("first_date"), F.sum(COUNT).alias(COUNT)
    )


@query
def baseline_predictions(spark, folder):
    predicted = forecast.baseline_predictions(orders(spark, folder).panel())
    return predicted.withColumns({c: F.round(c, 6) for c in ("pred_rolling_7", "pred_rolling_30")})


@query
def baseline_metrics(spark, folder):
    return forecast.baseline_leaderboard(orders(spark, folder).panel())


@query
def baseline_metrics_area(spark, folder):
    return forecast.baseline_leaderboard(orders(spark, folder, AREA).panel(AREA), [AREA])


@query
def baseline_best(spark, folder):
    return forecast.best_model(forecast.baseline_leaderboard(orders(spark, folder).panel()))


@query
def baseline_test_predictions(spark, folder):
    shown = forecast.baseline_test_predictions(orders(spark, folder).panel())
    floats = [c for c, t in shown.dtypes if t == "double"]
    return shown.withColumns({c: F.round(c, 6) for c in floats})


@query
def category_codes(spark, folder):
    return features.category_codes(orders(spark, folder, TYPE).cube)


@query
def series_totals(spark, folder):
    """Ordered value list per series, shown by its length, ends and sum."""
    base = orders(spark, folder, AREA)
    arrays = features.series_arrays(base.panel(AREA), [AREA], last=30, end=base.end)
    values = F.col("history")
    return arrays.select(
        AREA,
        F.size(values).cast("bigint").alias("days"),
        F.element_at(values, 1).alias("first_value"),
        F.element_at(values, -1).alias("last_value"),
        forecast.array_sum(values).alias("total"),
    )


@query
def forecast_mean_city(spark, folder):
    base = orders(spark, folder)
    return forecast.iterative_mean_forecast(base.panel(), end=base.end)


@query
def forecast_mean_area_type(spark, folder):
    return orders(spark, folder, AREA, TYPE).detail


@query
def forecast_rollup_area(spark, folder):
    return forecast.forecast_rollup(orders(spark, folder, AREA, TYPE).detail, [AREA])


@query
def forecast_rollup_type(spark, folder):
    return forecast.forecast_rollup(orders(spark, folder, AREA, TYPE).detail, [TYPE])


@query
def forecast_rollup_week(spark, folder):
    detail = orders(spark, folder, AREA, TYPE).detail
    return forecast.first_days(forecast.forecast_rollup(detail), 7)


@query
def forecast_totals_area(spark, folder):
    return forecast.forecast_totals(orders(spark, folder, AREA, TYPE).detail, [AREA])


@query
def forecast_risk_area(spark, folder):
    return orders(spark, folder, AREA, TYPE).forecast_risk(AREA)


@query
def forecast_risk_type(spark, folder):
    return orders(spark, folder, AREA, TYPE).forecast_risk(TYPE)


@query
def map_points(spark, folder):
    points = orders(spark, folder, AREA, TYPE).map_points()
    return points.withColumns({c: F.round(c, 4) for c in ("latitude", "longitude")})


@query
def leaderboard_baseline(spark, folder):
    """The best simple predictor of every area, of those that repeat a day and of those that average."""
    models = stage(forecast.baseline_leaderboard(orders(spark, folder, AREA).panel(AREA), [AREA]), "models")
    repeats = F.col("model").isin([label for column, label in forecast.BASELINES.items() if "lag" in column])
    groups = {"Repeats": models.where(repeats).withColumn("note", F.lit("only here")), "Means": models.where(~repeats)}
    return forecast.leaderboard(groups, [AREA])


@query
def selected_forecast(spark, folder):
    return present.present_forecast(orders(spark, folder).selected())


@query
def selected_week(spark, folder):
    return present.present_forecast(orders(spark, folder).selected(), 7)


# ---------------------------------------------------------------- presentation and quality
@query
def present_area_map(spark, folder):
    shown = orders(spark, folder, AREA, TYPE).area_map()
    return shown.withColumns({c: F.round(c, 4) for c in ("latitude", "longitude")})


@query
def present_type_risk(spark, folder):
    return orders(spark, folder, AREA, TYPE).type_risk()


@query
def present_periods_top500(spark, folder):
    return present.present_periods(events(spark, folder).periods())


@query
def present_history_area(spark, folder):
    return present.present_history(orders(spark, folder, AREA).panel(AREA), [AREA])


def _flat(whole: DataFrame) -> DataFrame:
    """The summary with its two nested records as plain columns."""
    area, kind = "top_district_by_risk", "top_crime_type_by_risk"
    nested = [F.col(f"{area}.{c}").alias(f"area_{c}") for c in (AREA, risk.TOTAL_30, "risk_percent", "risk_level")]
    nested += [
        F.col(f"{kind}.{c}").alias(f"type_{c}")
        for c in (TYPE, risk.TOTAL_30, "risk_percent", "risk_level", "risk_confidence")
    ]
    return whole.select(*[c for c in whole.columns if c not in (area, kind)], *nested)


def _summary(base: Counted) -> DataFrame:
    area_map, type_risk = stage(base.area_map(), "area-map"), stage(base.type_risk(), "type-risk")
    return present.summary(base.cube, stage(base.panel(), "city"), stage(base.selected(), "selected"), area_map, type_risk)


@query
def summary_flat(spark, folder):
    return _flat(_summary(orders(spark, folder, AREA, TYPE)))


@query
def summary_round_trip(spark, folder):
    """The summary written as a JSON document and read back."""
    path = new_path(spark, "summary")
    tables.export_json(_summary(orders(spark, folder, AREA, TYPE)), path)
    return _flat(views.summary_view(spark, path))


@query
def stored_table(spark, folder):
    """Daily counts kept as a named table; the name that does not exist is passed over."""
    name = f"daily_{uuid.uuid4().hex}"
    tables.save_table(counts.daily_counts(incidents_orders(spark, folder)), name)
    return tables.table_or(spark, f"missing_{name}", name)


@query
def registered_view(spark, folder):
    """Daily counts of each area by name in SQL."""
    name = f"daily_{uuid.uuid4().hex}"
    tables.register(counts.daily_counts(incidents_orders(spark, folder), [AREA]), name)
    return spark.sql(f"SELECT * FROM {name}")


@query
def sorted_export(spark, folder):
    """The area panel written in sorted key ranges and read back."""
    dense = stage(orders(spark, folder, AREA).panel(AREA), "dense")
    return tables.export_parquet(tables.sort_for_storage(dense, [DATE, AREA]), new_path(spark, "sorted"))


@query
def guard_outcomes(spark, folder):
    """What the views' guards say to a known and an unknown area and to a limit that is too small."""
    history = stage(present.present_history(orders(spark, folder, AREA).panel(AREA), [AREA]), "history")
    found = []
    for name, area, limit in (("known", 1, 30), ("unknown", 99, 30), ("small limit", 1, 5)):
        try:
            found.append((name, f"{views.area_history(history, area, limit).count()} rows"))
        except (LookupError, ValueError) as error:
            found.append((name, str(error)))
    return spark.createDataFrame(found, "request string, outcome string").withColumn("days", F.lit(history.count()).cast("bigint"))


@query
def published_round_trip(spark, folder):
    """The riskiest slots written as CSV and read back with their declared schema."""
    path = new_path(spark, "published")
    tables.export_csv(present.present_periods(events(spark, folder).periods()), f"{path}/high_risk_time_periods")
    return tables.read_output(spark, path, "high_risk_time_periods")


@query
def quality_range(spark, folder):
    return counts.date_range(incidents_orders(spark, folder))


@query
def quality_nulls(spark, folder):
    return counts.null_profile(clean_incidents(raw_text(spark, folder)), quality.CHECKED)


@query
def quality_yearly(spark, folder):
    return counts.yearly_totals(incidents_orders(spark, folder))


@query
def quality_latest_days(spark, folder):
    return quality.latest_days(counts.daily_counts(incidents_orders(spark, folder)))


@query
def quality_top_periods(spark, folder):
    base = events(spark, folder)
    slots = risk.risk_periods(counts.slot_counts(base.cube))
    return quality.quality_report(base.incidents, base.cube, slots, base.daily(AREA), {"events": base.incidents})[
        "top_periods"
    ]


@query
def table_counts(spark, folder):
    names = ("orders", "customer", "events", "lineitem")
    return counts.table_counts({**{n: read_table(spark, folder, n) for n in names}, "missing": None})


# ---------------------------------------------------------------- views
@query
def view_city_forecast(spark, folder):
    return views.city_forecast(present.present_forecast(orders(spark, folder).selected()), days=10)


@query
def view_city_history(spark, folder):
    return views.city_history(present.present_history(orders(spark, folder).panel()), limit=60)


@query
def view_area_history(spark, folder):
    return views.area_history(present.present_history(orders(spark, folder, AREA).panel(AREA), [AREA]), 7)


@query
def view_type_history(spark, folder):
    history = present.present_history(events(spark, folder, TYPE).panel(TYPE), [TYPE])
    return views.type_history(history, "Signup", limit=30)


@query
def view_leaderboard(spark, folder):
    return views.leaderboard_view(leaderboard_baseline(spark, folder))


@query
def view_area_risk(spark, folder):
    shown = views.area_risk_view(views.mappable(orders(spark, folder, AREA, TYPE).area_map()))
    return shown.withColumns({c: F.round(c, 4) for c in ("latitude", "longitude")})


@query
def view_type_risk(spark, folder):
    return views.type_risk_view(orders(spark, folder, AREA, TYPE).type_risk())


@query
def view_periods(spark, folder):
    periods = present.present_periods(events(spark, folder).periods(), rows=None)
    return views.risk_period_view(periods, area=3, kind="CLICK", limit=50)


@query
def worst_slot_per_area(spark, folder):
    return views.worst_slot_per_area(present.present_periods(events(spark, folder).periods(), rows=None), "click")


@query
def area_detail(spark, folder):
    base = events(spark, folder)
    history = risk.area_risk_history(base.cube, features.latest_date(base.cube))
    return views.area_detail(history, present.present_periods(base.periods(), rows=None), 2, "view")


@query
def type_detail(spark, folder):
    base = events(spark, folder)
    totals = base.cube.groupBy(TYPE).agg(F.sum(COUNT).alias("total_count"))
    return views.type_detail(totals, present.present_periods(base.periods(), rows=None), "click")


# ---------------------------------------------------------------- fitted models
@query
def evaluate_levels(spark, folder):
    """Errors per row, per area and day and per type and day, taking the 7-day mean as prediction."""
    base = orders(spark, folder, AREA, TYPE)
    table = features.lag_features(base.panel(AREA, TYPE))
    _, test = boosted.train_test(table, base.end)
    rows = test.select(
        DATE, AREA, TYPE, F.col(COUNT).cast("double").alias(metrics.ACTUAL),
        F.round("rolling_mean_7", 6).alias("predicted_crime_count"),
    )
    return metrics.evaluate_levels(rows, "Mean")


@query
def model_table(spark, folder):
    base = orders(spark, folder, AREA, TYPE)
    table = boosted.model_table(features.lag_features(base.panel(AREA, TYPE)), base.codes)
    shown = table.select(DATE, COUNT, *features.FEATURES)
    return shown.withColumns({c: F.round(c, 6) for c in ("rolling_mean_7", "rolling_mean_30", "rolling_std_7")})


@query
def next_day_features(spark, folder):
    """What the recursive forecast sees on its first day."""
    base = orders(spark, folder, AREA, TYPE)
    state = features.series_arrays(base.dense, [AREA, TYPE], last=30, end=base.end)
    state = state.join(base.codes, TYPE)
    made = boosted.step_features(state, base.end + dt.timedelta(days=1)).drop("history", TYPE)
    return made.withColumns({c: F.round(c, 6) for c in ("rolling_mean_7", "rolling_mean_30", "rolling_std_7")})


@query
def ar_gram(spark, folder):
    """Lag products of the once and the weekly differenced city series."""
    rows = arima.differenced(orders(spark, folder).panel(), [], arima.SARIMA_ORDERS)
    sums = arima.lag_products(rows, [])
    return sums.select("differencing", "n", F.posexplode("products").alias("lag", "product"))


@query
def arima_grid(spark, folder):
    base = orders(spark, folder)
    return arima.grid_search(stage(base.panel(), "city"), end=base.end).scores


@query
def sarima_grid(spark, folder):
    base = orders(spark, folder)
    return arima.grid_search(stage(base.panel(), "city"), orders=arima.SARIMA_ORDERS, end=base.end).scores


@query
def arima_grid_area(spark, folder):
    """One search over every area at once."""
    base = orders(spark, folder, AREA)
    return arima.grid_search(stage(base.panel(AREA), "areas"), [AREA], end=base.end).scores


@query
def arima_test_predictions(spark, folder):
    base = orders(spark, folder)
    return arima.grid_search(stage(base.panel(), "city"), end=base.end).test_predictions()


@query
def arima_forecast(spark, folder):
    base = orders(spark, folder)
    series = stage(base.panel(), "city")
    return arima.best_forecast(arima.grid_search(series, end=base.end), arima.fit(series))


@query
def sarima_forecast(spark, folder):
    base = orders(spark, folder)
    series = stage(base.panel(), "city")
    grid = arima.grid_search(series, orders=arima.SARIMA_ORDERS, end=base.end)
    return arima.best_forecast(grid, arima.fit(series, orders=arima.SARIMA_ORDERS), bounds=True)


@query
def leaderboard(spark, folder):
    base = orders(spark, folder)
    series = stage(base.panel(), "city")
    return pipeline.city_board(series, arima.grid_search(series, orders=arima.ALL_ORDERS, end=base.end))


@query
def selected_of_all(spark, folder):
    base = orders(spark, folder)
    series = stage(base.panel(), "city")
    grid = arima.grid_search(series, orders=arima.ALL_ORDERS, end=base.end)
    board = pipeline.city_board(series, grid)
    return forecast.select_forecast(board, pipeline.city_forecasts(series, grid, base.end))


@query
def gbt_metrics(spark, folder):
    model, test = orders(spark, folder, AREA, TYPE).gbt()
    return metrics.evaluate_levels(stage(boosted.predict(model, test), "predicted"), "GBT")


@query
def gbt_forecast(spark, folder):
    return orders(spark, folder, AREA, TYPE).gbt_forecast()


@query
def gbt_facts(spark, folder):
    """Facts that hold for any fit: series, days, dates, signs, and roll-ups that add up to the detail."""
    detail = stage(orders(spark, folder, AREA, TYPE).gbt_forecast(), "gbt-detail")
    parts = forecast.forecast_rollups(detail, "GBT")
    sums = [parts[n].agg(F.sum("predicted_crime_count").alias("n")).scalar() for n in ("district_30day", "crime_type_30day", "citywide_30day")]
    own = detail.agg(
        F.countDistinct(AREA, TYPE).alias("series"), F.countDistinct(DATE).alias("days"), F.min(DATE).alias("first_day"),
        F.max(DATE).alias("last_day"), F.count(F.lit(1)).alias("n_rows"), F.min("predicted_crime_count").alias("least"),
        F.sum("predicted_crime_count").alias("total"),
    )
    adds_up = (F.col("total") == sums[0]) & (F.col("total") == sums[1]) & (F.col("total") == sums[2])
    return own.select("series", "days", "first_day", "last_day", "n_rows", (F.col("least") >= 0).alias("none_below_zero"), adds_up.alias("adds_up"))


@query
def gbt_rollup(spark, folder):
    detail = orders(spark, folder, AREA, TYPE).gbt_forecast()
    return forecast.forecast_rollups(detail, "Boosted Trees Aggregated")["citywide_30day"]


# ---------------------------------------------------------------- file and schema reports
@query
def preview_lines(spark, folder):
    """The first lines of all documents, by id and place in the text."""
    return delimited.first_lines(read_table(spark, folder, "documents"), "text", "doc_id")


@query
def describe_columns(spark, folder):
    """Each column of the events with its type, values, missing values and distinct values."""
    return delimited.describe_values(read_table(spark, folder, "events"))
