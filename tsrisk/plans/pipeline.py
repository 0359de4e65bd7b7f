"""From a raw text file to every published table.

Each named table is written as Parquet and read back before later steps use it,
so a step starts from files with known sizes, never from a long lineage.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tsrisk import names as N
from tsrisk.names import AREA, DATE, TYPE
from tsrisk.operators import arima, boosted, counts, features, forecast, metrics, panel, risk
from tsrisk.operators.centroids import centroids
from tsrisk.plans import present, quality
from tsrisk.plans.clean import clean_incidents
from tsrisk.session import shuffles_sized_for
from tsrisk.sources import tables
from tsrisk.sources.delimited import quarantined_rows, read_raw, total_bytes, usable_rows


@dataclass
class Settings:
    """What a run may want to change; the defaults are the published ones."""

    areas: tuple[int, ...] = N.VALID_AREAS
    top_types: int = N.TOP_TYPES
    start: dt.date | None = N.FIRST_DAY
    multiline: bool | None = None
    min_group: int = N.MIN_GROUP
    min_slot: int = N.MIN_SLOT
    trees: int = 250
    depth: int = 6
    latitude_box: tuple[float, float] = N.LATITUDE_BOX
    longitude_box: tuple[float, float] = N.LONGITUDE_BOX


def city_board(series: DataFrame, grid: arima.Grid) -> DataFrame:
    """Best simple predictor, best ARIMA and best seasonal ARIMA, best first."""
    return forecast.leaderboard({
        "Baseline": forecast.baseline_leaderboard(series),
        "ARIMA": grid.family(seasonal=False).scores,
        "SARIMA": grid.family(seasonal=True).scores,
    })


def city_forecasts(series: DataFrame, grid: arima.Grid, end: dt.date) -> dict[str, DataFrame]:
    """The forecast of each group; both ARIMA families come from one refit."""
    refit = arima.fit(series, grid.keys, arima.ALL_ORDERS)
    return {
        "Baseline": forecast.iterative_mean_forecast(series, end=end),
        "ARIMA": arima.best_forecast(grid.family(seasonal=False), refit),
        "SARIMA": arima.best_forecast(grid.family(seasonal=True), refit, bounds=True),
    }


@dataclass
class Pipeline:
    """One run; the finished tables by name are in `done`."""

    spark: SparkSession
    folder: str
    settings: Settings = field(default_factory=Settings)
    done: dict[str, DataFrame] = field(default_factory=dict)

    def _keep(self, name: str, df: DataFrame, sort=()) -> DataFrame:
        stored = tables.sort_for_storage(df, sort) if sort else df
        self.done[name] = tables.export_parquet(stored, f"{self.folder}/{name}")
        return self.done[name]

    # -- 1: load, clean, count
    def load(self, raw_path: str) -> DataFrame:
        """Clean rows; lines that do not fit are kept beside them."""
        raw = read_raw(self.spark, raw_path, multiline=self.settings.multiline)
        self._keep("crimes_quarantined", quarantined_rows(raw))
        return self._keep("crimes_clean", clean_incidents(usable_rows(raw)))

    def count(self, incidents: DataFrame) -> None:
        """All count tables from one pass over the incidents."""
        cube = self._keep("incident_cube", counts.incident_cube(incidents))
        self._keep("citywide_daily_counts", counts.roll_up_days(cube), [DATE])
        self._keep("district_daily_counts", counts.roll_up_days(cube, [AREA]), [DATE, AREA])
        self._keep("crime_type_daily_counts", counts.roll_up_days(cube, [TYPE]), [DATE, TYPE])
        self._keep("district_crime_type_daily_counts", counts.roll_up_days(cube, [AREA, TYPE]), [DATE, AREA, TYPE])
        self._keep("high_risk_time_periods", risk.risk_periods(counts.slot_counts(cube)))
        latest = features.latest_date(self.done["citywide_daily_counts"])
        self._keep("district_risk_summary", risk.area_risk_history(self.done["district_daily_counts"], latest))

    # -- 2: panels, features, better risk
    def prepare(self) -> None:
        s, done = self.settings, self.done
        cube = done["incident_cube"]
        first, self.end = panel.calendar_bounds(done["citywide_daily_counts"])
        # Earlier days are mistyped years; a later first day shortens the calendar only where no start is set.
        self.start = s.start or first
        until_end = cube.where(F.col(DATE) <= F.lit(self.end))
        types = self._keep("top_types", counts.top_keys(until_end, TYPE, s.top_types)).select(TYPE)
        areas = {AREA: s.areas}

        def dense(name, source, sort, keys=None, extra=None):
            self._keep(name, panel.panel(done[source], self.end, self.start, keys, extra), sort)

        dense("citywide_model_ready", "citywide_daily_counts", [DATE])
        dense("district_model_ready", "district_daily_counts", [DATE, AREA], extra=areas)
        dense("crime_type_model_ready", "crime_type_daily_counts", [DATE, TYPE], types)
        dense("district_crime_type_model_ready", "district_crime_type_daily_counts", [DATE, AREA, TYPE], types, areas)
        self._keep("features_daily", features.lag_features(done["district_crime_type_model_ready"]))
        self._keep(
            "high_risk_time_periods_v2",
            risk.risk_periods_supported(counts.slot_counts(until_end), types, s.areas, s.min_group, s.min_slot),
        )
        self._keep(
            "district_risk_summary_v2",
            risk.area_risk_recent(done["district_daily_counts"], self.end, self.start, s.areas),
        )

    # -- 3: city forecasts
    def forecast_city(self) -> None:
        series = self.done["citywide_model_ready"]
        self._keep("baseline_model_comparison", forecast.baseline_leaderboard(series))
        self._keep("baseline_test_predictions", forecast.baseline_test_predictions(series))
        grid = arima.grid_search(series, orders=arima.ALL_ORDERS, end=self.end)
        for name, seasonal in (("arima", False), ("sarima", True)):
            family = grid.family(seasonal)
            self._keep(f"{name}_model_comparison", family.scores.orderBy("mae", "model"))
            self._keep(f"{name}_test_predictions", family.test_predictions())
        self._keep("model_comparison_current", city_board(series, grid))
        for group, ahead in city_forecasts(series, grid, self.end).items():
            kept = self._keep(f"citywide_30day_forecast_{group.lower()}", ahead)
            self._keep(f"citywide_7day_forecast_{group.lower()}", forecast.first_days(kept, 7))

    # -- 4: boosted trees
    def forecast_series(self) -> None:
        s, done = self.settings, self.done
        dense = done["district_crime_type_model_ready"]
        codes = features.category_codes(done["top_types"])
        table = self._keep("model_table", boosted.model_table(done["features_daily"], codes))
        train, test = boosted.train_test(table, self.end)
        model = boosted.fit_gbt(train, max_iter=s.trees, max_depth=s.depth)
        meta = {
            "feature_columns": list(features.FEATURES),
            "crime_type_map": {r[TYPE]: r[boosted.CODE] for r in codes.collect()},
            "max_training_date": str(self.end),
        }
        tables.save_model(model, meta, f"{self.folder}/boosted_trees", self.spark)
        predicted = self._keep("boosted_test_predictions", boosted.predict(model, test))
        self._keep("boosted_model_comparison", metrics.evaluate_levels(predicted, "Boosted Trees"))
        detail = self._keep("boosted_detail_30day", boosted.recursive_forecast(model, dense, codes, self.end))
        rollups = forecast.forecast_rollups(detail, "Boosted Trees District + Crime Type Aggregated")
        for name, table in rollups.items():
            self._keep(f"boosted_{name}", table)
        for key, name in ((AREA, "district"), (TYPE, "crime_type")):
            totals = done[f"boosted_{name}_total"]
            base = risk.baseline_30(done[f"{name}_daily_counts"], [key], self.end, self.start, among=totals)
            self._keep(f"{name}_risk_forecast_30day", risk.forecast_risk(totals, base, [key]))
        centers = centroids(
            done["crimes_clean"], latitude_box=s.latitude_box, longitude_box=s.longitude_box
        )
        self._keep("district_map_points", risk.map_points(done["district_risk_forecast_30day"], centers))

    # -- 5: published tables
    def publish(self) -> None:
        done = self.done
        ahead = {g: done[f"citywide_30day_forecast_{g.lower()}"] for g in ("Baseline", "ARIMA", "SARIMA")}
        selected = forecast.select_forecast(done["model_comparison_current"], ahead)
        outputs = {
            "citywide_forecast": present.present_forecast(selected),
            "citywide_7day_forecast": present.present_forecast(selected, 7),
            "district_risk_map": present.present_area_map(done["district_map_points"]),
            "crime_type_risk": present.present_type_risk(done["crime_type_risk_forecast_30day"]),
            "high_risk_time_periods": present.present_periods(done["high_risk_time_periods_v2"]),
            "model_comparison": done["model_comparison_current"].select(
                *N.OUTPUT_SCHEMAS["model_comparison"].names
            ).orderBy("mae", "model_group"),
            "citywide_history": present.present_history(done["citywide_model_ready"]),
            "district_history": present.present_history(done["district_model_ready"], [AREA]),
            "crime_type_history": present.present_history(done["crime_type_model_ready"], [TYPE]),
        }
        for name, table in outputs.items():
            tables.export_csv(table, f"{self.folder}/published/{name}")
            done[f"published_{name}"] = table
        done["summary"] = present.summary(
            done["incident_cube"], done["citywide_model_ready"], selected, outputs["district_risk_map"],
            outputs["crime_type_risk"],
        )
        tables.export_json(done["summary"], f"{self.folder}/published/summary")

    # -- 6: quality report
    def report(self) -> None:
        done = self.done
        found = quality.quality_report(
            done["crimes_clean"], done["incident_cube"], done["high_risk_time_periods"], done["district_risk_summary"],
            {name: done[name] for name in ("crimes_clean", "crimes_quarantined", "citywide_daily_counts")},
        )
        for name, table in found.items():
            self._keep(f"quality_{name}", table)

    def run(self, raw_path: str) -> dict[str, DataFrame]:
        with shuffles_sized_for(self.spark, total_bytes(self.spark, raw_path)):
            self.count(self.load(raw_path))
            self.prepare()
            self.forecast_city()
            self.forecast_series()
            self.publish()
            self.report()
        return self.done
