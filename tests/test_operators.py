"""Operators against brute force, published figures and invariants."""

import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tsrisk.names import AREA, COUNT, DATE, DAY, TYPE
from tsrisk.functions.dates import with_date_parts
from tsrisk.operators import arima, boosted, counts, features, forecast, forest, least_squares, metrics, panel, risk, sketches
from tsrisk.operators.centroids import centroids, exact_medians
from tsrisk.sources import tables

START = dt.date(2020, 1, 1)


def day(i):
    return START + dt.timedelta(days=i)


def series(spark, values, **keys):
    rows = [(day(i), float(v), *keys.values()) for i, v in enumerate(values)]
    kinds = "".join(f", {k} {'int' if isinstance(v, int) else 'string'}" for k, v in keys.items())
    return spark.createDataFrame(rows, f"date date, {COUNT} double{kinds}")


# ---------------------------------------------------------------- counts and panels
@pytest.fixture(scope="module")
def incidents(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        for _ in range(rng.randint(0, 6)):
            rows.append((day(i), rng.choice([1, 2, 13, None]), rng.choice(["A", "B", "C", None]), rng.randint(0, 23)))
    return spark.createDataFrame(rows, f"{DAY} date, {AREA} int, {TYPE} string, hour int").cache()


def test_cube_rolls_up_to_every_count(incidents):
    cube = counts.incident_cube(incidents)
    for keys in ([], [AREA], [TYPE], [AREA, TYPE]):
        direct = sorted(map(str, counts.daily_counts(incidents, keys).collect()))
        assert direct == sorted(map(str, counts.roll_up_days(cube, keys).collect())), keys


def test_counts_do_not_depend_on_partitioning(incidents):
    one = sorted(map(str, counts.daily_counts(incidents.coalesce(1), [AREA]).collect()))
    assert one == sorted(map(str, counts.daily_counts(incidents.repartition(9), [AREA]).collect()))


def test_safe_end_drops_thin_last_days(spark):
    got = panel.safe_end_date(series(spark, [10] * 40 + [9, 2, 1])).first()[0]
    assert got == day(40)
    assert panel.calendar_bounds(series(spark, [10] * 40 + [5])) == (START, day(40))


def test_panel_is_gap_free(spark, incidents):
    daily = counts.daily_counts(incidents, [AREA, TYPE])
    keys = spark.createDataFrame([("A",), ("B",)], f"{TYPE} string")
    dense = panel.panel(daily, day(99), START, keys, {AREA: [1, 2, 99]})
    assert dense.count() == 100 * 2 * 3
    assert dense.groupBy(AREA, TYPE).agg(F.countDistinct(DATE).alias("n")).where("n <> 100").count() == 0
    expected = daily.where((F.col(DATE) <= F.lit(day(99))) & F.col(AREA).isin(1, 2) & F.col(TYPE).isin("A", "B"))
    assert dense.agg(F.sum(COUNT)).first()[0] == expected.agg(F.sum(COUNT)).first()[0]


# ---------------------------------------------------------------- risk
def test_area_risk_equals_the_dense_definition(spark, incidents):
    daily, end, areas = counts.daily_counts(incidents, [AREA]), day(110), [1, 2, 99]
    dense = panel.panel(daily, end, START, None, {AREA: areas})
    got = {r[AREA]: r for r in risk.area_risk_recent(daily, end, START, areas).collect()}
    for area in areas:
        past = {r[DATE]: r[COUNT] for r in dense.where(F.col(AREA) == area).collect()}
        recent = sum(n for d, n in past.items() if d > end - dt.timedelta(days=30))
        base = 30 * statistics.mean(n for d, n in past.items() if d <= end - dt.timedelta(days=30))
        assert got[area]["recent_30_day_count"] == recent
        assert got[area]["expected_30_day_count"] == round(base, 2)
        if base:
            assert got[area]["risk_percent_vs_recent_baseline"] == pytest.approx(100 * (recent - base) / base, abs=0.006)
    assert got[99]["risk_percent_vs_recent_baseline"] is None and got[99]["risk_level"] == "Low"


def test_shares_of_a_group_add_up(incidents):
    slots = counts.slot_counts(counts.incident_cube(incidents))
    shares = risk.risk_periods(slots).groupBy(AREA, TYPE).agg(F.sum("share_of_group_percent").alias("s"))
    assert all(abs(r["s"] - 100) < 0.5 for r in shares.collect())


PUBLISHED = [  # predicted, expected, percent, level, direction
    (30, 10.85, 176.5, "Very High", "Above Recent Baseline"),
    (362, 319.64, 13.25, "High", "Above Recent Baseline"),
    (979, 901.81, 8.56, "Moderate", "Above Recent Baseline"),
    (558, 558.82, -0.15, "Low", "Below Recent Baseline"),
    (755, 785.1, -3.83, "Low", "Below Recent Baseline"),
]


def test_forecast_risk_matches_published_rows(spark):
    from tsrisk.plans.present import present_type_risk

    totals = spark.createDataFrame([(f"t{i}", p[0]) for i, p in enumerate(PUBLISHED)], f"{TYPE} string, {risk.TOTAL_30} long")
    base = spark.createDataFrame([(f"t{i}", p[1]) for i, p in enumerate(PUBLISHED)], f"{TYPE} string, {risk.EXPECTED} double")
    rows = present_type_risk(risk.forecast_risk(totals, base, [TYPE])).collect()
    got = [(r[risk.TOTAL_30], r[risk.EXPECTED], r["display_risk_percent"], r["risk_level"], r["risk_direction"]) for r in rows]
    assert got == PUBLISHED  # also sorted by percent
    assert [r["risk_confidence"] for r in rows] == ["Low Volume"] + ["Stable"] * 4


def test_key_without_incidents_has_a_zero_baseline(spark):
    daily = spark.createDataFrame([(day(300), 1, 12)], f"date date, {AREA} int, {COUNT} long")
    totals = spark.createDataFrame([(1, 9), (2, 4)], f"{AREA} int, {risk.TOTAL_30} long")
    base = risk.baseline_30(daily, [AREA], day(364), START, among=totals)
    rows = {r[AREA]: r for r in risk.forecast_risk(totals, base, [AREA]).collect()}
    assert rows[1][risk.EXPECTED] == round(12 / 365 * 30, 2)
    assert (rows[2][risk.EXPECTED], rows[2][risk.AREA_RISK], rows[2]["risk_level"]) == (0.0, None, "Low")


# ---------------------------------------------------------------- medians
def test_sketches_of_days_answer_for_periods(spark):
    rng = random.Random(12)
    rows = [(day(rng.randrange(40)), rng.choice("ab"), rng.randrange(900), rng.gauss(0, 10) if rng.random() < 0.9 else None) for _ in range(8000)]
    facts = spark.createDataFrame(rows, f"{DATE} date, k string, who int, v double")
    cube = sketches.sketch_cube(facts, ["k"], ["who"], ["v"])
    assert cube.agg(F.sum(COUNT)).first()[0] == 8000
    inside = [r for r in rows if day(5) <= r[0] <= day(20)]
    got = {r["k"]: r["distinct_who"] for r in sketches.distinct_members(cube, "who", ["k"], day(5), day(20)).collect()}
    for k in "ab":
        assert got[k] == pytest.approx(len({r[2] for r in inside if r[1] == k}), rel=0.04)
    for at in (0.1, 0.5, 0.9):
        value = sketches.quantiles(cube, "v", at=at, start=day(5), end=day(20)).first()["v"]
        own = [r[3] for r in inside if r[3] is not None]
        assert sum(x <= value for x in own) / len(own) == pytest.approx(at, abs=0.02)
    assert sketches.distinct_members(cube, "who", ["k"], day(99)).count() == 0
    assert sketches.quantiles(cube.where("k = 'none'"), "v").first()["v"] is None


def test_medians_equal_brute_force(spark):
    rng = random.Random(11)
    groups = {
        "one": [4.0],
        "two": [1.0, 2.0],
        "odd": [rng.gauss(0, 1) for _ in range(999)],
        "even": [rng.gauss(0, 1) for _ in range(1000)],
        "ties": [float(rng.randint(0, 3)) for _ in range(5000)],
        "same": [7.5] * 3000,
        "outlier": [1e300, -1e300, *[rng.gauss(0, 1) for _ in range(2000)]],
        "split": [0.0] * 2500 + [1.0] * 2500,
        "hot": [rng.random() ** 5 for _ in range(60_000)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "v"]))
    want = {k: pytest.approx(statistics.median(v), rel=1e-12) for k, v in groups.items()}
    # Also with a position that puts nearly everything into one coarse bucket, and one that clips both ends.
    for position in (None, F.col("v") / 1e6 + 0.5, F.col("v") - 1):
        assert {r["k"]: r["v"] for r in exact_medians(df, ["k"], "v", position).collect()} == want


def test_centroids_keep_to_the_box(spark):
    rows = [(1, 41.8, -87.6), (1, 41.9, -87.7), (1, 41.7, -87.5), (1, 0.0, 0.0), (2, 0.0, 0.0), (None, 41.8, -87.6), (3, 41.8, None)]
    df = spark.createDataFrame(rows, f"{AREA} int, latitude double, longitude double")
    assert [tuple(r) for r in centroids(df).collect()] == [(1, 41.8, -87.6)]


# ---------------------------------------------------------------- features
def test_partial_and_full_windows(spark):
    df = series(spark, [1, 2, 3, 4], k=1).withColumns(
        {"part": features.rolling(["k"], COUNT, 2), "full": features.rolling(["k"], COUNT, 2, full=True)}
    )
    got = [(r["part"], r["full"]) for r in df.orderBy(DATE).collect()]
    assert got == [(None, None), (1.0, None), (1.5, 1.5), (2.5, 2.5)]


def test_features_see_only_the_past(spark):
    values = [random.Random(1).randint(0, 9) for _ in range(60)]
    changed = values[:-1] + [999]

    def known(v):
        df = features.lag_features(series(spark, v, k=1), ["k"])
        return [tuple(r)[3:] for r in df.orderBy(DATE).collect()]

    assert known(values) == known(changed)
    assert len(known(values)) == 30


def test_chrono_split_takes_the_last_days(spark):
    df = features.chrono_split(series(spark, range(100), k=1), ["k"], days=10)
    assert df.where("is_test").count() == 10
    assert features.chrono_split(series(spark, range(100), k=1), days=10).where("is_test").count() == 10


def test_category_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], f"{TYPE} string")
    assert {r[0]: r[1] for r in features.category_codes(df).collect()} == {"a": 0, "b": 1, "c": 2}


def test_many_category_codes(spark):
    df = spark.range(100_000).select(F.md5(F.col("id").cast("string")).alias(TYPE))
    codes = features.category_codes(df.unionByName(df.limit(500)))
    assert "SinglePartition" not in codes._jdf.queryExecution().executedPlan().toString()
    rows = codes.orderBy(TYPE).collect()
    assert [r[1] for r in rows] == list(range(100_000)) and codes.dtypes[1][1] == "int"
    assert features.category_codes(df.limit(0)).count() == 0


def test_sparse_panel_equals_the_dense_one_and_shuffles_counts_only(spark):
    rng = random.Random(6)
    rows = {(day(rng.randrange(90)), rng.choice((1, 2, 9)), rng.choice("AB")): rng.randint(1, 5) for _ in range(60)}
    daily = spark.createDataFrame([(*k, v) for k, v in rows.items()], f"{DATE} date, {AREA} int, {TYPE} string, {COUNT} long")
    keys = spark.createDataFrame([("A",), ("C",)], f"{TYPE} string")
    both = [
        features.lag_features(make(daily, day(80), day(3), keys, {AREA: (1, 2, 3)}))
        for make in (panel.panel, panel.sparse_panel)
    ]
    cols = sorted(both[0].columns)
    dense, sparse = (sorted(map(tuple, df.select(cols).collect()), key=str) for df in both)
    assert dense == sparse and len(dense) == 6 * 48
    plan = both[1]._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("RepartitionByExpression")[0]
    assert "explode(sequence" in above and "Join" not in above


@pytest.mark.parametrize("buckets", [1, 3])
def test_series_stored_in_buckets_are_read_without_an_exchange(spark, buckets):
    rng = random.Random(7)
    rows = {(day(rng.randrange(90)), rng.choice((1, 2, 9)), rng.choice("AB")): rng.randint(1, 5) for _ in range(60)}
    daily = spark.createDataFrame([(*k, v) for k, v in rows.items()], f"{DATE} date, {AREA} int, {TYPE} string, {COUNT} long")
    keys = spark.createDataFrame([("A",), ("C",)], f"{TYPE} string")
    for source in (daily, daily.limit(0)):
        stored = panel.series_rows(source, day(80), day(3), keys, {AREA: (1, 2, 3)})
        tables.save_buckets(stored, "tsrisk_series", (AREA, TYPE), (DATE,), buckets)
        dense = panel.stored_panel(spark, "tsrisk_series", day(80), (AREA, TYPE))
        wanted = panel.panel(source, day(80), day(3), keys, {AREA: (1, 2, 3)})
        made = features.lag_features(dense), forecast.iterative_mean_forecast(dense, (AREA, TYPE), end=day(80))
        right = features.lag_features(wanted), forecast.iterative_mean_forecast(wanted, (AREA, TYPE), end=day(80))
        for mine, theirs in zip(made, right):
            cols = sorted(mine.columns)
            assert sorted(map(tuple, mine.select(cols).collect()), key=str) == sorted(map(tuple, theirs.select(cols).collect()), key=str)
            assert "Exchange" not in mine._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in made[0].join(made[0].groupBy(AREA, TYPE).count().hint("merge"), [AREA, TYPE])._jdf.queryExecution().executedPlan().toString()



# ---------------------------------------------------------------- forecasts
CITY_AHEAD = [525, 531, 535, 532, 533, 531, 532, 531] + [532] * 22


def python_mean_forecast(history, steps):
    values = list(history)
    for _ in range(steps):
        recent = values[-7:]
        values.append(max(0, round(sum(recent) / len(recent))))
    return values[len(history):]


def test_mean_forecast_continues_the_published_one(spark):
    got = forecast.iterative_mean_forecast(series(spark, CITY_AHEAD[:7]), steps=23).orderBy("forecast_day").collect()
    assert [r["predicted_crime_count"] for r in got] == CITY_AHEAD[7:]
    assert sum(CITY_AHEAD) == 15954 and sum(CITY_AHEAD[:7]) == 3719


def test_mean_forecast_equals_python(spark):
    rng = random.Random(5)
    many = {k: [rng.randint(0, 5) for _ in range(20)] for k in range(6)}
    df = None
    for k, v in many.items():
        one = series(spark, v, k=k)
        df = one if df is None else df.unionByName(one)
    rows = forecast.iterative_mean_forecast(df, ["k"]).orderBy("k", "forecast_day").collect()
    for k, v in many.items():
        assert [r["predicted_crime_count"] for r in rows if r["k"] == k] == python_mean_forecast(v, 30)


def test_error_metrics(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 8.0), (20.0, 25.0)], "a double, p double")
    got = metrics.error_metrics(df, "a", "p").first()
    assert tuple(got) == (2.67, 3.16, 22.5, 0.85)
    flat = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0)], "a double, p double")
    assert tuple(metrics.error_metrics(flat, "a", "p").first()) == (1.0, 1.0, None, None)


def test_leaderboard_fills_missing_columns(spark):
    a = spark.createDataFrame([("m1", 3.0), ("m2", 2.0)], "model string, mae double")
    b = spark.createDataFrame([("m3", 1.0, 9.5)], "model string, mae double, aic double")
    rows = forecast.leaderboard({"A": a, "B": b}).collect()
    assert [(r["model"], r["model_group"], r["aic"]) for r in rows] == [("m3", "B", 9.5), ("m2", "A", None)]


# ---------------------------------------------------------------- arima
def simulated(n=6000, ar=0.7, ma=0.4, seed=0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n)
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = ar * w[t - 1] + e[t] + ma * e[t - 1]
    return 500 + np.cumsum(w)


def test_arima_recovers_known_coefficients(spark):
    fitted = arima.fit(series(spark, simulated()), orders=(arima.Order(1, 1, 1),))
    row = fitted.fits.first()
    # (1 - 0.7B)(1 - B) on the series itself
    assert row["phi"] == pytest.approx([1.7, -0.7], abs=0.04)
    assert row["theta"] == pytest.approx([0.4], abs=0.05)
    assert row["spread"][0] == pytest.approx(1.0, abs=0.04)


def test_arima_forecast_equals_direct_recursion(spark):
    values = simulated(800)
    fitted = arima.fit(series(spark, values), orders=(arima.Order(2, 1, 1, (1, 0, 1, 7)),))
    fit, start = fitted.fits.first(), fitted.starts.first()
    assert start["values"] == pytest.approx(list(values[-len(fit["phi"]):]))
    path, shock = list(start["values"]), list(start["shocks"])
    for _ in range(12):
        ahead = sum(p * path[-i - 1] for i, p in enumerate(fit["phi"]))
        ahead += sum(t * shock[-i - 1] for i, t in enumerate(fit["theta"]))
        path.append(ahead)
        shock.append(0.0)
    got = [r["value"] for r in arima.forecast(fitted, 12).orderBy("forecast_day").collect()]
    assert got == pytest.approx(path[-12:])


def test_arima_cross_products_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"differencing": "1,0,1", "date": [day(i) for i in range(50)], "w": rng.normal(size=50), "e": rng.normal(size=50)})
    df = spark.createDataFrame(rows, "differencing string, date date, w double, e double")
    order = arima.Order(2, 1, 1)
    got = arima.cross_products(df, [], (order,)).first()
    w, e = rows["w"].to_numpy(), rows["e"].to_numpy()
    x = np.column_stack([w[2:], w[1:-1], w[:-2], e[1:-1]])
    assert got["n"] == 48
    assert got["gram"] == pytest.approx((x.T @ x)[np.triu_indices(4)])


def test_arima_many_series_and_flat_ones(spark):
    df = series(spark, simulated(400, seed=1), k=1).unionByName(series(spark, simulated(400, seed=2), k=2))
    df = df.unionByName(series(spark, [5] * 400, k=3))
    grid = arima.grid_search(df, ["k"], test_days=30)
    lost = grid.scores.where("model is null").collect()
    assert [(r["k"], r["mae"], r["reason"]) for r in lost] == [(3, None, arima.UNFITTED)]
    assert {r["k"] for r in grid.scores.where("model is not null").collect()} == {1, 2}
    ahead = arima.best_forecast(grid, arima.fit(df, ["k"], steps=5), steps=5, bounds=True)
    rows = ahead.where("k < 3").collect()
    assert len(rows) == 10
    flat = ahead.where("k = 3").collect()
    assert [r["predicted_crime_count"] for r in flat] == [5] * 5
    assert all(arima.UNFITTED in r["model"] and r["lower_bound"] is None for r in flat)
    assert all(r["lower_bound"] <= r["predicted_crime_count"] <= r["upper_bound"] for r in rows)
    with pytest.raises(RuntimeError):
        arima.grid_search(series(spark, [5] * 200), test_days=30)


def test_least_squares_is_a_minimum_and_beats_its_start():
    """No coefficient can be moved to a smaller sum of squares; the sums come from a plain recursion."""
    rng = np.random.default_rng(8)
    orders = [arima.Order(2, 1, 1), arima.Order(1, 1, 2, (1, 0, 1, 7)), arima.Order(2, 1, 1, (1, 1, 1, 7))]
    long = np.diff(simulated(900)) + np.tile(rng.normal(size=7), 129)[:899]
    series_, shapes = [long, long[300:], long, long], [orders[0].shape, orders[1].shape, orders[2].shape, orders[1].shape]
    starts = [np.zeros(s.size) for s in shapes[:3]] + [np.array([0.1, 0.1, 3.0, 0.1, 0.1])]  # the last one is not invertible

    def squares(w, shape, beta, skip):
        ar, ma, _, _ = shape.polynomials(beta)
        e = [0.0] * skip
        for t in range(skip, len(w)):
            past = sum(m * e[t - j - 1] for j, m in enumerate(ma[1:]) if t - j - 1 >= 0)
            e.append(sum(a * w[t - i] for i, a in enumerate(ar)) - past)
        return sum(x * x for x in e), e

    skip = max(s.reach[0] for s in shapes)
    for w, shape, start, fit in zip(series_, shapes, starts, least_squares.fit_rows(series_, shapes, starts)):
        best, e = squares(w, shape, fit.beta, skip)
        assert fit.converged and fit.rounds < 40 and fit.n == len(w) - skip
        assert fit.squares == pytest.approx(best, rel=1e-9) and fit.shocks[-20:] == pytest.approx(e[-20:], abs=1e-8)
        assert best <= squares(w, shape, np.zeros(shape.size), skip)[0]
        for k in range(shape.size):
            for move in (-1e-3, 1e-3):
                other = fit.beta.copy()
                other[k] += move
                assert squares(w, shape, other, skip)[0] > best * (1 - 1e-7)


def test_derivatives_of_the_shocks():
    shape = arima.Order(2, 1, 1, (1, 0, 1, 7)).shape
    beta, w = np.array([0.3, -0.2, 0.4, 0.5, -0.3]), np.random.default_rng(2).normal(size=(1, 80))

    def run(b):
        return least_squares.shocks(w, np.array([9]), *[x[None] for x in shape.polynomials(b)])

    e, d = run(beta)
    for k in range(shape.size):
        step = np.eye(shape.size)[k] * 1e-6
        assert d[0, k] == pytest.approx((run(beta + step)[0] - run(beta - step)[0])[0] / 2e-6, abs=1e-6)


def test_least_squares_leaves_out_short_and_flat_series():
    shape = arima.Order(1, 1, 1).shape
    rng = np.random.default_rng(1)
    rows = [np.zeros(100), rng.normal(size=5), rng.normal(size=200), np.full(50, np.nan)]
    found = least_squares.fit_rows(rows, [shape] * 4, [np.zeros(2)] * 4)
    assert [f is None for f in found] == [True, True, False, True]
    assert least_squares.fit_rows([], [], []) == []


def test_arima_least_squares_from_spark_equals_the_plain_fit(spark):
    values = {k: simulated(300 + 50 * k, seed=k) for k in (1, 2, 3)}
    df = series(spark, values[1], k=1).unionByName(series(spark, values[2], k=2)).unionByName(series(spark, values[3], k=3))
    orders = (arima.Order(1, 1, 1), arima.Order(2, 1, 1, (1, 0, 1, 7)))
    rows = {(r["k"], r["model"]): r for r in arima.fit(df, ["k"], orders).fits.collect()}
    assert len(rows) == 6 and all(r["reason"] in (None, arima.UNCONVERGED) for r in rows.values())
    assert all(r["reason"] is None for (_, model), r in rows.items() if model == orders[0].name)
    for k, v in values.items():
        for o in orders:
            fit = least_squares.fit_rows([np.diff(v)], [o.shape], [np.zeros(o.shape.size)])[0]
            ar, ma, _, _ = o.shape.polynomials(fit.beta)
            phi = -np.convolve(ar, [1, -1])[1:]
            aic = fit.n * np.log(fit.squares / fit.n) + 2 * (o.shape.size + 1)
            if o.seasonal is None:
                assert rows[k, o.name]["phi"][: len(phi)] == pytest.approx(phi.tolist(), abs=1e-3)
                assert rows[k, o.name]["aic"] == pytest.approx(aic, abs=1e-3)
            else:  # without a season both seasonal factors cancel along a valley
                assert rows[k, o.name]["aic"] == pytest.approx(aic, abs=1.0)


def test_seasonal_lags_and_names():
    order = arima.Order(2, 1, 1, (1, 1, 1, 7))
    assert order.ar_lags == [1, 2, 7, 8, 9] and order.ma_lags == [1, 7, 8]
    assert order.name == "SARIMA(2, 1, 1)x(1, 1, 1, 7)"
    assert list(order.difference_polynomial()) == [1, -1, 0, 0, 0, 0, 0, -1, 1]


# ---------------------------------------------------------------- boosted trees
def test_recursive_forecast_feeds_predictions_back(spark):
    days, end = 160, day(159)
    frames = [series(spark, [(a + i) % 7 for i in range(days)], **{AREA: a, TYPE: t}) for a, t in ((1, "A"), (2, "B"))]
    dense = frames[0].unionByName(frames[1])
    dense = with_date_parts(dense, DATE)
    codes = features.category_codes(dense)
    table = boosted.model_table(features.lag_features(dense), codes)
    model = boosted.fit_gbt(table, max_iter=3, max_depth=3)
    rows = boosted.recursive_forecast(model, dense, codes, end, steps=7).orderBy("forecast_day", AREA).collect()
    assert len(rows) == 14 and min(r["predicted_crime_count"] for r in rows) >= 0
    # Step by step with the same model and plain Python histories.
    history = {1: [(1 + i) % 7 for i in range(days)], 2: [(2 + i) % 7 for i in range(days)]}
    code = {r[TYPE]: r[boosted.CODE] for r in codes.collect()}
    for step in range(1, 8):
        target = end + dt.timedelta(days=step)
        made = []
        for a, t in ((1, "A"), (2, "B")):
            h = [float(x) for x in history[a]]
            dow = (target.weekday() + 1) % 7
            made.append((a, code[t], target.day, target.month, target.year, dow, target.isocalendar()[1], int(dow in (0, 6)),
                         h[-1], h[-7], h[-14], h[-30], statistics.mean(h[-7:]), statistics.mean(h[-30:]), statistics.stdev(h[-7:])))
        scored = model.transform(spark.createDataFrame(made, list(features.FEATURES))).collect()
        for r in scored:
            history[r[AREA]].append(max(0, round(r[boosted.LABEL])))
    got = {(r[AREA], r["forecast_day"]): r["predicted_crime_count"] for r in rows}
    assert got == {(a, s): history[a][days + s - 1] for a in (1, 2) for s in range(1, 8)}


def test_forest_as_data_predicts_like_the_model(spark):
    rows = spark.range(3000).selectExpr("id % 7 AS a", "id % 11 - 5.0 AS b", "rand(3) AS c", "cast(id % 7 * 2 + id % 11 AS double) AS label")
    table = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).persist()
    model = GBTRegressor(maxIter=20, maxDepth=5, stepSize=0.1, seed=1).fit(table)
    trees = forest.forest_table(spark, model).select(F.struct("*")).scalar()
    own = forest.walk(F.col("forest"), F.array(*[F.col(c).cast("double") for c in "abc"]))
    found = model.transform(table).withColumn("forest", trees).select((F.col("prediction") - own).alias("d"), "prediction")
    assert found.agg(F.max(F.abs("d"))).first()[0] < 1e-9
    assert found.select("prediction").distinct().count() > 20


def test_recursive_forecast_is_one_plan(spark):
    days, end = 60, day(59)
    dense = with_date_parts(series(spark, [i % 5 for i in range(days)], **{AREA: 1, TYPE: "A"}), DATE)
    codes = features.category_codes(dense)
    model = boosted.fit_gbt(boosted.model_table(features.lag_features(dense), codes), max_iter=2, max_depth=2)
    plan = boosted.recursive_forecast(model, dense, codes, end)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") >= 1 and "UDF" not in plan


def test_rollups_keep_the_total(spark):
    detail = spark.createDataFrame(
        [(day(1), 1, 1, "A", 3), (day(1), 1, 1, "B", 4), (day(2), 2, 2, "A", 5)],
        f"date date, forecast_day int, {AREA} int, {TYPE} string, predicted_crime_count long",
    )
    for name, table in forecast.forecast_rollups(detail, "m").items():
        column = risk.TOTAL_30 if name.endswith("total") else "predicted_crime_count"
        assert table.agg(F.sum(column)).first()[0] == 12, name
