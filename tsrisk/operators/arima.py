"""ARIMA and seasonal ARIMA over many daily series at once.

Conditional least squares in place of an exact likelihood search:

1. difference every series, once per differencing any candidate asks for;
2. a long autoregression from lag products gives estimates of the shocks;
3. sums of products of lagged values and lagged shocks, one row per series, are
   all that any candidate order needs: each picks its own sub-matrix;
4. a small solve per series and candidate gives start values (two-stage
   regression, Hannan and Rissanen, 1982);
5. from there `least_squares` finds the least sum of squared shocks, seasonal
   products constrained, over the arrays of a batch of series at a time; a
   series is never longer than the calendar;
6. forecasts by recursion inside the JVM.

There is no constant, so every order must difference at least once. AIC values
compare among orders of the same differencing, as ever, and rest on the
conditional sum of squares.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tsrisk.operators import least_squares
from tsrisk.names import COUNT, DATE, FORECAST_DAYS, PREDICTED, STEP, TEST_DAYS
from tsrisk.operators.features import best_per_key, latest_date, series_arrays
from tsrisk.operators.forecast import ITERATIVE_MEAN, iterative_mean_forecast
from tsrisk.operators.metrics import ACTUAL, error_metrics
from tsrisk.session import stage

# The solve helpers travel inside the task, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(least_squares)

# Five weeks of lags: seasonal differencing leaves shocks that a short autoregression misses.
LONG_AR = 35
#: Series that one task fits.
TASK_SERIES = 64
NORMAL_95 = 1.959963984540054


@dataclass(frozen=True)
class Order:
    """(p, d, q) and, with a period, (P, D, Q, s)."""

    p: int
    d: int
    q: int
    seasonal: tuple[int, int, int, int] | None = None

    @property
    def text(self) -> str:
        return str((self.p, self.d, self.q))

    @property
    def name(self) -> str:
        return f"ARIMA{self.text}" if self.seasonal is None else f"SARIMA{self.text}x{self.seasonal}"

    @property
    def _season(self) -> tuple[int, int, int, int]:
        return self.seasonal or (0, 0, 0, 1)

    @property
    def differencing(self) -> str:
        return f"{self.d},{self._season[1]},{self._season[3]}"

    def difference_polynomial(self) -> np.ndarray:
        """Coefficients of (1-B)^d (1-B^s)^D by power of B."""
        _, big_d, _, s = self._season
        poly = np.array([1.0])
        for step in [1] * self.d + [s] * big_d:
            poly = np.convolve(poly, np.r_[1.0, np.zeros(step - 1), -1.0])
        return poly

    def _lags(self, short: int, long: int) -> list[int]:
        s = self._season[3]
        return sorted({i + s * j for i in range(short + 1) for j in range(long + 1)} - {0})

    @property
    def shape(self) -> least_squares.Shape:
        big_p, _, big_q, s = self._season
        return least_squares.Shape(self.p, big_p, self.q, big_q, s)

    def start(self, beta: np.ndarray) -> np.ndarray:
        """Start values from free coefficients by lag: those of the lags that stand alone."""
        big_p, _, big_q, s = self._season
        ar, ma = dict(zip(self.ar_lags, beta)), dict(zip(self.ma_lags, beta[len(self.ar_lags) :]))
        lags = lambda n, step: [step * (i + 1) for i in range(n)]
        return np.array([
            *(ar[k] for k in lags(self.p, 1)), *(ar[k] for k in lags(big_p, s)),
            *(ma[k] for k in lags(self.q, 1)), *(ma[k] for k in lags(big_q, s)),
        ])

    @property
    def ar_lags(self) -> list[int]:
        return self._lags(self.p, self._season[0])

    @property
    def ma_lags(self) -> list[int]:
        return self._lags(self.q, self._season[2])


# --- fixed values: candidate orders ----------------------------------------
ARIMA_ORDERS = tuple(
    Order(*o) for o in ((1, 1, 1), (2, 1, 1), (3, 1, 1), (1, 1, 2), (2, 1, 2), (3, 1, 2), (5, 1, 1), (7, 1, 1))
)
SARIMA_ORDERS = (
    Order(1, 1, 1, (1, 0, 1, 7)),
    Order(2, 1, 1, (1, 0, 1, 7)),
    Order(1, 1, 2, (1, 0, 1, 7)),
    Order(2, 1, 2, (1, 0, 1, 7)),
    Order(1, 1, 1, (1, 1, 1, 7)),
    Order(2, 1, 1, (1, 1, 1, 7)),
)
ALL_ORDERS = ARIMA_ORDERS + SARIMA_ORDERS


# ---------------------------------------------------------------- shared shapes
def _reach(orders) -> tuple[list[int], list[int], int]:
    """All value lags, all shock lags, and how far back a forecast looks in the series itself."""
    ar = sorted({lag for o in orders for lag in o.ar_lags})
    ma = sorted({lag for o in orders for lag in o.ma_lags})
    back = max(max(o.ar_lags, default=0) + len(o.difference_polynomial()) - 1 for o in orders)
    return ar, ma, back


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _key_fields(df: DataFrame, keys) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


# ---------------------------------------------------------------- rows
def differenced(series: DataFrame, keys, orders, y: str = COUNT) -> DataFrame:
    """Rows (keys, differencing, date, w), one set per differencing in use."""
    by_date = Window.partitionBy(*keys).orderBy(DATE)
    polynomials = {o.differencing: o.difference_polynomial() for o in orders}
    value = F.col(y).cast("double")
    variants = []
    for name, poly in polynomials.items():
        terms = [F.lag(value, k).over(by_date) * float(c) if k else value for k, c in enumerate(poly) if c or not k]
        w = terms[0]
        for term in terms[1:]:
            w = w + term
        variants.append(F.struct(F.lit(name).alias("differencing"), w.alias("w")))
    rows = series.select(*keys, DATE, F.array(*variants).alias("variants"))
    return rows.select(*keys, DATE, F.inline("variants")).where(F.col("w").isNotNull())


def _with_value_lags(rows: DataFrame, keys) -> DataFrame:
    by_date = Window.partitionBy(*keys, "differencing").orderBy(DATE)
    lags = F.array(*[F.lag("w", k).over(by_date) for k in range(1, LONG_AR + 1)])
    return rows.withColumn("lags", lags)


def lag_products(rows: DataFrame, keys) -> DataFrame:
    """Sums of w(t)·w(t-k), k = 0..long, as one array per series."""
    lagged = _with_value_lags(rows, keys)
    sums = [F.sum(F.col("w") * F.col("w"))] + [F.sum(F.col("w") * F.col("lags")[k]) for k in range(LONG_AR)]
    return lagged.groupBy(*keys, "differencing").agg(F.array(*sums).alias("products"), F.count("w").alias("n"))


def long_autoregression(products: DataFrame, keys) -> DataFrame:
    """Long autoregressive coefficients per series; a series without variation gets none."""
    fields = [*_key_fields(products, [*keys, "differencing"]), T.StructField("long_ar", T.ArrayType(T.DoubleType()))]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            solved = []
            for sums in batch["products"]:
                g = np.asarray(sums, dtype=float)
                if not np.isfinite(g).all():  # fewer rows than lags
                    solved.append(None)
                    continue
                index = np.abs(np.subtract.outer(np.arange(LONG_AR), np.arange(LONG_AR)))
                try:
                    solved.append(np.linalg.solve(g[index], g[1:]).tolist())
                except np.linalg.LinAlgError:
                    solved.append(None)
            yield batch.drop(columns=["products", "n"]).assign(long_ar=solved)

    return products.mapInPandas(solve, T.StructType(fields)).where(F.col("long_ar").isNotNull())


def shocks(rows: DataFrame, coefficients: DataFrame, keys) -> DataFrame:
    """Rows with `e`, the residual of the long autoregression."""
    joined = _with_value_lags(rows, keys).join(coefficients, [*keys, "differencing"])
    return joined.select(
        *keys, "differencing", DATE, "w", (F.col("w") - _dot(F.col("long_ar"), F.col("lags"))).alias("e")
    ).where(F.col("e").isNotNull())


def cross_products(rows: DataFrame, keys, orders) -> DataFrame:
    """Upper triangle of the sums of products of w, its lags and the lagged shocks, one row per series."""
    ar, ma, _ = _reach(orders)
    by_date = Window.partitionBy(*keys, "differencing").orderBy(DATE)
    terms = {"w": F.col("w")}
    terms |= {f"w{k}": F.lag("w", k).over(by_date) for k in ar}
    terms |= {f"e{k}": F.lag("e", k).over(by_date) for k in ma}
    names = list(terms)
    wide = rows.select(*keys, "differencing", *[c.alias(n) for n, c in terms.items()])
    for name in names:
        wide = wide.where(F.col(name).isNotNull())
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    return wide.groupBy(*keys, "differencing").agg(F.array(*sums).alias("gram"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- fits
def _solve_one(gram: np.ndarray, n: int, order: Order, ar: list[int], ma: list[int]) -> np.ndarray | None:
    """Least squares on one sub-matrix; None when it cannot be solved."""
    use = [1 + ar.index(k) for k in order.ar_lags] + [1 + len(ar) + ma.index(k) for k in order.ma_lags]
    if n <= 2 * len(use):
        return None
    try:
        beta = np.linalg.solve(gram[np.ix_(use, use)], gram[use, 0])
    except np.linalg.LinAlgError:
        return None
    return beta if np.isfinite(beta).all() and gram[0, 0] > beta @ gram[use, 0] else None


def start_values(grams: DataFrame, keys, orders) -> DataFrame:
    """One row per series and differencing with `starts`: model and start values of each candidate that can be solved."""
    ar, ma, _ = _reach(orders)
    size = 1 + len(ar) + len(ma)
    schema = T.StructType([
        *_key_fields(grams, [*keys, "differencing"]),
        *T.StructType.fromDDL("starts array<struct<model: string, beta: array<double>>>"),
    ])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(size)
        for batch in batches:
            found = []
            for sums, n, differencing in zip(batch["gram"], batch["n"], batch["differencing"]):
                gram = np.zeros((size, size))
                gram[upper] = sums
                gram = gram + np.triu(gram, 1).T
                betas = [(o, _solve_one(gram, n, o, ar, ma)) for o in orders if o.differencing == differencing]
                found.append([{"model": o.name, "beta": o.start(b).tolist()} for o, b in betas if b is not None])
            yield batch.drop(columns=["gram", "n"]).assign(starts=found)

    return grams.mapInPandas(solve, schema).where(F.size("starts") > 0)


def _described(order: Order, fit: least_squares.Fit, back: int, depth: int, steps: int):
    """Coefficients on the undifferenced series, spread per step, AIC and the last shocks; None if they are not finite."""
    own, moving, _, _ = order.shape.polynomials(fit.beta)
    combined = -np.convolve(own, order.difference_polynomial())[1:]
    phi, theta = np.zeros(back), np.zeros(depth)
    phi[: len(combined)], theta[: len(moving) - 1] = combined, moving[1:]
    # Weight of a shock h days later, for the forecast variance.
    psi = np.zeros(steps)
    psi[0] = 1.0
    for h in range(1, steps):
        past = psi[max(0, h - back) : h][::-1]
        psi[h] = (theta[h - 1] if h <= depth else 0.0) + phi[: len(past)] @ past
    sigma2 = fit.squares / fit.n
    spread = np.sqrt(sigma2 * np.cumsum(psi**2))
    if not sigma2 > 0 or not np.isfinite(spread).all():
        return None
    aic = fit.n * np.log(sigma2) + 2 * (order.shape.size + 1)
    return phi.tolist(), theta.tolist(), spread.tolist(), float(aic), fit.shocks[-depth:].tolist()


def fit_orders(arrays: DataFrame, keys, orders, steps: int) -> DataFrame:
    """Every candidate on every series: coefficients on the undifferenced series, spread per step, AIC, last shocks, rounds.

    `arrays` has `history`, the differenced series, and `starts`. `reason` names a search that stopped before it converged.
    """
    _, ma, back = _reach(orders)
    depth = max(ma, default=1)
    by_name = {o.name: o for o in orders}
    schema = T.StructType([
        *_key_fields(arrays, [*keys, "differencing"]),
        *T.StructType.fromDDL(
            "model string, `order` string, seasonal_order string, phi array<double>, theta array<double>, spread array<double>, "
            "aic double, shocks array<double>, rounds int, reason string"
        ),
    ])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            # Orders of one differencing compare, so they leave out the same first days.
            for _, group in batch.groupby("differencing", sort=True):
                asked = [(row, s["model"], np.array(s["beta"])) for row in group.to_dict("records") for s in row["starts"]]
                fits = least_squares.fit_rows(
                    [np.asarray(row["history"], dtype=float) for row, _, _ in asked],
                    [by_name[m].shape for _, m, _ in asked], [b for _, _, b in asked],
                )
                for (row, model, _), fit in zip(asked, fits):
                    order = by_name[model]
                    if fit is None or (made := _described(order, fit, back, depth, steps)) is None:
                        continue
                    found.append([
                        *[row[k] for k in (*keys, "differencing")], model, order.text,
                        None if order.seasonal is None else str(order.seasonal), *made, fit.rounds,
                        None if fit.converged else UNCONVERGED,
                    ])
            yield pd.DataFrame(found, columns=schema.names)

    return arrays.mapInPandas(solve, schema)


#: Why a series has no candidate, or a candidate that may not be the best of its order.
UNCONVERGED = f"stopped after {least_squares.ROUNDS} rounds"
UNFITTED = "no order fits: flat, short or singular"


@dataclass
class Fitted:
    """Candidates with the latest values and shocks a forecast starts from."""

    fits: DataFrame
    starts: DataFrame
    keys: list[str]
    end: dt.date
    series: DataFrame
    y: str


def fit(series: DataFrame, keys=(), orders=ARIMA_ORDERS, y: str = COUNT, steps: int = FORECAST_DAYS) -> Fitted:
    """Fit every order on every dense series of `series`."""
    if any(o.differencing.startswith("0,0") for o in orders):
        raise ValueError("every order must difference at least once")
    keys, end = list(keys), latest_date(series)
    _, _, back = _reach(orders)
    rows = stage(differenced(series, keys, orders, y), "differenced")
    coefficients = stage(long_autoregression(lag_products(rows, keys), keys), "long-ar")
    residuals = stage(shocks(rows, coefficients, keys), "shocks")
    starts = start_values(cross_products(residuals, keys, orders), keys, orders)
    arrays = series_arrays(rows, [*keys, "differencing"], "w").join(starts, [*keys, "differencing"])
    arrays = stage(arrays, "arima-arrays")
    dealt = arrays.repartition(max(1, -(-arrays.count() // TASK_SERIES)))
    fits = stage(fit_orders(dealt, keys, orders, steps), "arima-fits")
    tails = series_arrays(series, keys, y, last=back, end=end).withColumnRenamed("history", "values")
    last = fits.select(*keys, "differencing", "model", "shocks")
    # Without keys there is one series, so one row of values for at most a few rows of shocks.
    starts = last.join(tails, keys) if keys else last.withColumn("values", tails.select("values").scalar())
    fits = fits.drop("shocks")
    return Fitted(fits, starts, keys, end, series, y)


def forecast(fitted: Fitted, steps: int = FORECAST_DAYS) -> DataFrame:
    """Unrounded forecast per candidate, series and day, with its standard error.

    `steps` may not exceed the number of steps the fit was made for.
    """
    start = fitted.fits.join(fitted.starts, [*fitted.keys, "differencing", "model"])
    back, depth = F.size("phi"), F.size("theta")
    future = F.concat(F.col("shocks"), F.array_repeat(F.lit(0.0), steps))

    def one_day(so_far: Column, i: Column) -> Column:
        own = _dot(F.reverse("phi"), F.slice(so_far, -back, back))
        return F.concat(so_far, F.array(own + _dot(F.reverse("theta"), F.slice(future, i, depth))))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("values"), one_day)
    ahead = start.withColumn("ahead", F.slice(path, F.size("values") + 1, steps)).where(
        (F.size("values") == back) & (F.size("shocks") == depth)
    )
    names = [*fitted.keys, "model", "order", "seasonal_order", "aic", "reason"]
    days = F.arrays_zip("ahead", F.slice("spread", 1, steps).alias("spread"))
    return ahead.select(*names, F.posexplode(days).alias("_pos", "_day")).select(
        F.date_add(F.lit(fitted.end), F.col("_pos") + 1).alias(DATE),
        (F.col("_pos") + 1).alias(STEP),
        *names,
        F.col("_day.ahead").alias("value"),
        F.col("_day.spread").alias("spread"),
    )


def _clamped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def _count(value: Column) -> Column:
    return F.bround(_clamped(value), 0).cast("bigint")


# ---------------------------------------------------------------- outputs
@dataclass
class Grid:
    """Scores of all candidates, with the exact error as `_gain`, and the test-day forecasts behind them.

    With keys, a series that no order fits has one row without a model, and the reason; a search that stopped
    before it converged says so there as well.
    """

    ranked: DataFrame
    tested: DataFrame
    keys: list[str]

    @property
    def scores(self) -> DataFrame:
        return self.ranked.drop("_gain")

    def family(self, seasonal: bool) -> Grid:
        """Only the seasonal, or only the plain, candidates of a search over both."""
        own = F.col("seasonal_order").isNotNull() if seasonal else F.col("seasonal_order").isNull()
        return Grid(self.ranked.where(own | F.col("model").isNull()), self.tested.where(own), self.keys)

    def best(self) -> DataFrame:
        """The candidate with the smallest MAE before rounding, per series."""
        if self.keys:
            return best_per_key(self.ranked, self.keys, "_gain", ["model"]).drop("_gain")
        return self.ranked.orderBy(F.desc("_gain"), "model").limit(1).drop("_gain")

    def test_predictions(self) -> DataFrame:
        """Actual and predicted counts of the best candidate on the test days."""
        chosen = self.best().select(*self.keys, "model")
        rows = self.tested.join(chosen, [*self.keys, "model"], "left_semi")
        return rows.select(DATE, *self.keys, ACTUAL, _count(F.col("value")).alias(PREDICTED), "model")


def grid_search(
    series: DataFrame,
    keys=(),
    orders=ARIMA_ORDERS,
    y: str = COUNT,
    test_days: int = TEST_DAYS,
    end: dt.date | None = None,
) -> Grid:
    """Fit all orders without the last `test_days` days, forecast those days and score them."""
    keys = list(keys)
    end = end or latest_date(series)
    cut = F.lit(end - dt.timedelta(days=test_days))
    fitted = fit(series.where(F.col(DATE) <= cut), keys, orders, y, steps=test_days)
    actual = series.where(F.col(DATE) > cut).select(*keys, DATE, F.col(y).cast("double").alias(ACTUAL))
    ahead = forecast(fitted, test_days).withColumn("value", _clamped(F.col("value")))
    tested = stage(ahead.join(actual, [*keys, DATE]), "arima-tested")
    described = [*keys, "model", "order", "seasonal_order", "aic", "reason"]
    scores = error_metrics(tested, ACTUAL, "value", by=described, exact="_mae").where(F.col("mae").isNotNull())
    scores = scores.withColumns({"aic": F.bround("aic", 2), "_gain": -F.col("_mae")}).drop("_mae")
    scores = stage(scores, "arima-scores")
    if scores.isEmpty():
        raise RuntimeError("no candidate order could be fitted")
    if keys:
        lost = series.select(*keys).distinct().join(scores.select(*keys).distinct(), keys, "left_anti")
        scores = scores.unionByName(lost.withColumn("reason", F.lit(UNFITTED)), allowMissingColumns=True)
    return Grid(scores if keys else scores.drop("reason"), tested, keys)


def best_forecast(grid: Grid, refit: Fitted, steps: int = FORECAST_DAYS, bounds: bool = False) -> DataFrame:
    """Forecast with each series' best order, refitted on all days; 95 % bounds if asked."""
    best = grid.best()
    chosen = best.where(F.col("model").isNotNull()).select(*grid.keys, "model")
    own = replace(refit, fits=refit.fits.join(chosen, [*grid.keys, "model"], "left_semi"))
    margin = F.col("spread") * NORMAL_95
    limits = {"lower_bound": F.col("value") - margin, "upper_bound": F.col("value") + margin} if bounds else {}
    ahead = forecast(own, steps).select(
        DATE,
        STEP,
        *grid.keys,
        _count(F.col("value")).alias(PREDICTED),
        *[_count(c).alias(name) for name, c in limits.items()],
        "model",
    )
    if not grid.keys:
        return ahead
    # A series that no order fits keeps a forecast, the mean one, and its name says so.
    unfitted = best.where(F.col("model").isNull()).select(*grid.keys)
    mean = iterative_mean_forecast(
        refit.series.join(unfitted, grid.keys, "left_semi"), grid.keys, refit.y, steps=steps, end=refit.end,
        model=f"{ITERATIVE_MEAN} ({UNFITTED})",
    )
    return ahead.unionByName(mean.withColumn(PREDICTED, F.col(PREDICTED).cast("bigint")), allowMissingColumns=True)
