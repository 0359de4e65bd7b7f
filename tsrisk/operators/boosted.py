"""Boosted trees over all series: features, fit, evaluation and recursive forecast."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tsrisk.functions.dates import DATE_PARTS, date_part
from tsrisk.names import AREA, COUNT, DATE, FORECAST_DAYS, PREDICTED, STEP, TEST_DAYS, TYPE
from tsrisk.operators.features import FEATURES, chrono_split, series_arrays
from tsrisk.operators.forecast import array_sum, last_n
from tsrisk.operators.forest import bind, forest_table, walk
from tsrisk.operators.metrics import ACTUAL
from tsrisk.session import ensure_checkpoint_dir

CODE = f"{TYPE}_code"
LABEL = "boosted"
#: Rows of the model table for each task of the fit.
TASK_ROWS = 100_000


def model_table(features: DataFrame, codes: DataFrame) -> DataFrame:
    """The feature table as numbers: type codes, 0/1 weekend flag, 0 for what is missing.

    `codes` is best built from the short list of types, whose known size lets it be broadcast.
    """
    numbers = features.join(codes, TYPE).withColumn("is_weekend", F.col("is_weekend").cast("int"))
    return numbers.fillna(0, list(FEATURES))


def fit_gbt(
    table: DataFrame,
    max_iter: int = 250,
    step_size: float = 0.05,
    max_depth: int = 6,
    sampling: float = 0.85,
    seed: int = 42,
) -> PipelineModel:
    """Gradient-boosted regression on the model table.

    The rows are partitioned by series and sorted, so sampling does not depend
    on how the input happened to be split. Their number, and not the session, decides on
    the tasks: a fit is some thousand short jobs, and each waits for its slowest task to start.
    """
    ensure_checkpoint_dir(table.sparkSession)
    rows = table.select(*FEATURES, DATE, F.col(COUNT).cast("double").alias("label"))
    parts = max(1, -(-table.count() // TASK_ROWS))
    rows = rows.repartition(parts, AREA, CODE).sortWithinPartitions(AREA, CODE, DATE)
    trees = GBTRegressor(
        featuresCol="features",
        labelCol="label",
        predictionCol=LABEL,
        maxIter=max_iter,
        stepSize=step_size,
        maxDepth=max_depth,
        subsamplingRate=sampling,
        featureSubsetStrategy=str(sampling),
        seed=seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees]).fit(rows)


def train_test(table: DataFrame, end: dt.date, days: int = TEST_DAYS) -> tuple[DataFrame, DataFrame]:
    split = chrono_split(table, days=days, end=end)
    return split.where(~F.col("is_test")), split.where("is_test")


def _predicted() -> Column:
    return F.greatest(F.lit(0.0), F.col(LABEL))


def predict(model: PipelineModel, table: DataFrame) -> DataFrame:
    """Actual and predicted count of every row, never below zero."""
    return model.transform(table).select(
        DATE, AREA, TYPE, F.col(COUNT).cast("double").alias(ACTUAL), _predicted().alias(PREDICTED)
    )


# ---------------------------------------------------------------- recursion
def _spread(values: Column) -> Column:
    """Sample standard deviation of a short array."""
    n = F.size(values)
    mean = array_sum(values) / n
    squares = F.aggregate(values, F.lit(0.0), lambda total, x: total + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(0.0)


def _from_history(history: Column) -> dict[str, Column]:
    """Lags and rolling statistics of the day after a history."""
    week, month = last_n(history, 7), last_n(history, 30)
    return {f"lag_{k}": F.try_element_at(history, F.lit(-k)) for k in (1, 7, 14, 30)} | {
        "rolling_mean_7": array_sum(week) / F.size(week),
        "rolling_mean_30": array_sum(month) / F.size(month),
        "rolling_std_7": _spread(week),
    }


def _of_day(day: dt.date) -> dict[str, Column]:
    return {part: date_part(part, F.lit(day)).cast("int") for part in DATE_PARTS}


def step_features(state: DataFrame, day: dt.date) -> DataFrame:
    """Features of one day for every series, from the values known so far."""
    made = _of_day(day) | _from_history(F.col("history"))
    return state.select("*", *[F.coalesce(c, F.lit(0)).alias(name) for name, c in made.items()])


def recursive_forecast(
    model: PipelineModel, panel: DataFrame, codes: DataFrame, end: dt.date, steps: int = FORECAST_DAYS
) -> DataFrame:
    """Day by day, all series at once: predict, round, append, repeat.

    The trees are data that the expression walks, so all days are one `aggregate` over one short row per series,
    whatever the length of the history, in one job.
    """
    trees = forest_table(panel.sparkSession, model.stages[-1])
    state = series_arrays(panel, [AREA, TYPE], last=30, end=end).join(codes, TYPE)
    state = state.withColumn("forest", trees.select(F.struct("*")).scalar())
    days = [[c.cast("double").alias(name) for name, c in _of_day(end + dt.timedelta(days=s)).items()] for s in range(1, steps + 1)]

    def one_day(so_far: Column, day: Column) -> Column:
        made = {AREA: F.col(AREA), CODE: F.col(CODE)} | {part: day[part] for part in DATE_PARTS} | _from_history(so_far["history"])
        row = F.array(*[F.coalesce(made[name].cast("double"), F.lit(0.0)) for name in FEATURES])
        count = F.bround(F.greatest(F.lit(0.0), bind(row, lambda r: walk(F.col("forest"), r))), 0)
        return bind(count, lambda n: F.struct(
            F.concat(last_n(so_far["history"], 29), F.array(n)).alias("history"),
            F.concat(so_far["ahead"], F.array(n.cast("bigint"))).alias("ahead"),
        ))

    start = F.struct(F.col("history"), F.array().cast("array<bigint>").alias("ahead"))
    ahead = F.aggregate(F.array(*[F.struct(*day) for day in days]), start, one_day)["ahead"]
    return state.select(AREA, TYPE, F.posexplode(ahead).alias("_pos", PREDICTED)).select(
        F.date_add(F.lit(end), F.col("_pos") + 1).alias(DATE), (F.col("_pos") + 1).alias(STEP), AREA, TYPE, PREDICTED
    )
