"""Percentages, bands and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tsrisk import names as N


def _hundred(col: Column) -> Column:
    return F.lit(100.0) * col


def share_percent(part: Column, total: Column) -> Column:
    return F.round(F.try_divide(_hundred(part), total), 2)


def raw_deviation(value: Column, base: Column) -> Column:
    """Percent above or below `base`; NULL when the base is zero or missing."""
    return F.try_divide(_hundred(value - base), base)


def percent_deviation(value: Column, base: Column, half_even: bool = False) -> Column:
    """`raw_deviation` to two digits.

    Historical tables round half away from zero, forecast tables half to even.
    """
    rounding = F.bround if half_even else F.round
    return rounding(raw_deviation(value, base), 2)


def band(value: Column, cuts=N.AREA_BANDS, rest: str = N.AREA_REST) -> Column:
    """Label of the first lower cut that `value` reaches; NULL falls to `rest`."""
    label = F
    for cut, name in cuts:
        label = label.when(value >= cut, name)
    return label.otherwise(rest)


def slot_band(value: Column) -> Column:
    return band(value, N.SLOT_BANDS, N.SLOT_REST)


def direction(value: Column) -> Column:
    return F.when(value > 0, N.ABOVE).otherwise(N.BELOW)


def confidence(volume: Column, cut: int = N.LOW_VOLUME) -> Column:
    return F.when(volume < cut, N.LOW_CONFIDENCE).otherwise(N.HIGH_CONFIDENCE)


def clamp_zero(value: Column) -> Column:
    """Negative to zero; NULL stays NULL."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def match_label(col: Column, wanted: str) -> Column:
    """Case-blind match in which a dash in the request stands for a blank."""
    return F.upper(col) == wanted.upper().replace("-", " ")


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def finite(col: Column) -> Column:
    return F.when(~F.isnan(col) & ~col.isin(float("inf"), float("-inf")), col)


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every floating column."""
    floating = {
        f.name: finite(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floating) if floating else df


def not_null(df: DataFrame, columns) -> DataFrame:
    """Rows in which all `columns` are present, as filters the scan can apply."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df
