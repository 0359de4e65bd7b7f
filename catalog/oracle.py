"""The same results in SQL, written apart from the Spark code, for DuckDB.

Every statement is built from named steps; a statement lists the steps it needs.
"""

from __future__ import annotations

from catalog import rawtext
from tsrisk.names import AREA_BANDS, AREA_REST, DAY_NAMES, RAW_COLUMNS, SLOT_BANDS, SLOT_REST, VALID_AREAS
from tsrisk.operators.arima import LONG_AR

ORDERS = """inc AS (
  SELECT o_orderdate AS ts, o_orderdate::DATE AS d, (c_nationkey + 1)::INTEGER AS district,
         o_orderpriority AS primary_type, o_totalprice AS latitude, c_acctbal AS longitude
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
EVENTS = """inc AS (
  SELECT ts, ts::DATE AS d, (user_id % 25 + 1)::INTEGER AS district, event_type AS primary_type,
         value AS latitude, value AS longitude
  FROM events)"""
LINES = """inc AS (
  SELECT l_shipdate AS ts, l_shipdate::DATE AS d, (s_nationkey + 1)::INTEGER AS district,
         l_returnflag AS primary_type, l_extendedprice AS latitude, s_acctbal AS longitude
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

BOUNDS = """city AS (SELECT d AS date, count(*) AS n FROM inc GROUP BY d),
lim AS (
  SELECT min(date) AS lo, max(date) FILTER (n >= 0.5 * typical) AS hi
  FROM (SELECT date, n, median(n) OVER (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS typical
        FROM city))"""
CALENDAR = "cal AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM lim)"
AREAS = f"areas AS (SELECT unnest([{', '.join(map(str, VALID_AREAS))}])::INTEGER AS district)"
TOPS = """tops AS (
  SELECT primary_type FROM inc, lim WHERE d <= hi GROUP BY primary_type ORDER BY count(*) DESC, primary_type LIMIT 4)"""

_PARTS = """day({c})::INTEGER AS day, month({c})::INTEGER AS month, year({c})::INTEGER AS year,
  dayofweek({c})::INTEGER AS day_of_week, week({c})::INTEGER AS week_of_year, dayofweek({c}) IN (0, 6) AS is_weekend"""


def parts(column: str) -> str:
    return _PARTS.format(c=column)


def panel(*keys: str) -> str:
    """Dense counts as step `pan`."""
    grid = "cal" + "".join({"district": ", areas", "primary_type": ", tops"}[k] for k in keys)
    cols = "".join(f", {k}" for k in keys)
    using = ", ".join(["date", *keys])
    return (
        f"hits AS (SELECT d AS date{cols}, count(*) AS n FROM inc GROUP BY ALL),\n"
        f"pan AS (SELECT date{cols}, coalesce(n, 0)::BIGINT AS crime_count "
        f"FROM (SELECT date{cols} FROM {grid}) LEFT JOIN hits USING ({using}))"
    )


def steps_for(source: str, *keys: str) -> str:
    extra = ([AREAS] if "district" in keys else []) + ([TOPS] if "primary_type" in keys else [])
    return ",\n".join([source, BOUNDS, CALENDAR, *extra, panel(*keys)])


def sql(steps: str, final: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{steps}\n{final}"


def bands(expr: str, cuts, rest: str) -> str:
    whens = " ".join(f"WHEN {expr} >= {cut} THEN '{label}'" for cut, label in cuts)
    return f"CASE {whens} ELSE '{rest}' END"


def deviation(x: str, base: str) -> str:
    return f"(1e2 * ({x} - {base}) / nullif({base}, 0))"


SLOT_LEVEL = bands("risk_percent_vs_group_avg", SLOT_BANDS, SLOT_REST)
AREA_LEVEL = bands("risk_percent_vs_recent_baseline", AREA_BANDS, AREA_REST)
DIRECTION = "CASE WHEN {0} > 0 THEN 'Above Recent Baseline' ELSE 'Below Recent Baseline' END"

# ---------------------------------------------------------------- slot steps
SLOTS = """slots AS (
  SELECT district, primary_type, dayofweek(ts)::INTEGER AS day_of_week, hour(ts)::INTEGER AS hour,
         count(*) AS crime_count
  FROM inc GROUP BY ALL)"""
SLOTS_2 = """slots AS (
  SELECT district, primary_type, dayofweek(ts)::INTEGER AS day_of_week, hour(ts)::INTEGER AS hour,
         count(*) AS crime_count
  FROM inc SEMI JOIN areas USING (district) SEMI JOIN tops USING (primary_type), lim
  WHERE d <= hi GROUP BY ALL)"""
STATS = """stats AS (
  SELECT district, primary_type, sum(crime_count)::BIGINT AS group_total, avg(crime_count) AS avg_slot_count
  FROM slots GROUP BY ALL)"""
SCORED = f"""scored AS (
  SELECT district, primary_type, day_of_week, hour, crime_count, group_total,
         round(1e2 * crime_count / nullif(group_total, 0), 2) AS share_of_group_percent,
         round({deviation('crime_count', 'avg_slot_count')}, 2) AS risk_percent_vs_group_avg
  FROM slots JOIN stats USING (district, primary_type))"""
V1 = ",\n".join([EVENTS, SLOTS, STATS, SCORED])
V2 = ",\n".join([
    EVENTS, BOUNDS, AREAS, TOPS, SLOTS_2, STATS, SCORED,
    f"supported AS (SELECT *, {SLOT_LEVEL} AS risk_level FROM scored WHERE group_total >= 60 AND crime_count >= 2)",
])
DAY_NAME = "CASE day_of_week " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(DAY_NAMES)) + " END"
HOUR_LABEL = "lpad(hour::VARCHAR, 2, '0') || ':00'"
TOP500 = V2 + f""",
top500 AS (
  SELECT district, primary_type, {DAY_NAME} AS day_name, {HOUR_LABEL} AS hour_label, crime_count,
         share_of_group_percent, risk_percent_vs_group_avg, risk_level
  FROM (SELECT * FROM supported
        ORDER BY risk_percent_vs_group_avg DESC, district, primary_type, day_of_week, hour LIMIT 500))"""
PERIODS = V2 + f""",
periods AS (
  SELECT district, primary_type, {DAY_NAME} AS day_name, {HOUR_LABEL} AS hour_label, crime_count,
         share_of_group_percent, risk_percent_vs_group_avg, risk_level FROM supported)"""
PERIOD_ORDER = "risk_percent_vs_group_avg DESC, district, primary_type, day_name, hour_label"

# Below, 1e2 stands for 100.0, which DuckDB would read as a decimal.
# ---------------------------------------------------------------- forecast steps
LAGGED = """lagged AS (
  SELECT date{cols}, crime_count::DOUBLE AS crime_count,
    (lag(crime_count, 1) OVER w)::DOUBLE AS pred_lag_1, (lag(crime_count, 7) OVER w)::DOUBLE AS pred_lag_7,
    CASE WHEN count(*) OVER w7 = 7 THEN avg(crime_count) OVER w7 END AS pred_rolling_7,
    CASE WHEN count(*) OVER w30 = 30 THEN avg(crime_count) OVER w30 END AS pred_rolling_30
  FROM pan WINDOW w AS ({part} ORDER BY date),
    w7 AS ({part} ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
    w30 AS ({part} ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
known AS (SELECT * FROM lagged WHERE pred_rolling_30 IS NOT NULL),
tested AS (SELECT * FROM known, lim WHERE date > hi - 90)"""
LABELS = {
    "pred_lag_1": "Naive Previous Day",
    "pred_lag_7": "Seasonal Naive Previous Week",
    "pred_rolling_7": "Rolling Mean 7 Days",
    "pred_rolling_30": "Rolling Mean 30 Days",
}


def lagged(*keys: str) -> str:
    cols = "".join(f", {k}" for k in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return LAGGED.format(cols=cols, part=part)


def metrics(actual: str, predicted: str, digits=(2, 2, 2, 4)) -> str:
    miss = f"({actual} - {predicted})"
    a, b, c, d = digits
    return (
        f"round_even(avg(abs{miss}), {a}) AS mae, round_even(sqrt(avg({miss} ^ 2)), {b}) AS rmse, "
        f"round_even(1e2 * avg(abs({miss} / nullif({actual}, 0))), {c}) AS mape, "
        f"round_even(1 - sum({miss} ^ 2) / nullif(var_pop({actual}) * count({actual}), 0), {d}) AS r2"
    )


def models(*keys: str) -> str:
    cols = "".join(f"{k}, " for k in keys)
    long = " UNION ALL ".join(
        f"SELECT {cols}'{label}' AS model, crime_count, {col} AS p FROM tested" for col, label in LABELS.items()
    )
    return f"models AS (SELECT {cols}model, {metrics('crime_count', 'p')} FROM ({long}) GROUP BY ALL)"


def walk(*keys: str) -> str:
    """Recursive mean forecast as step `ahead`."""
    cols = "".join(f"{k}, " for k in keys)
    return f"""tails AS (
  SELECT {cols}list(crime_count::DOUBLE ORDER BY date) AS h FROM pan, lim WHERE date > hi - 7 GROUP BY ALL),
trail AS (
  SELECT {cols}0 AS step, h FROM tails
  UNION ALL
  SELECT {cols}step + 1, list_append(h, greatest(0, round_even(list_sum(h[-7:]) / 7, 0))) FROM trail WHERE step < 30),
ahead AS (
  SELECT (hi + step)::DATE AS date, step::INTEGER AS forecast_day, {cols}h[-1]::BIGINT AS predicted_crime_count
  FROM trail, lim WHERE step > 0)"""


CITY = steps_for(ORDERS)
CITY_MODELS = ",\n".join([CITY, lagged(), models()])
PAIRS = steps_for(ORDERS, "district", "primary_type")
DETAIL = ",\n".join([PAIRS, walk("district", "primary_type")])


def risk_step(key: str, name: str) -> str:
    """Forecast totals against the zero-filled year before, as step `name`."""
    source = {"district": "areas", "primary_type": "tops"}[key]
    return f"""
{name}_hits AS (SELECT d AS date, {key}, count(*) AS n FROM inc GROUP BY ALL),
{name}_base AS (
  SELECT {key}, round(avg(coalesce(n, 0)) * 30, 2) AS expected_30_day_count
  FROM (SELECT date, {key} FROM cal, {source}) LEFT JOIN {name}_hits USING (date, {key}), lim
  WHERE date > hi - 365 GROUP BY {key}),
{name}_rated AS (
  SELECT {key}, p AS predicted_30_day_crime_count, expected_30_day_count,
         round_even({deviation('p', 'expected_30_day_count')}, 2) AS risk_percent_vs_recent_baseline
  FROM (SELECT {key}, sum(predicted_crime_count)::BIGINT AS p FROM ahead GROUP BY {key})
  LEFT JOIN {name}_base USING ({key})),
{name} AS (SELECT *, {AREA_LEVEL} AS risk_level FROM {name}_rated)"""


CENTERS = """centers AS (
  SELECT district, round(median(latitude), 4) AS latitude, round(median(longitude), 4) AS longitude
  FROM inc WHERE latitude BETWEEN {0} AND {1} AND longitude BETWEEN {2} AND {3} GROUP BY district)"""
ORDER_CENTERS = CENTERS.format(50000, 450000, -500, 9000)
RISK_AREA = ",\n".join([DETAIL, risk_step("district", "by_area")])
RISK_TYPE = ",\n".join([DETAIL, risk_step("primary_type", "by_type")])
SHOWN = f"""risk_percent_vs_recent_baseline AS display_risk_percent,
  {DIRECTION.format('risk_percent_vs_recent_baseline')} AS risk_direction, risk_level"""
AREA_MAP = f"""area_map AS (
  SELECT district, predicted_30_day_crime_count, expected_30_day_count, {SHOWN}, latitude, longitude
  FROM by_area LEFT JOIN centers USING (district))"""
TYPE_SHOWN = f"""type_shown AS (
  SELECT primary_type, predicted_30_day_crime_count, expected_30_day_count, {SHOWN},
         CASE WHEN predicted_30_day_crime_count < 100 THEN 'Low Volume' ELSE 'Stable' END AS risk_confidence
  FROM by_type)"""
RISK_MAP = ",\n".join([RISK_AREA, ORDER_CENTERS, AREA_MAP])
TYPE_RISK = ",\n".join([RISK_TYPE, TYPE_SHOWN])
CITY_AHEAD = ",\n".join([CITY, lagged(), models(), walk()])
SELECTED = CITY_AHEAD + """,
selected AS (
  SELECT strftime(date, '%Y-%m-%d') AS date, forecast_day, predicted_crime_count,
         'Baseline Rolling 7-Day Iterative Forecast' AS model,
         (SELECT model FROM models ORDER BY mae, model LIMIT 1) AS selected_model, 'Baseline' AS model_group,
         NULL::BIGINT AS lower_bound, NULL::BIGINT AS upper_bound
  FROM ahead)"""

# ---------------------------------------------------------------- raw text
_RAW = rawtext.raw_columns(
    "strftime(ts, '%m/%d/%Y %I:%M:%S %p')", "strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p')", "strftime(ts, '%Y-%m-%d %H:%M:%S')"
)
RAW = "raw AS (SELECT " + ",\n  ".join(f'{e} AS "{c}"' for c, e in _RAW.items()) + " FROM events)"


def stamp(column: str) -> str:
    return f"try_strptime(\"{column}\", '%m/%d/%Y %I:%M:%S %p')"


def cast(column: str, kind: str) -> str:
    return f"try_cast(nullif(trim(\"{column}\"), '') AS {kind})"


def flag(column: str) -> str:
    return f"CASE lower(trim(\"{column}\")) WHEN 'true' THEN true WHEN 'false' THEN false END"


CLEAN = RAW + f""",
timed AS (SELECT *, {stamp('Date')} AS t FROM raw),
clean AS (
  SELECT {cast('ID', 'BIGINT')} AS id, "Case Number" AS case_number, t AS crime_datetime, t::DATE AS crime_date,
    hour(t)::INTEGER AS hour, dayofweek(t)::INTEGER AS day_of_week, week(t)::INTEGER AS week_of_year,
    month(t)::INTEGER AS month, year(t)::INTEGER AS year, dayofweek(t) IN (0, 6) AS is_weekend,
    "Block" AS block, "IUCR" AS iucr, "Primary Type" AS primary_type, "Description" AS description,
    "Location Description" AS location_description, {flag('Arrest')} AS arrest, {flag('Domestic')} AS domestic,
    {cast('Beat', 'INTEGER')} AS beat, {cast('District', 'INTEGER')} AS district, {cast('Ward', 'INTEGER')} AS ward,
    {cast('Community Area', 'INTEGER')} AS community_area, "FBI Code" AS fbi_code,
    {cast('X Coordinate', 'DOUBLE')} AS x_coordinate, {cast('Y Coordinate', 'DOUBLE')} AS y_coordinate,
    {cast('Latitude', 'DOUBLE')} AS latitude, {cast('Longitude', 'DOUBLE')} AS longitude,
    "Location" AS location, {stamp('Updated On')} AS updated_on
  FROM timed WHERE t IS NOT NULL)"""
assert len(RAW_COLUMNS) == len(_RAW)

DELIMS = {",": "','", "\t": "chr(9)", "|": "'|'", ";": "';'"}


def hits(text: str, delimiter: str) -> str:
    return f"(length({text}) - length(replace({text}, {delimiter}, '')))"


LINE_COUNTS = "ln AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),\nper AS (" + " UNION ALL ".join(
    f"SELECT {d} AS delimiter, {hits('line', d)} AS k, count(*) AS lines FROM ln WHERE trim(line, ' ') <> '' GROUP BY ALL"
    for d in DELIMS.values()
) + """),
steady AS (
  SELECT delimiter, max({'lines': lines, 'k': k}) FILTER (k > 0) AS top, sum(lines) AS total FROM per GROUP BY delimiter),
rated AS (
  SELECT delimiter, top.k::BIGINT AS per_line, round(coalesce(top.lines, 0) / total::DOUBLE, 6) AS line_share FROM steady)"""

_DAILY = "SELECT d AS date{0}, count(*) AS crime_count FROM inc GROUP BY ALL"

ORACLE: dict[str, str] = {
    # counts and panels
    "daily_city": sql(ORDERS, _DAILY.format("")),
    "daily_area": sql(ORDERS, _DAILY.format(", district")),
    "daily_type": sql(ORDERS, _DAILY.format(", primary_type")),
    "daily_area_type": sql(ORDERS, _DAILY.format(", district, primary_type")),
    "daily_area_lineitem": sql(LINES, _DAILY.format(", district")),
    "daily_from_cube": sql(
        ORDERS,
        """SELECT CASE grouping(district, primary_type)
                    WHEN 3 THEN 'city' WHEN 2 THEN 'type' WHEN 1 THEN 'area' ELSE 'area_type' END AS level,
                  d AS date, district, primary_type, count(*) AS crime_count
           FROM inc GROUP BY GROUPING SETS ((d), (d, district), (d, primary_type), (d, district, primary_type))""",
    ),
    "cube_in_two_loads": sql(ORDERS, "SELECT d AS date, district, primary_type, count(*) AS crime_count, 0::BIGINT AS files_read_again FROM inc GROUP BY ALL"),
    "daily_area_replayed": sql(ORDERS, _DAILY.format(", district")),
    "safe_end_date": sql(f"{ORDERS},\n{BOUNDS}", "SELECT hi AS training_end_date FROM lim"),
    "calendar_days": sql(f"{ORDERS},\n{BOUNDS},\n{CALENDAR}", "SELECT date FROM cal"),
    "future_days": sql(
        f"{ORDERS},\n{BOUNDS}",
        "SELECT (hi + i)::DATE AS date, i AS forecast_day FROM lim, (SELECT unnest(range(1, 31))::INTEGER AS i)",
    ),
    "panel_city": sql(CITY, f"SELECT *, {parts('date')} FROM pan"),
    "panel_area": sql(steps_for(ORDERS, "district"), f"SELECT *, {parts('date')} FROM pan"),
    "panel_type": sql(steps_for(ORDERS, "primary_type"), f"SELECT *, {parts('date')} FROM pan"),
    "panel_area_type": sql(PAIRS, f"SELECT *, {parts('date')} FROM pan"),
    "area_risk_recent": sql(
        steps_for(ORDERS, "district")
        + """,
sides AS (
  SELECT district, sum(crime_count) FILTER (date > hi - 30)::BIGINT AS seen,
         30 * avg(crime_count) FILTER (date <= hi - 30 AND date > hi - 395) AS base
  FROM pan, lim GROUP BY district)""",
        f"""SELECT district, seen AS recent_30_day_count, round(base, 2) AS expected_30_day_count,
              round({deviation('seen', 'base')}, 2) AS risk_percent_vs_recent_baseline,
              {bands(deviation('seen', 'base'), AREA_BANDS, AREA_REST)} AS risk_level FROM sides""",
    ),
    # text and cleaning
    "scan_delimited": sql(
        RAW,
        'SELECT "Case Number" AS case_number, "Description" AS description, "Location" AS location, '
        '"IUCR" AS iucr, "Block" AS block FROM raw',
    ),
    "parse_timestamps": sql(RAW, f'SELECT "Case Number" AS case_number, {stamp("Date")} AS crime_datetime FROM raw'),
    "clean_numbers": sql(
        RAW,
        f"""SELECT "Case Number" AS case_number, {cast('Ward', 'INTEGER')} AS as_int, {cast('Ward', 'BIGINT')} AS as_long,
            {cast('Ward', 'DOUBLE')} AS as_double FROM raw""",
    ),
    "clean_booleans": sql(
        RAW, f'SELECT "Case Number" AS case_number, {flag("Arrest")} AS arrest, {flag("Domestic")} AS domestic FROM raw'
    ),
    "clean_table": sql(CLEAN, "SELECT * FROM clean"),
    "delimiter_profile": " UNION ALL ".join(
        f"SELECT {d} AS delimiter, sum({hits('text', d)})::BIGINT AS occurrences, "
        f"(1 + arg_min({hits('trim(string_split(text, chr(10))[1])', d)}, doc_id))::BIGINT AS first_line_columns FROM documents"
        for d in DELIMS.values()
    ),
    "delimiter_consistency": sql(LINE_COUNTS, "SELECT * FROM rated"),
    "detect_delimiter": sql(
        LINE_COUNTS,
        "SELECT * FROM rated WHERE per_line IS NOT NULL ORDER BY line_share DESC, per_line DESC, delimiter LIMIT 1",
    ),
    "date_parts": f"SELECT l_orderkey, l_linenumber, hour(l_shipdate)::INTEGER AS hour, {parts('l_shipdate')} FROM lineitem",
    "text_functions": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE event_type END AS label,
        upper(event_type) = 'PURCHASE' AS is_purchase, strftime(ts, '%Y-%m-%d') AS iso_date,
        CASE WHEN event_id % 5 >= 2 THEN value END AS ratio, round(greatest(value - 50, 0), 6) AS above_fifty FROM events""",
    # slots and risk
    "slot_counts": sql(f"{EVENTS},\n{SLOTS}", "SELECT * FROM slots"),
    "group_stats": sql(
        f"{EVENTS},\n{SLOTS},\n{STATS}",
        "SELECT district, primary_type, group_total, round(avg_slot_count, 6) AS avg_slot_count FROM stats",
    ),
    "risk_periods": sql(V1, "SELECT * EXCLUDE (group_total) FROM scored"),
    "risk_periods_supported": sql(V2, "SELECT * FROM supported"),
    "area_risk_history": sql(
        ORDERS
        + """,
per_day AS (SELECT district, d, count(*) AS n FROM inc GROUP BY ALL),
sides AS (
  SELECT district, 30 * avg(n) AS base,
         sum(n) FILTER (d > (SELECT max(d) FROM inc) - 30)::BIGINT AS seen FROM per_day GROUP BY district)""",
        f"""SELECT district, seen AS recent_30_day_count, round(base, 2) AS expected_30_day_count,
              round({deviation('seen', 'base')}, 2) AS risk_percent_vs_historical_avg FROM sides WHERE seen IS NOT NULL""",
    ),
    "risk_labels": sql(
        V1,
        f"""SELECT district, primary_type, day_of_week, hour, {SLOT_LEVEL} AS slot_level,
              {bands('risk_percent_vs_group_avg', AREA_BANDS, AREA_REST)} AS area_level,
              {DIRECTION.format('risk_percent_vs_group_avg')} AS risk_direction,
              CASE WHEN crime_count < 3 THEN 'Low Volume' ELSE 'Stable' END AS risk_confidence,
              {DAY_NAME} AS day_name, {HOUR_LABEL} AS hour_label FROM scored""",
    ),
    "area_centroids": sql(f"{ORDERS},\n{ORDER_CENTERS}", "SELECT * FROM centers"),
    "area_centroids_lineitem": sql(f"{LINES},\n{CENTERS.format(0, 120000, -1000, 10000)}", "SELECT * FROM centers"),
    "top_types": sql(
        ORDERS,
        "SELECT primary_type, count(*) AS crime_count FROM inc GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 3",
    ),
    "rolling_median": sql(
        f"{ORDERS},\n{BOUNDS}",
        """SELECT date, n AS crime_count,
             median(n) OVER (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS typical FROM city""",
    ),
    "latest_rows_area": sql(
        ORDERS,
        """SELECT d AS date, district, count(*) AS crime_count FROM inc GROUP BY d, district
           QUALIFY row_number() OVER (PARTITION BY district ORDER BY d DESC) <= 5""",
    ),
    "key_cardinality": sql(
        ORDERS,
        "SELECT count(DISTINCT district) AS distinct_district, count(DISTINCT primary_type) AS distinct_primary_type FROM inc",
    ),
    "key_combinations": sql(ORDERS, "SELECT DISTINCT district, primary_type FROM inc"),
    "top_areas": sql(
        ORDERS, "SELECT district, count(*) AS crime_count FROM inc GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10"
    ),
    # features and simple forecasts
    "lag_features": sql(
        PAIRS
        + """,
feat AS (
  SELECT *, lag(crime_count, 1) OVER s AS lag_1, lag(crime_count, 7) OVER s AS lag_7,
         lag(crime_count, 14) OVER s AS lag_14, lag(crime_count, 30) OVER s AS lag_30,
         round(avg(crime_count) OVER s7, 6) AS rolling_mean_7, round(avg(crime_count) OVER s30, 6) AS rolling_mean_30,
         round(stddev_samp(crime_count) OVER s7, 6) AS rolling_std_7
  FROM pan WINDOW s AS (PARTITION BY district, primary_type ORDER BY date),
    s7 AS (PARTITION BY district, primary_type ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
    s30 AS (PARTITION BY district, primary_type ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))""",
        f"SELECT *, {parts('date')} FROM feat WHERE lag_30 IS NOT NULL",
    ),
    "rolling_full_window": sql(
        steps_for(ORDERS, "district") + ",\n" + lagged("district"),
        """SELECT date, district, crime_count::BIGINT AS crime_count, round(pred_rolling_7, 6) AS mean_7,
             round(pred_rolling_30, 6) AS mean_30 FROM lagged""",
    ),
    "chrono_split": sql(
        steps_for(ORDERS, "district"),
        """SELECT date > hi - 90 AS is_test, district, count(*) AS days, min(date) AS first_date,
             sum(crime_count)::BIGINT AS crime_count FROM pan, lim GROUP BY 1, 2""",
    ),
    "baseline_predictions": sql(
        ",\n".join([CITY, lagged()]),
        "SELECT * REPLACE (round(pred_rolling_7, 6) AS pred_rolling_7, round(pred_rolling_30, 6) AS pred_rolling_30) FROM known",
    ),
    "baseline_metrics": sql(CITY_MODELS, "SELECT * FROM models"),
    "baseline_metrics_area": sql(
        ",\n".join([steps_for(ORDERS, "district"), lagged("district"), models("district")]), "SELECT * FROM models"
    ),
    "baseline_best": sql(CITY_MODELS, "SELECT * FROM models ORDER BY mae, model LIMIT 1"),
    "baseline_test_predictions": sql(
        CITY_MODELS + ",\nbest AS (SELECT model FROM models ORDER BY mae, model LIMIT 1)",
        """SELECT date, crime_count AS actual_crime_count, pred_lag_1 AS naive_previous_day_prediction,
             pred_lag_7 AS seasonal_previous_week_prediction, round(pred_rolling_7, 6) AS rolling_mean_7_prediction,
             round(pred_rolling_30, 6) AS rolling_mean_30_prediction, model AS best_baseline_model,
             round(CASE model """
        + " ".join(f"WHEN '{label}' THEN {col}" for col, label in LABELS.items())
        + " END, 6) AS best_baseline_prediction FROM tested, best",
    ),
    "category_codes": sql(
        ORDERS,
        "SELECT primary_type, (dense_rank() OVER (ORDER BY primary_type) - 1)::INTEGER AS primary_type_code "
        "FROM (SELECT DISTINCT primary_type FROM inc)",
    ),
    "series_totals": sql(
        steps_for(ORDERS, "district"),
        """SELECT district, count(*) AS days, arg_min(crime_count, date)::DOUBLE AS first_value,
             arg_max(crime_count, date)::DOUBLE AS last_value, sum(crime_count)::DOUBLE AS total
           FROM pan, lim WHERE date > hi - 30 GROUP BY district""",
    ),
    "forecast_mean_city": sql(
        ",\n".join([CITY, walk()]),
        "SELECT *, 'Baseline Rolling 7-Day Iterative Forecast' AS model FROM ahead",
        recursive=True,
    ),
    "forecast_mean_area_type": sql(DETAIL, "SELECT * FROM ahead", recursive=True),
    "forecast_rollup_area": sql(
        DETAIL,
        "SELECT date, forecast_day, district, sum(predicted_crime_count)::BIGINT AS predicted_crime_count FROM ahead GROUP BY ALL",
        recursive=True,
    ),
    "forecast_rollup_type": sql(
        DETAIL,
        "SELECT date, forecast_day, primary_type, sum(predicted_crime_count)::BIGINT AS predicted_crime_count "
        "FROM ahead GROUP BY ALL",
        recursive=True,
    ),
    "forecast_rollup_week": sql(
        DETAIL,
        "SELECT date, forecast_day, sum(predicted_crime_count)::BIGINT AS predicted_crime_count "
        "FROM ahead WHERE forecast_day <= 7 GROUP BY ALL",
        recursive=True,
    ),
    "forecast_totals_area": sql(
        DETAIL,
        "SELECT district, sum(predicted_crime_count)::BIGINT AS predicted_30_day_crime_count FROM ahead GROUP BY ALL",
        recursive=True,
    ),
    "forecast_risk_area": sql(RISK_AREA, "SELECT * FROM by_area", recursive=True),
    "forecast_risk_type": sql(RISK_TYPE, "SELECT * FROM by_type", recursive=True),
    "map_points": sql(
        f"{RISK_AREA},\n{ORDER_CENTERS}", "SELECT * FROM by_area LEFT JOIN centers USING (district)", recursive=True
    ),
    "selected_forecast": sql(SELECTED, "SELECT * FROM selected", recursive=True),
    "selected_week": sql(SELECTED, "SELECT * FROM selected WHERE forecast_day <= 7", recursive=True),
    # presentation and quality
    "present_area_map": sql(RISK_MAP, "SELECT * FROM area_map", recursive=True),
    "present_type_risk": sql(TYPE_RISK, "SELECT * FROM type_shown", recursive=True),
    "present_periods_top500": sql(TOP500, "SELECT * FROM top500"),
    "published_round_trip": sql(TOP500, "SELECT * FROM top500"),
    "present_history_area": sql(
        steps_for(ORDERS, "district"), "SELECT strftime(date, '%Y-%m-%d') AS date, district, crime_count FROM pan"
    ),
    "quality_range": sql(
        ORDERS,
        "SELECT min(d) AS min_date, max(d) AS max_date, count(DISTINCT d) AS unique_days, count(*) AS total_records FROM inc",
    ),
    "quality_nulls": sql(
        CLEAN,
        "SELECT count(*) AS total_rows, "
        + ", ".join(
            f"(count(*) - count({c})) AS missing_{c}"
            for c in ("crime_date", "district", "primary_type", "latitude", "longitude")
        )
        + " FROM clean",
    ),
    "quality_yearly": sql(ORDERS, "SELECT year(d)::INTEGER AS year, count(*) AS crime_count FROM inc GROUP BY 1"),
    "quality_latest_days": sql(
        ORDERS, "SELECT d AS date, count(*) AS crime_count FROM inc GROUP BY d ORDER BY d DESC LIMIT 15"
    ),
    "quality_top_periods": sql(
        V1,
        """SELECT * EXCLUDE (group_total) FROM scored
           ORDER BY risk_percent_vs_group_avg DESC, district, primary_type, day_of_week, hour LIMIT 20""",
    ),
    "table_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("orders", "customer", "events", "lineitem")
    )
    + " UNION ALL SELECT 'missing', NULL",
    # views
    "view_city_forecast": sql(SELECTED, "SELECT * FROM selected WHERE forecast_day <= 10", recursive=True),
    "view_city_history": sql(
        CITY, "SELECT strftime(date, '%Y-%m-%d') AS date, crime_count FROM pan, lim WHERE pan.date > hi - 60"
    ),
    "view_area_history": sql(
        steps_for(ORDERS, "district"),
        """SELECT strftime(date, '%Y-%m-%d') AS date, district, crime_count FROM pan, lim
           WHERE district = 7 AND pan.date > hi - 365""",
    ),
    "view_type_history": sql(
        steps_for(EVENTS, "primary_type"),
        """SELECT strftime(date, '%Y-%m-%d') AS date, primary_type, crime_count FROM pan, lim
           WHERE primary_type = 'signup' AND pan.date > hi - 30""",
    ),
    "view_area_risk": sql(
        RISK_MAP, "SELECT * FROM area_map WHERE latitude <> 0 AND longitude <> 0", recursive=True
    ),
    "view_type_risk": sql(TYPE_RISK, "SELECT * FROM type_shown", recursive=True),
    "view_periods": sql(
        PERIODS, f"SELECT * FROM periods WHERE district = 3 AND primary_type = 'click' ORDER BY {PERIOD_ORDER} LIMIT 50"
    ),
    "worst_slot_per_area": sql(
        PERIODS,
        """SELECT * FROM periods WHERE primary_type = 'click' QUALIFY 1 = row_number() OVER (
             PARTITION BY district ORDER BY risk_percent_vs_group_avg DESC, day_name, hour_label)""",
    ),
}

_FEATURES = ORACLE["lag_features"].split("\nSELECT *, day(")[0]
_LEVEL = "SELECT '{0}' AS model, '{1}' AS prediction_level, " + metrics("a", "p", (4, 4, 4, 4)) + " FROM {2}"
ORACLE["evaluate_levels"] = (
    _FEATURES
    + """,
raw_rows AS (SELECT date, district, primary_type, crime_count::DOUBLE AS a, rolling_mean_7 AS p
             FROM feat, lim WHERE lag_30 IS NOT NULL AND date > hi - 90),
by_a AS (SELECT date, district, sum(a) AS a, sum(round_even(p, 2)) AS p FROM raw_rows GROUP BY ALL),
by_t AS (SELECT date, primary_type, sum(a) AS a, sum(round_even(p, 2)) AS p FROM raw_rows GROUP BY ALL)
"""
    + " UNION ALL ".join([
        _LEVEL.format("Mean District + Crime Type", "district_crime_type_daily", "raw_rows"),
        _LEVEL.format("Mean District Forecast", "district_daily", "by_a"),
        _LEVEL.format("Mean Crime Type Forecast", "crime_type_daily", "by_t"),
    ])
)
_CODES = "codes AS (SELECT primary_type, (row_number() OVER (ORDER BY primary_type) - 1)::INTEGER AS primary_type_code FROM tops)"
ORACLE["model_table"] = (
    f"{_FEATURES},\n{_CODES}\n"
    + f"""SELECT date, crime_count, district, primary_type_code,
  {parts('date').replace('dayofweek(date) IN (0, 6) AS', '(dayofweek(date) IN (0, 6))::INTEGER AS')},
  lag_1, lag_7, lag_14, lag_30, rolling_mean_7, rolling_mean_30, rolling_std_7
FROM feat JOIN codes USING (primary_type) WHERE lag_30 IS NOT NULL"""
)
ORACLE["next_day_features"] = sql(
    f"""{PAIRS},\n{_CODES},
one AS (
  SELECT district, primary_type, (max(hi) + 1)::DATE AS day,
    sum(crime_count) FILTER (date = hi)::DOUBLE AS lag_1, sum(crime_count) FILTER (date = hi - 6)::DOUBLE AS lag_7,
    sum(crime_count) FILTER (date = hi - 13)::DOUBLE AS lag_14, sum(crime_count) FILTER (date = hi - 29)::DOUBLE AS lag_30,
    round(avg(crime_count) FILTER (date > hi - 7), 6) AS rolling_mean_7,
    round(avg(crime_count) FILTER (date > hi - 30), 6) AS rolling_mean_30,
    round(stddev_samp(crime_count) FILTER (date > hi - 7), 6) AS rolling_std_7
  FROM pan, lim GROUP BY district, primary_type)""",
    f"""SELECT * EXCLUDE (day, primary_type),
  {parts('one.day').replace('dayofweek(one.day) IN (0, 6) AS', '(dayofweek(one.day) IN (0, 6))::INTEGER AS')}
FROM one JOIN codes USING (primary_type)""",
)
ORACLE["ar_gram"] = sql(
    CITY
    + """,
diffs AS (
  SELECT date, '1,0,7' AS differencing, (crime_count - lag(crime_count) OVER o)::DOUBLE AS w FROM pan
  WINDOW o AS (ORDER BY date)
  UNION ALL
  SELECT date, '1,1,7', (crime_count - lag(crime_count) OVER o - lag(crime_count, 7) OVER o
                         + lag(crime_count, 8) OVER o)::DOUBLE
  FROM pan WINDOW o AS (ORDER BY date)),
known AS (SELECT * FROM diffs WHERE w IS NOT NULL)""",
    f"""SELECT a.differencing, (SELECT count(*) FROM known k WHERE k.differencing = a.differencing) AS n,
  (a.date - b.date)::INTEGER AS lag, sum(a.w * b.w) AS product
FROM known a JOIN known b ON a.differencing = b.differencing AND b.date BETWEEN a.date - {LONG_AR} AND a.date
GROUP BY a.differencing, (a.date - b.date)::INTEGER""",
)

_REPEATS = ", ".join(f"'{label}'" for column, label in LABELS.items() if "lag" in column)
_BOARD = ",\n".join([
    steps_for(ORDERS, "district"), lagged("district"), models("district"),
    f"""board AS (
  SELECT *, CASE WHEN model_group = 'Repeats' THEN 'only here' END AS note
  FROM (SELECT *, CASE WHEN model IN ({_REPEATS}) THEN 'Repeats' ELSE 'Means' END AS model_group FROM models)
  QUALIFY 1 = row_number() OVER (PARTITION BY district, model_group ORDER BY mae, model))""",
])
ORACLE["leaderboard_baseline"] = ORACLE["view_leaderboard"] = sql(_BOARD, "SELECT * FROM board")

_CITY_SIDE = SELECTED.replace("pan AS", "city_pan AS").replace("hits AS", "city_hits AS").replace(
    "LEFT JOIN hits", "LEFT JOIN city_hits").replace("FROM pan", "FROM city_pan").replace("ahead", "city_ahead").replace(
    "trail", "city_trail").replace("tails", "city_tails")
_AREA_SIDE = ",\n".join([
    AREAS, TOPS, panel("district", "primary_type"), walk("district", "primary_type"),
    risk_step("district", "by_area"), risk_step("primary_type", "by_type"), ORDER_CENTERS, AREA_MAP, TYPE_SHOWN,
    "top_a AS (SELECT * FROM area_map ORDER BY display_risk_percent DESC NULLS LAST, district LIMIT 1)",
    "top_t AS (SELECT * FROM type_shown ORDER BY display_risk_percent DESC NULLS LAST, primary_type LIMIT 1)",
])
ORACLE["summary_flat"] = sql(
    f"{_CITY_SIDE},\n{_AREA_SIDE}",
    """SELECT (SELECT min(d)::VARCHAR FROM inc) AS raw_data_start_date, (SELECT max(d)::VARCHAR FROM inc) AS raw_data_end_date,
  lo::VARCHAR AS model_training_start_date, hi::VARCHAR AS model_training_end_date,
  (SELECT count(*) FROM inc) AS total_clean_records, (SELECT count(*) FROM cal) AS total_training_days,
  (SELECT any_value(selected_model) FROM selected) AS best_citywide_model, 'Baseline' AS best_citywide_model_group,
  (SELECT sum(predicted_crime_count)::BIGINT FROM selected WHERE forecast_day <= 7) AS forecast_7_day_total,
  (SELECT sum(predicted_crime_count)::BIGINT FROM selected) AS forecast_30_day_total,
  a.district AS area_district, a.predicted_30_day_crime_count AS area_predicted_30_day_crime_count,
  a.display_risk_percent AS area_risk_percent, a.risk_level AS area_risk_level,
  t.primary_type AS type_primary_type, t.predicted_30_day_crime_count AS type_predicted_30_day_crime_count,
  t.display_risk_percent AS type_risk_percent, t.risk_level AS type_risk_level, t.risk_confidence AS type_risk_confidence
FROM lim, top_a a, top_t t""",
    recursive=True,
)

ORACLE["summary_round_trip"] = ORACLE["summary_flat"]

_HISTORY = """per_day AS (SELECT district, d, count(*) AS n FROM inc GROUP BY ALL),
sides AS (
  SELECT district, 30 * avg(n) AS base,
         sum(n) FILTER (d > (SELECT max(d) FROM inc) - 30)::BIGINT AS seen FROM per_day GROUP BY district)"""
_SLOT_COLUMNS = """day_name, hour_label, crime_count, risk_percent_vs_group_avg, risk_level AS period_level"""
ORACLE["area_detail"] = sql(
    f"{PERIODS},\n{_HISTORY}",
    f"""SELECT * FROM (
  SELECT district, seen AS recent_30_day_count, round(base, 2) AS expected_30_day_count,
         round({deviation('seen', 'base')}, 2) AS risk_percent_vs_historical_avg FROM sides WHERE district = 2)
LEFT JOIN (
  SELECT district, primary_type, {_SLOT_COLUMNS} FROM periods
  WHERE district = 2 AND (primary_type = 'view'
    OR NOT EXISTS (SELECT 1 FROM periods WHERE district = 2 AND primary_type = 'view'))
  ORDER BY {PERIOD_ORDER} LIMIT 12) USING (district)""",
)
ORACLE["type_detail"] = sql(
    PERIODS,
    f"""SELECT * FROM (SELECT primary_type, count(*) AS total_count FROM inc WHERE primary_type = 'click' GROUP BY 1)
LEFT JOIN (
  SELECT primary_type, district, {_SLOT_COLUMNS} FROM periods WHERE primary_type = 'click'
  ORDER BY {PERIOD_ORDER} LIMIT 15) USING (primary_type)""",
)

ORACLE["raw_line_accounts"] = """SELECT outcome, sum(n)::BIGINT AS lines FROM (
  SELECT CASE event_id % 7 WHEN 0 THEN 'set aside' WHEN 2 THEN 'set aside' WHEN 4 THEN 'dropped'
         WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'clean' ELSE 'dropped' END ELSE 'clean' END AS outcome,
         CASE WHEN event_id % 7 = 2 THEN 2 ELSE 1 END AS n FROM events) GROUP BY outcome"""
ORACLE["distinct_orders_by_year"] = """SELECT l_returnflag, year(l_shipdate)::INTEGER AS year, count(DISTINCT l_orderkey) AS orders,
  true AS close, true AS no_more_than_the_days FROM lineitem GROUP BY ALL"""
ORACLE["median_price_by_year"] = """SELECT l_returnflag, year(l_shipdate)::INTEGER AS year, count(*) AS n_lines, true AS close
FROM lineitem GROUP BY ALL"""
ORACLE["lag_features_sparse"] = ORACLE["lag_features_stored"] = ORACLE["lag_features"]
ORACLE["forecast_mean_stored"] = ORACLE["forecast_mean_area_type"]
ORACLE["raw_records"] = f"""SELECT event_id, user_id, md5(note) AS digest, len(note) - len(replace(note, chr(10), '')) + 1 AS n_lines
FROM (SELECT event_id, user_id, {rawtext.NOTE} AS note FROM events)"""
ORACLE["preview_lines"] = """SELECT substr(line, 1, 1000) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents) ORDER BY doc_id, place LIMIT 5"""
ORACLE["describe_columns"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS column_type, count({c}) AS n_values, "
    f"sum(({c} IS NULL)::BIGINT)::BIGINT AS n_missing, count(DISTINCT {c}) AS n_distinct FROM events"
    for c, k in (
        ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
        ("value", "double"), ("props", "string"),
    )
)
ORACLE["stored_table"] = ORACLE["daily_city"]
ORACLE["registered_view"] = ORACLE["daily_area"]
ORACLE["sorted_export"] = ORACLE["panel_area"]
ORACLE["guard_outcomes"] = sql(
    steps_for(ORDERS, "district"),
    """SELECT request, outcome, (SELECT count(*) FROM pan) AS days FROM (VALUES ('known', '30 rows'),
  ('unknown', 'no history found for district 99'), ('small limit', 'limit must be at least 30')) AS t(request, outcome)""",
)
ORACLE["gbt_facts"] = sql(
    PAIRS,
    """SELECT count(DISTINCT (district, primary_type)) AS series, 30::BIGINT AS days, min(hi) + 1 AS first_day,
  min(hi) + 30 AS last_day, 30 * count(DISTINCT (district, primary_type)) AS n_rows, true AS none_below_zero, true AS adds_up
FROM pan, lim""",
)
