"""The registered queries as plain SQL over the given tables."""

from __future__ import annotations

from isobar.schemas import (CYCLONE_FEATURES, HEATWAVE_FEATURES, HEATWAVE_RULES,
                            RAINFALL_FEATURES)

STATION = """station_daily AS (
  SELECT n.n_name AS city, r.r_name AS zone, CAST(l.l_shipdate AS DATE) AS time,
         MAX(l.l_quantity) AS temp_max, MIN(l.l_quantity) AS temp_min,
         ROUND(AVG(l.l_quantity), 6) AS temp_mean,
         ROUND(SUM(l.l_extendedprice), 2) AS precipitation,
         ROUND(MAX(l.l_discount) * 500, 6) AS wind_speed_10m_max,
         ROUND(MAX(l.l_discount) * 1000, 6) AS wind_gust_max,
         ROUND(1000 + MIN(l.l_tax) * 100, 6) AS pressure_msl_mean,
         CAST(SUM(l.l_suppkey) % 100 AS DOUBLE) AS relative_humidity_2m_mean,
         CAST(SUM(l.l_partkey) % 100 AS DOUBLE) AS cloud_cover_mean
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY n.n_name, r.r_name, CAST(l.l_shipdate AS DATE))"""

TRACKS = """track_points AS (
  SELECT event_id AS point_id, user_id AS storm_id, ts AS iso_time,
         CASE event_type WHEN 'click' THEN 'TS' WHEN 'view' THEN 'mx'
                         WHEN 'purchase' THEN 'ET' WHEN 'signup' THEN 'DS' END AS nature,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS wmo_wind, value AS usa_wind,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE ROUND(1010 - value * 0.5, 4) END AS wmo_pres,
         CAST(user_id % 60 - 30 AS DOUBLE) AS lat, CAST(60 + event_id % 40 AS DOUBLE) AS lon,
         CAST(event_id % 500 AS DOUBLE) AS dist2land
  FROM events)"""

CATEGORY = ("CASE WHEN {0} >= 113 THEN 5 WHEN {0} >= 96 THEN 4 WHEN {0} >= 83 THEN 3 "
            "WHEN {0} >= 64 THEN 2 WHEN {0} >= 34 THEN 1 ELSE 0 END")


def category(wind: str) -> str:
    return CATEGORY.format(wind)


def prepared(wind: str = "wmo_wind") -> str:
    return f"""prepared AS (
  SELECT *, COALESCE({wind}, 0) AS wind_kts, {category(wind)} AS category,
         wmo_pres AS pressure_min, ABS(lat) AS lat_abs, dist2land AS dist_to_land
  FROM track_points WHERE COALESCE(regexp_matches(UPPER(nature), 'TS|MX'), FALSE))"""


PARTS = """CAST(YEAR({0}) AS INT) AS year, CAST(MONTH({0}) AS INT) AS month,
  CAST(DAY({0}) AS INT) AS day, CAST(DAYOFYEAR({0}) AS INT) AS dayofyear"""

LOG = """prediction_log AS (
  SELECT event_id AS id, event_type AS model_name, ts, value AS f_value,
         CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS f_k FROM events)"""

W = "(PARTITION BY city ORDER BY time)"
HEAT = """heat AS (
  SELECT *, CAST(SUM(CASE WHEN temp_max > 40 THEN 1 ELSE 0 END) OVER w >= 3 AS INT)
              AS heatwave_flag,
         CAST(SUM(CASE WHEN temp_max > 45 THEN 1 ELSE 0 END) OVER w >= 3 AS INT)
              AS severe_heatwave_flag
  FROM station_daily
  WINDOW w AS (PARTITION BY city ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
RAIN = """rain AS (
  SELECT city, QUANTILE_CONT(precipitation, 0.95) AS p95, QUANTILE_CONT(precipitation, 0.99) AS p99
  FROM station_daily GROUP BY city)"""
LABELLED = """labelled AS (
  SELECT h.*, CAST(precipitation > p95 AS INT) AS extreme_rainfall,
         CAST(precipitation > p99 AS INT) AS heavy_rainfall,
         CAST(wind_gust_max > 60 AND pressure_msl_mean < 1005 AS INT) AS cyclonic_flag
  FROM heat h JOIN rain USING (city))"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


STATIONS = ctes(STATION)
EVENTS = ctes(STATION, HEAT, RAIN, LABELLED)
STORMS = ctes(TRACKS, prepared())

LAG_COLUMNS = ["temp_max", "temp_min", "precipitation", "wind_speed_10m_max"]
LAGS = {f"{c}_lag_{k}": f"LAG({c}, {k}) OVER {W}" for c in LAG_COLUMNS for k in (1, 3, 7)}


def rolling(current: bool) -> dict[str, str]:
    out = {}
    for w in (3, 7):
        frame = (f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW" if current
                 else f"ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING")
        over = f"OVER (PARTITION BY city ORDER BY time {frame})"
        for c in ("temp_max", "precipitation"):
            out[f"{c}_roll_mean_{w}"] = f"AVG({c}) {over}"
            out[f"{c}_roll_std_{w}"] = f"COALESCE(STDDEV_SAMP({c}) {over}, 0)"
    return out


def listed(exprs: dict[str, str], digits: int | None = None) -> str:
    return ", ".join(f"{e if digits is None else f'ROUND({e}, {digits})'} AS {n}"
                     for n, e in exprs.items())


SEASON = {"month": "CAST(MONTH(time) AS INT)", "dayofyear": "CAST(DAYOFYEAR(time) AS INT)",
          "month_sin": "SIN(2 * PI() * MONTH(time) / 12)",
          "month_cos": "COS(2 * PI() * MONTH(time) / 12)"}
FEATURES = f"""features AS (
  SELECT *, {listed(LAGS)}, {listed(rolling(False))}, {listed(SEASON)},
         LEAD(heatwave_flag) OVER {W} AS heatwave_next,
         LEAD(extreme_rainfall) OVER {W} AS rain_next
  FROM labelled)"""
ROUNDED = {*rolling(False), "month_sin", "month_cos"}
WIDE = EVENTS.rstrip() + ",\n" + FEATURES + "\n"


def matrix(features: list[str], target: str) -> str:
    rows = f"rows AS (SELECT * FROM features WHERE {target} IS NOT NULL)"
    medians = "medians AS (SELECT " + ", ".join(
        f"MEDIAN({c}) AS m_{c}" for c in features) + " FROM rows)"
    picks = {c: f"COALESCE(CAST({c} AS DOUBLE), m_{c}, 0)" for c in features}
    cols = ", ".join(
        f"{f'ROUND({e}, 4)' if '_lag_' in c or '_roll_' in c or c in ROUNDED else e} AS {c}"
        for c, e in picks.items())
    return (WIDE.rstrip() + f",\n{rows},\n{medians}\n"
            f"SELECT city, time, {cols}, {target} AS label FROM rows CROSS JOIN medians")


BATCHES = """two_batches AS (
  SELECT city, time, precipitation, '9' AS batch_id FROM station_daily
  WHERE time < DATE '1999-01-01'
  UNION ALL
  SELECT city, time, ROUND(precipitation + 1, 2), '10' FROM station_daily
  WHERE time >= DATE '1998-01-01')"""
MERGED = """merged AS (
  SELECT city, time, precipitation, batch_id FROM two_batches
  QUALIFY ROW_NUMBER() OVER (PARTITION BY city, time ORDER BY CAST(batch_id AS INT) DESC) = 1)"""
STORED = ctes(STATION, BATCHES, MERGED) + """
SELECT 'stored' AS kind, city, COUNT(*) AS n_rows, MIN(time) AS earliest, MAX(time) AS latest,
       ROUND(SUM(precipitation), 2) AS precipitation FROM merged GROUP BY city
UNION ALL
SELECT 'quarantined', city, COUNT(*), NULL, NULL, ROUND(SUM(p), 2)
FROM (SELECT city, batch_id, MAX(precipitation) AS p FROM two_batches GROUP BY city, batch_id)
GROUP BY city"""
UPSERT = ctes(STATION, BATCHES, MERGED) + "SELECT * FROM merged"

LEDGER = """states AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS started_at,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END
           AS status,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN o_custkey ELSE 0 END AS rows_ingested,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN CAST(o_orderkey % 90 + 1 AS DOUBLE) END
           AS minutes,
         CASE WHEN o_orderstatus = 'P'
              THEN SUBSTRING(RPAD('batch ' || CAST(o_orderkey AS VARCHAR), 500, '.'), 1, 200) END
           AS error_message
  FROM orders)"""

SCORED = """scored AS (
  SELECT city, time, heatwave_flag AS label, (temp_max % 10) / CAST(10 AS DOUBLE) AS score,
         CAST((temp_max % 10) / CAST(10 AS DOUBLE) >= 0.5 AS INT) AS prediction FROM heat)"""
HEAT_SCORED = ctes(STATION, HEAT, SCORED)

RAW = ", ".join(f"CAST(1 + (point_id * {c + 3} + storm_id * 7) % 11 AS DOUBLE) AS r{c}"
                for c in range(6))
TOTAL = " + ".join(f"r{c}" for c in range(6))
GRADED = f"""graded AS (
  SELECT point_id, label, prediction, {', '.join(f'r{c} / ({TOTAL}) AS p{c}' for c in range(6))}
  FROM (SELECT point_id, category AS label, {category('usa_wind')} AS prediction, {RAW}
        FROM prepared) q)"""
GRADES = ctes(TRACKS, prepared(), GRADED)
CELLS = """classes AS (
  SELECT class, SUM(support) AS support, SUM(predicted) AS predicted, SUM(tp) AS tp FROM (
    SELECT label AS class, 1 AS support, 0 AS predicted, CAST(label = prediction AS INT) AS tp
    FROM graded UNION ALL SELECT prediction, 0, 1, 0 FROM graded) u GROUP BY class),
rates AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / predicted END AS prec,
         CASE WHEN support = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / support END AS rec FROM classes),
scores AS (
  SELECT *, CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END AS f FROM rates)
"""


def auc(rows: str, by: str) -> str:
    """Mann-Whitney area with mid-ranks over ``rows(class, score, pos)``."""
    return f"""{rows},
ranked AS (
  SELECT class, pos, RANK() OVER (PARTITION BY class ORDER BY score)
         + (COUNT(*) OVER (PARTITION BY class, score) - 1) / CAST(2 AS DOUBLE) AS r FROM rows),
sums AS (
  SELECT class, SUM(CASE WHEN pos THEN r ELSE 0 END) AS rs,
         CAST(SUM(CASE WHEN pos THEN 1 ELSE 0 END) AS DOUBLE) AS p,
         CAST(SUM(CASE WHEN pos THEN 0 ELSE 1 END) AS DOUBLE) AS n FROM ranked GROUP BY class),
areas AS (
  SELECT class, CASE WHEN p = 0 OR n = 0 THEN 0.5
                     ELSE (rs - p * (p + 1) / 2) / (p * n) END AS area FROM sums)
{by}"""


BY_CLASS = "rows AS (" + " UNION ALL ".join(
    f"SELECT {c} AS class, p{c} AS score, label = {c} AS pos FROM graded" for c in range(6)) + ")"
EPS = "CAST(2.220446049250313e-16 AS DOUBLE)"


def decision(p: str) -> str:
    return f"ROUND(GREATEST({p}, 1 - {p}), 3) AS confidence"


SIDED = """sided AS (
  SELECT model_name, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'current' END
         AS side, feature, value
  FROM (SELECT model_name, ts, 'f_value' AS feature, f_value AS value FROM prediction_log
        UNION ALL SELECT model_name, ts, 'f_k', f_k FROM prediction_log) u
  WHERE value IS NOT NULL)"""
KS = """counts AS (
  SELECT model_name, feature, value, SUM(CASE WHEN side = 'reference' THEN 1 ELSE 0 END) AS a,
         SUM(CASE WHEN side = 'current' THEN 1 ELSE 0 END) AS b
  FROM sided GROUP BY model_name, feature, value),
curves AS (
  SELECT *, SUM(a) OVER w AS ca, SUM(b) OVER w AS cb,
         SUM(a) OVER (PARTITION BY model_name, feature) AS na,
         SUM(b) OVER (PARTITION BY model_name, feature) AS nb
  FROM counts WINDOW w AS (PARTITION BY model_name, feature ORDER BY value)),
ks AS (
  SELECT model_name, feature, CAST(MAX(na) AS BIGINT) AS n_ref, CAST(MAX(nb) AS BIGINT) AS n_cur,
         MAX(ABS(CAST(ca AS DOUBLE) / na - CAST(cb AS DOUBLE) / nb)) AS statistic
  FROM curves WHERE na >= 10 AND nb >= 10 GROUP BY model_name, feature)"""
PVALUE = """tested AS (
  SELECT *, CASE WHEN x < 0.1 THEN 1.0 ELSE LEAST(GREATEST(2 * list_sum(list_transform(
           range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END)
                          * EXP(-2.0 * k * k * x * x))), 0.0), 1.0) END AS p_value
  FROM (SELECT *, statistic * SQRT(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) AS x
        FROM ks) q)"""
WINDOWED = """recent AS (
  SELECT id, model_name, f_value, f_k,
         ROW_NUMBER() OVER (PARTITION BY model_name ORDER BY id DESC) AS age
  FROM prediction_log QUALIFY age <= 500),
split AS (
  SELECT *, CASE WHEN samples - age + 1 <= (samples * 2) // 3 THEN 'reference' ELSE 'current' END
         AS side
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY model_name) AS samples FROM recent) q)"""
WINDOW_SIDED = """sided AS (
  SELECT * FROM (
    SELECT model_name, side, 'f_value' AS feature, f_value AS value FROM split WHERE samples >= 20
    UNION ALL SELECT model_name, side, 'f_k', f_k FROM split WHERE samples >= 20) u
  WHERE value IS NOT NULL)"""

ORACLE: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLE[name] = sql


BY = ("CAST(SUM(heatwave_flag) AS BIGINT) AS heatwaves, "
      "CAST(SUM(extreme_rainfall) AS BIGINT) AS extreme_rainfall")
add("events_by_zone", EVENTS + f"SELECT zone, {BY} FROM labelled GROUP BY zone")
add("events_by_month", EVENTS
    + f"SELECT CAST(MONTH(time) AS INT) AS month, {BY} FROM labelled GROUP BY 1")
add("events_by_city", EVENTS
    + f"SELECT city, {BY} FROM labelled GROUP BY city ORDER BY heatwaves DESC, city")
SUMMARY = """SELECT CAST(SUM(heatwave_flag) AS BIGINT) AS heatwave_days,
  CAST(SUM(severe_heatwave_flag) AS BIGINT) AS severe_heatwave_days,
  CAST(SUM(extreme_rainfall) AS BIGINT) AS extreme_rain_days,
  CAST(SUM(cyclonic_flag) AS BIGINT) AS cyclonic_days FROM """
add("event_summary", EVENTS + SUMMARY + "labelled")
add("weather_etl_table", WIDE + SUMMARY + "features WHERE COALESCE("
    + ", ".join(LAGS) + ") IS NOT NULL")
add("label_heatwave", ctes(STATION, HEAT)
    + "SELECT city, time, temp_max, heatwave_flag, severe_heatwave_flag FROM heat")
add("label_rainfall", EVENTS
    + "SELECT city, time, precipitation, extreme_rainfall, heavy_rainfall FROM labelled")
add("label_rainfall_default", ctes(STATION, RAIN) + """
SELECT d.city, time, precipitation,
       CAST(COALESCE(precipitation > COALESCE(p95, 50), false) AS INT) AS extreme_rainfall,
       CAST(COALESCE(precipitation > COALESCE(p99, 100), false) AS INT) AS heavy_rainfall
FROM station_daily d LEFT JOIN (
  SELECT * FROM rain WHERE ASCII(RIGHT(city, 1)) % 2 = 0) r ON r.city = d.city""")
add("label_cyclonic", EVENTS
    + "SELECT city, time, wind_gust_max, pressure_msl_mean, cyclonic_flag FROM labelled")
BASE = ["city", "zone", "time", "temp_max", "temp_min", "temp_mean", "precipitation",
        "wind_speed_10m_max", "wind_gust_max", "pressure_msl_mean", "relative_humidity_2m_mean",
        "cloud_cover_mean", "heatwave_flag", "severe_heatwave_flag", "extreme_rainfall",
        "heavy_rainfall", "cyclonic_flag", "month", "dayofyear", *LAGS]
add("weather_features", WIDE + f"SELECT {', '.join(BASE)}, "
    + ", ".join(f"ROUND({c}, 4) AS {c}" for c in sorted(ROUNDED))
    + f" FROM features WHERE COALESCE({', '.join(LAGS)}) IS NOT NULL")

add("weather_features_incremental", ORACLE["weather_features"])
add("lag_features", STATIONS
    + f"SELECT city, time, {', '.join(LAG_COLUMNS)}, {listed(LAGS)} FROM station_daily")
for name, current in (("rolling_prior", False), ("rolling_inclusive", True)):
    add(name, STATIONS + "SELECT city, time, temp_max, precipitation, "
        + listed(rolling(current), 4) + " FROM station_daily")
add("streak_length", STATIONS + f"""
SELECT city, time, temp_max, CAST(CASE WHEN hot = 0 THEN 0 ELSE SUM(hot) OVER (
         PARTITION BY city, grp ORDER BY time) END AS INT) AS streak
FROM (SELECT *, SUM(1 - hot) OVER {W} AS grp
      FROM (SELECT city, time, temp_max, CASE WHEN temp_max > 40 THEN 1 ELSE 0 END AS hot
            FROM station_daily) a) b""")
add("streak_length_gaps", STATIONS + f"""
SELECT city, time, temp_max, CAST(CASE WHEN hot = 0 THEN 0 ELSE SUM(hot) OVER (
         PARTITION BY city, grp ORDER BY time) END AS INT) AS streak
FROM (SELECT *, SUM(CASE WHEN hot = 0 OR time - before > 1 THEN 1 ELSE 0 END) OVER {W} AS grp
      FROM (SELECT city, time, temp_max, LAG(time) OVER {W} AS before,
                   CASE WHEN temp_max > 20 THEN 1 ELSE 0 END AS hot FROM station_daily) a) b""")
add("next_day_target", ctes(STATION, HEAT) + f"""
SELECT * FROM (SELECT city, time, temp_max, heatwave_flag, severe_heatwave_flag,
                      LEAD(heatwave_flag) OVER {W} AS label FROM heat) q
WHERE label IS NOT NULL""")
add("monthly_trend", STATIONS + """
SELECT city, month, ROUND(m, 6) AS monthly_mean,
       ROUND(CASE WHEN COUNT(m) OVER w = 12 THEN AVG(m) OVER w END, 6) AS annual_mean
FROM (SELECT city, CAST(DATE_TRUNC('month', time) AS DATE) AS month, AVG(temp_max) AS m
      FROM station_daily GROUP BY ALL) q
WINDOW w AS (PARTITION BY city ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
GRID = """SELECT city, CAST(UNNEST(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY)) AS DATE)
  AS time FROM station_daily GROUP BY city"""
add("date_grid", STATIONS + GRID)
add("gap_report", STATIONS + f"""
SELECT city, time + 1 AS gap_start, following - 1 AS gap_end,
       CAST(following - time - 1 AS INT) AS missing_days
FROM (SELECT city, time, LEAD(time) OVER {W} AS following FROM station_daily) q
WHERE following - time > 1""")
add("entity_percentiles", ctes(STATION, RAIN) + """
SELECT city, ROUND(p95, 4) AS rain_q_low, ROUND(p99, 4) AS rain_q_high FROM rain""")

add("scan_station_filter", STATIONS + """
SELECT city, time, temp_max, precipitation FROM station_daily WHERE city = 'NATION_7'""")
add("scan_station_csv", STATIONS + """
SELECT city, time, temp_max, temp_min, precipitation, wind_gust_max, pressure_msl_mean
FROM station_daily""")
PREPARED = f"""SELECT {{0}}{PARTS.format('iso_time')}, wind_kts, category, pressure_min,
       lat, lat_abs, lon, dist_to_land FROM prepared"""
for name in ("scan_tracks_csv", "scan_tracks_zip"):
    add(name, STORMS + PREPARED.format(""))
add("scan_paged_orders", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
add("scan_daily_json", STATIONS.rstrip() + """,
years AS (SELECT city, YEAR(time) AS y, MIN(time) AS a, MAX(time) AS z FROM station_daily
          GROUP BY ALL),
days AS (SELECT city, CAST(UNNEST(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS time
         FROM years)
SELECT d.city, d.time, temp_max AS temperature_2m_max, precipitation AS precipitation_sum,
       cloud_cover_mean, CAST(NULL AS DOUBLE) AS rain_sum
FROM days d LEFT JOIN station_daily s ON d.city = s.city AND d.time = s.time""")
add("project_available", STATIONS + """
SELECT time, city, temp_max, zone, 'soil_moisture,snowfall_sum' AS missing FROM station_daily""")
add("dim_station_table", """
SELECT n_nationkey AS station_id, n_name AS city, r_name AS zone
FROM nation JOIN region ON n_regionkey = r_regionkey""")
add("union_by_name", STATIONS + """
SELECT city, time, temp_max, CAST(NULL AS DOUBLE) AS precipitation FROM station_daily
WHERE time < DATE '1998-01-01'
UNION ALL
SELECT city, time, NULL, precipitation FROM station_daily WHERE time >= DATE '1998-01-01'""")

add("rename_columns", STATIONS + """
SELECT city, time, temp_max, temp_min, temp_mean, precipitation, wind_gust_max
FROM station_daily""")
add("coerce_numeric", """
SELECT event_id AS point_id,
       CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN ' '
            WHEN event_id % 11 = 0 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS reading,
       CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL
            ELSE value END AS value,
       CAST(0 AS DOUBLE) AS other
FROM events""")
add("first_present", ctes(TRACKS) + """
SELECT point_id, wmo_wind AS by_column, COALESCE(wmo_wind, usa_wind) AS by_row
FROM track_points""")
add("date_parts", f"""
SELECT point_id, {PARTS.format('ts')}
FROM (SELECT event_id AS point_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS ts
      FROM events) q""")
add("seasonal_features", STATIONS + f"""
SELECT city, time, {SEASON['month']} AS month, {SEASON['dayofyear']} AS dayofyear,
       ROUND({SEASON['month_sin']}, 6) AS month_sin, ROUND({SEASON['month_cos']}, 6) AS month_cos
FROM station_daily""")
add("attach_dimension", STATIONS + """
SELECT s.city, s.time, s.temp_max, CASE WHEN zone <> 'REGION_1' THEN zone END AS zone
FROM station_daily s""")
add("filter_nature", STORMS + "SELECT point_id, nature FROM prepared")
add("drop_all_null", ctes(TRACKS) + """
SELECT point_id, wmo_wind, wmo_pres FROM track_points
WHERE wmo_wind IS NOT NULL OR wmo_pres IS NOT NULL""")
add("validate_features", STORMS + """
SELECT point_id, ROUND(pressure_min, 4) AS pressure_min,
       CASE WHEN pressure_min IS NULL THEN 'pressure_min: required'
            WHEN pressure_min < 850 THEN 'pressure_min: below 850'
            WHEN pressure_min > 1050 THEN 'pressure_min: above 1050' ELSE '' END AS violations
FROM prepared""")
add("align_features", STORMS + """
SELECT point_id, lat_abs, lon, lat, pressure_min, dist_to_land,
       CAST(YEAR(iso_time) AS INT) AS year, CAST(MONTH(iso_time) AS INT) AS month,
       CAST(DAYOFYEAR(iso_time) AS INT) AS dayofyear
FROM prepared""")
add("check_unique_key", """
SELECT l_suppkey, l_partkey, COUNT(*) AS n_rows FROM lineitem
GROUP BY l_suppkey, l_partkey HAVING COUNT(*) > 1""")

add("cyclone_prepare", STORMS + PREPARED.format("point_id, "))
add("cyclone_category", ctes(TRACKS)
    + f"SELECT point_id, wmo_wind, {category('wmo_wind')} AS category FROM track_points")
add("category_text", """
SELECT event_id AS point_id, CAST(event_id % 8 AS INT) AS category,
       CASE WHEN event_id % 8 = 0 THEN 'Tropical Depression'
            WHEN event_id % 8 <= 5 THEN 'Category ' || CAST(event_id % 8 AS VARCHAR)
            ELSE 'Unknown (category ' || CAST(event_id % 8 AS VARCHAR) || ')' END AS description
FROM events""")
add("class_distribution", STORMS
    + "SELECT category, COUNT(*) AS n FROM prepared GROUP BY category")
add("leakage_corr", ctes(TRACKS, prepared("COALESCE(wmo_wind, usa_wind)")) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(CORR({c}, category), 6) AS correlation FROM prepared"
    for c in ("pressure_min", "lat_abs", "dist_to_land")))
add("mean_by_class", STORMS + """
SELECT category, ROUND(AVG(pressure_min), 6) AS mean_pressure_min, COUNT(pressure_min) AS n
FROM prepared GROUP BY category""")

add("coverage_by_city", STATIONS + """
SELECT city, COUNT(*) AS n_rows FROM station_daily GROUP BY city ORDER BY n_rows, city""")
add("coverage_rollup", STATIONS
    + "SELECT city, COUNT(*) AS n_rows FROM station_daily GROUP BY ROLLUP (city)")
add("distinct_entities", STATIONS + "SELECT DISTINCT city FROM station_daily")
EXTENT = """SELECT city, COUNT(*) AS n_rows, MIN(time) AS earliest, MAX(time) AS latest
FROM station_daily GROUP BY city"""
add("entity_extent", STATIONS + EXTENT)
add("freshness_status", STATIONS.rstrip() + f""",
extent AS ({EXTENT})
SELECT n_name AS city, COALESCE(n_rows, 0) AS n_rows, earliest, latest,
       CAST(DATE '2001-11-05' - latest AS INT) AS days_old,
       CASE WHEN latest IS NULL THEN 'empty' WHEN DATE '2001-11-05' - latest > 7 THEN 'stale'
            WHEN DATE '2001-11-05' - latest > 2 THEN 'aging' ELSE 'OK' END AS status
FROM nation LEFT JOIN extent ON n_name = city""")
add("count_since", STATIONS + """
SELECT COUNT(*) AS total_rows,
       CAST(SUM(CASE WHEN time >= DATE '2000-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS recent_rows,
       COUNT(DISTINCT city) AS n_entities FROM station_daily""")
add("latest_batches", ctes(LEDGER) + """
SELECT id, CAST(started_at AS DATE) AS started, status, rows_ingested, minutes, error_message
FROM states ORDER BY started_at DESC, id DESC LIMIT 5""")
add("stale_batches", ctes(LEDGER) + """
SELECT id, CAST(started_at AS DATE) AS started, status FROM states
WHERE status = 'running' AND started_at < TIMESTAMP '2001-07-30 12:00:00'""")

add("upsert_latest_wins", UPSERT)
add("upsert_table", UPSERT)
add("new_rows_anti", STATIONS + """
SELECT city, time, ROUND(precipitation + 1, 2) AS precipitation FROM station_daily
WHERE time >= DATE '1999-01-01'""")
add("coverage_plan", STATIONS.rstrip() + """,
held AS (SELECT city, CAST(time AS DATE) AS day FROM station_daily WHERE DAY(time) NOT IN (7, 8, 21)),
ends AS (SELECT MIN(CAST(time AS DATE)) - 3 AS first, MAX(CAST(time AS DATE)) + 2 AS last
         FROM station_daily),
days AS (SELECT city, CAST(UNNEST(generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP),
                                                  INTERVAL 1 DAY)) AS DATE) AS day
         FROM (SELECT DISTINCT city FROM station_daily), ends),
missing AS (SELECT city, day FROM days ANTI JOIN held USING (city, day)),
runs AS (SELECT *, day - CAST(ROW_NUMBER() OVER (PARTITION BY city ORDER BY day) AS INT) AS run
         FROM missing)
SELECT city, MIN(day) AS fetch_start, MAX(day) AS fetch_end, COUNT(*) AS n_days
FROM runs GROUP BY city, run""")
add("ingest_plan", STATIONS.rstrip() + f""",
extent AS ({EXTENT}),
ranges AS (SELECT n_name AS city, latest, COALESCE(latest + 1, DATE '1995-01-01') AS a
           FROM nation LEFT JOIN extent ON n_name = city)
SELECT city, CASE WHEN a > DATE '2001-10-31' THEN 'skip' WHEN latest IS NULL THEN 'full'
                  ELSE 'resume' END AS action,
       CASE WHEN a <= DATE '2001-10-31' THEN a END AS fetch_start,
       CASE WHEN a <= DATE '2001-10-31' THEN DATE '2001-10-31' END AS fetch_end
FROM ranges""")
add("year_chunks", STATIONS.rstrip() + f""",
extent AS ({EXTENT}),
years AS (SELECT *, UNNEST(range(YEAR(earliest), YEAR(latest) + 1)) AS y FROM extent)
SELECT city, GREATEST(earliest, MAKE_DATE(y, 1, 1)) AS chunk_start,
       LEAST(latest, MAKE_DATE(y, 12, 31)) AS chunk_end FROM years""")
add("ingest_run", STORED + """
UNION ALL
SELECT 'batch completed', CASE batch_id WHEN '9' THEN '1' ELSE '2' END, COUNT(*), NULL, NULL, NULL
FROM two_batches GROUP BY batch_id""")
add("ingest_stream", STORED)

add("matrix_cyclone", STORMS.rstrip() + """,
medians AS (SELECT MEDIAN(pressure_min) AS m FROM prepared)
SELECT point_id, lat_abs, lon, lat, COALESCE(pressure_min, m) AS pressure_min, dist_to_land,
       CAST(YEAR(iso_time) AS INT) AS year, CAST(MONTH(iso_time) AS INT) AS month,
       CAST(DAYOFYEAR(iso_time) AS INT) AS dayofyear, category AS label
FROM prepared CROSS JOIN medians""")
add("matrix_heatwave", matrix(HEATWAVE_FEATURES, "heatwave_next"))
add("matrix_rainfall", matrix(RAINFALL_FEATURES, "rain_next"))
add("impute_median", ctes(TRACKS) + """
SELECT point_id, ROUND(COALESCE(wmo_wind, (SELECT MEDIAN(wmo_wind) FROM track_points)), 6)
         AS wmo_wind,
       ROUND(COALESCE(wmo_pres, (SELECT MEDIAN(wmo_pres) FROM track_points)), 6) AS wmo_pres
FROM track_points""")
add("stratified_split", ctes(STATION, HEAT) + """
SELECT city, time, heatwave_flag AS label,
       ROW_NUMBER() OVER (PARTITION BY heatwave_flag ORDER BY
                          md5(city || '|' || CAST(time AS VARCHAR) || '|42'))
       <= ROUND(COUNT(*) OVER (PARTITION BY heatwave_flag) * CAST(0.2 AS DOUBLE)) AS is_test
FROM heat""")
add("temporal_split", STATIONS.rstrip() + """,
cut AS (SELECT MIN(time) AS c FROM (
          SELECT time, SUM(COUNT(*)) OVER (ORDER BY time DESC) AS rest FROM station_daily
          GROUP BY time) q
        WHERE rest <= (SELECT COUNT(*) FROM station_daily) * 0.2)
SELECT city, time, CASE WHEN time >= c THEN 'test' ELSE 'train' END AS part
FROM station_daily CROSS JOIN cut""")
WEIGHTS = """weights AS (
  SELECT category, COUNT(*) AS n, CASE WHEN COUNT(*) OVER () <= 1 THEN 1.0 ELSE
         CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / (COUNT(*) OVER () * COUNT(*)) END AS weight
  FROM prepared GROUP BY category)"""
add("class_weights", STORMS.rstrip() + f",\n{WEIGHTS}\n"
    + "SELECT category, n, ROUND(weight, 6) AS weight FROM weights")
add("balanced_weights", STORMS.rstrip() + f",\n{WEIGHTS}\n"
    + "SELECT point_id, category, ROUND(weight, 6) AS weight FROM prepared JOIN weights "
      "USING (category)")
add("pos_weight", HEAT_SCORED + """
SELECT CAST(SUM(1 - label) AS BIGINT) AS n_neg, CAST(SUM(label) AS BIGINT) AS n_pos,
       ROUND(AVG(label), 6) AS pos_ratio,
       CAST(SUM(1 - label) // GREATEST(SUM(label), 1) AS BIGINT) AS scale_pos_weight FROM scored""")
add("standardize", STATIONS + "SELECT city, time, " + ", ".join(
    f"ROUND(({c} - AVG({c}) OVER ()) / COALESCE(NULLIF(STDDEV_POP({c}) OVER (), 0), 1), 5) AS {c}"
    for c in ("temp_max", "precipitation", "pressure_msl_mean")) + " FROM station_daily")

add("confusion_counts", GRADES
    + "SELECT label, prediction, COUNT(*) AS n FROM graded GROUP BY label, prediction")
add("confusion_matrix", GRADES + "SELECT label, " + ", ".join(
    f"CAST(SUM(CASE WHEN prediction = {c} THEN 1 ELSE 0 END) AS BIGINT) AS p{c}"
    for c in range(6)) + " FROM graded GROUP BY label")
add("classification_metrics", GRADES.rstrip() + f",\n{CELLS}" + """
SELECT CAST(SUM(support) AS BIGINT) AS n, ROUND(SUM(support * rec) / SUM(support), 6) AS accuracy,
       ROUND(SUM(support * prec) / SUM(support), 6) AS precision,
       ROUND(SUM(support * rec) / SUM(support), 6) AS recall,
       ROUND(SUM(support * f) / SUM(support), 6) AS f1 FROM scores""")
add("per_class_metrics", GRADES.rstrip() + f",\n{CELLS}" + """
SELECT class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted,
       ROUND(prec, 6) AS precision, ROUND(rec, 6) AS recall, ROUND(f, 6) AS f1 FROM scores""")
add("roc_auc", HEAT_SCORED.rstrip() + ",\n" + auc(
    "rows AS (SELECT 0 AS class, score, label = 1 AS pos FROM scored)",
    "SELECT ROUND(area, 6) AS roc_auc FROM areas"))
add("roc_auc_by_class", GRADES.rstrip() + ",\n" + auc(
    BY_CLASS, "SELECT class, ROUND(area, 6) AS roc_auc FROM areas"))
add("roc_auc_ovr", GRADES.rstrip() + ",\n" + auc(
    BY_CLASS, "SELECT ROUND(AVG(area), 6) AS roc_auc FROM areas"))
add("log_loss", HEAT_SCORED + f"""
SELECT ROUND(-AVG(LN(LEAST(GREATEST(CASE WHEN label = 1 THEN score ELSE 1 - score END, {EPS}),
                           1 - {EPS}))), 6) AS log_loss FROM scored""")
add("log_loss_multiclass", GRADES + f"""
SELECT ROUND(-AVG(LN(LEAST(GREATEST(
  CASE label {' '.join(f'WHEN {c} THEN p{c}' for c in range(6))} END, {EPS}), 1 - {EPS}))), 6)
  AS log_loss FROM graded""")

add("severity_band", HEAT_SCORED + f"""
SELECT city, time, score, ROUND(score, 3) AS heatwave_probability, score >= 0.5 AS is_heatwave,
       CASE WHEN score < 0.3 THEN 'none' WHEN score < 0.5 THEN 'watch'
            WHEN score < 0.75 THEN 'warning' ELSE 'severe' END AS severity,
       {decision('score')} FROM scored""")
add("rain_decision", STATIONS + f"""
SELECT city, time, ROUND(score, 3) AS extreme_rainfall_probability, score >= 0.5 AS is_extreme,
       {decision('score')}
FROM (SELECT city, time, cloud_cover_mean / 100 AS score FROM station_daily) q""")
TOP = "GREATEST(p0, p1, p2, p3, p4, p5)"
ARGMAX = "CASE " + " ".join(f"WHEN p{c} = {TOP} THEN {c}" for c in range(6)) + " END"
add("argmax_class", GRADES + f"""
SELECT point_id, category, CASE WHEN category = 0 THEN 'Tropical Depression'
         ELSE 'Category ' || CAST(category AS VARCHAR) END AS description, confidence, p2
FROM (SELECT point_id, {ARGMAX} AS category, ROUND({TOP}, 6) AS confidence, ROUND(p2, 6) AS p2
      FROM graded) q""")

add("prediction_log_parse", ctes(LOG)
    + "SELECT id, model_name, 'k' AS feature, f_k AS value FROM prediction_log")
add("drift_window_split", ctes(LOG, WINDOWED)
    + "SELECT id, model_name, age, samples, side FROM split")
MOMENTS = ", ".join(
    f"{'ROUND(' if digits else ''}{fn}(CASE WHEN side = '{side}' THEN value END)"
    f"{', 5)' if digits else ''} AS {name}"
    for name, fn, side, digits in (
        ("n_ref", "COUNT", "reference", False), ("n_cur", "COUNT", "current", False),
        ("reference_mean", "AVG", "reference", True), ("current_mean", "AVG", "current", True),
        ("reference_std", "STDDEV_POP", "reference", True),
        ("current_std", "STDDEV_POP", "current", True)))
add("drift_moments", ctes(LOG, SIDED)
    + f"SELECT model_name, feature, {MOMENTS} FROM sided GROUP BY model_name, feature")
add("drift_ks", ctes(LOG, SIDED, KS)
    + "SELECT model_name, feature, n_ref, n_cur, ROUND(statistic, 6) AS statistic FROM ks")
add("drift_pvalue_asymp", ctes(LOG, SIDED, KS, PVALUE) + """
SELECT model_name, feature, ROUND(statistic, 6) AS statistic, ROUND(p_value, 6) AS p_value,
       p_value < 0.05 AS drifted FROM tested""")
add("drift_report", ctes(LOG, WINDOWED, WINDOW_SIDED, KS, PVALUE) + """
SELECT m.model_name, samples, CASE WHEN samples >= 20 THEN 'ok' ELSE 'insufficient_data' END
         AS status,
       CASE WHEN samples < 20 THEN 'at least 20 samples are needed, found ' || samples END
         AS message,
       COALESCE(total, 0) AS total_features, COALESCE(bad, 0) AS drifted_features,
       ROUND(CAST(COALESCE(bad, 0) AS DOUBLE) / GREATEST(COALESCE(total, 0), 1), 3) AS drift_score,
       COALESCE(bad, 0) >= GREATEST(2, COALESCE(total, 0) // 3) AS alert,
       t.feature, ROUND(t.statistic, 4) AS statistic, ROUND(t.p_value, 4) AS p_value,
       t.p_value < 0.05 AS drifted, ROUND(reference_mean, 2) AS reference_mean,
       ROUND(current_mean, 2) AS current_mean
FROM (SELECT model_name, MAX(samples) AS samples FROM split GROUP BY model_name) m
LEFT JOIN (SELECT model_name, COUNT(*) AS total,
                  CAST(SUM(CASE WHEN p_value < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS bad
           FROM tested GROUP BY model_name) n USING (model_name)
LEFT JOIN tested t ON t.model_name = m.model_name
LEFT JOIN (SELECT model_name, feature, AVG(value) FILTER (WHERE side = 'reference')
                    AS reference_mean, AVG(value) FILTER (WHERE side = 'current') AS current_mean
           FROM sided GROUP BY model_name, feature) s
       ON s.model_name = t.model_name AND s.feature = t.feature""")

# ------------------------------------------------- queries whose values SQL can only bound

# Exact p-values: the chance of lattice paths that keep the distance, diagonal by diagonal.
add("drift_pvalue_exact", "WITH RECURSIVE " + ctes(LOG, WINDOWED, WINDOW_SIDED, KS)
    .lstrip().removeprefix("WITH ").rstrip() + """,
walk AS (
  SELECT model_name, feature, n_ref AS n, n_cur AS m, statistic, 0 AS step,
         CAST(ROUND(statistic * n_ref * n_cur) AS BIGINT) AS bound,
         list_transform(range(0, n_ref + 1),
                        lambda i: CAST(CASE WHEN i = 0 THEN 1 ELSE 0 END AS DOUBLE)) AS inside
  FROM ks
  UNION ALL
  SELECT model_name, feature, n, m, statistic, step + 1, bound,
         list_transform(range(0, n + 1), lambda i: CASE
           WHEN step + 1 - i BETWEEN 0 AND m AND abs(i * m - (step + 1 - i) * n) < bound
           THEN inside[i + 1] * (1 - LEAST(GREATEST((n - i) / (n + m - step), 0), 1))
                + CASE WHEN i > 0 THEN inside[i] * LEAST(GREATEST((n - i + 1) / (n + m - step), 0), 1)
                       ELSE 0 END
           ELSE CAST(0 AS DOUBLE) END)
  FROM walk WHERE step < n + m),
exact AS (
  SELECT *, CASE WHEN bound <= 0 THEN 1 ELSE LEAST(GREATEST(1 - inside[n + 1], 0), 1) END AS p
  FROM walk WHERE step = n + m)
SELECT model_name, feature, n AS n_ref, m AS n_cur, ROUND(statistic, 6) AS statistic,
       ROUND(p, 6) AS p_value, p < 0.05 AS drifted FROM exact""")
add("drift_report_stream", ORACLE["drift_report"])
add("entity_percentiles_approx", ctes(STATION) + """
SELECT city, COUNT(*) AS n_rows, true AS low_within, true AS high_within FROM station_daily
GROUP BY city""")


def _runs(model: str, labels: str) -> str:
    """Rows per split, and the metrics of a run by name; their values are checked by range."""
    names = ", ".join(f"'{m}'" for m in ("accuracy", "precision", "recall", "f1", "roc_auc",
                                         "log_loss"))
    return f"""{labels},
sizes AS (SELECT label, COUNT(*) AS n, ROUND(COUNT(*) * CAST(0.2 AS DOUBLE)) AS t
          FROM labels GROUP BY label),
parts AS (SELECT 'test' AS split, CAST(SUM(t) AS BIGINT) AS n FROM sizes
          UNION ALL SELECT 'train', CAST(SUM(n - t) AS BIGINT) FROM sizes)
SELECT 'bench' AS run_id, '{model}' AS model, split, metric, n AS n_rows, true AS in_range
FROM parts, (SELECT unnest([{names}]) AS metric)"""


def _targets(target: str) -> str:
    return (WIDE.rstrip() + f""",
labels AS (SELECT {target} AS label FROM features WHERE {target} IS NOT NULL)""")


add("train_cyclone", _runs("cyclone", STORMS.rstrip()
                           + ",\nlabels AS (SELECT category AS label FROM prepared)"))
add("train_heatwave", _runs("heatwave", _targets("heatwave_next")))
add("train_rainfall", _runs("rainfall", _targets("rain_next")))
add("train_heatwave_boosted", _runs("heatwave", _targets("heatwave_next")))
add("train_rainfall_boosted", _runs("rainfall", _targets("rain_next")))
add("train_cyclone_boosted", STORMS.rstrip() + """,
labels AS (SELECT category AS label FROM prepared),
sizes AS (SELECT label, COUNT(*) AS n, ROUND(COUNT(*) * CAST(0.2 AS DOUBLE)) AS t
          FROM labels WHERE label IS NOT NULL GROUP BY label),
parts AS (SELECT 'test' AS split, CAST(SUM(t) AS BIGINT) AS n_rows FROM sizes
          UNION ALL SELECT 'train', CAST(SUM(n - t) AS BIGINT) FROM sizes),
floors AS (SELECT 'accuracy' AS metric, ROUND(MAX(n) / SUM(n), 6) AS floor FROM sizes
           UNION ALL SELECT 'log_loss', ROUND(LN(SUM(n)) - SUM(n * LN(n)) / SUM(n), 6) FROM sizes)
SELECT 'bench' AS run_id, 'cyclone' AS model, split, metric, n_rows, floor,
       CASE WHEN floor IS NOT NULL THEN true END AS reached, true AS in_range
FROM parts, (SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc', 'log_loss']) AS metric)
LEFT JOIN floors USING (metric)""")


def _broken() -> str:
    """Rules that rows of the feature table break, as the scorer names them."""
    tests = []
    for name, rule in HEATWAVE_RULES.items():
        if rule.default is None:
            tests.append(f"SELECT '{name}: required' AS outcome, COUNT(*) AS n_rows "
                         f"FROM features WHERE {name} IS NULL")
        for word, sign, limit in (("below", "<", rule.low), ("above", ">", rule.high)):
            if limit is not None:
                tests.append(f"SELECT '{name}: {word} {limit}', COUNT(*) FROM features "
                             f"WHERE {name} {sign} {limit}")
    bad = " OR ".join(f"{n} IS NULL" for n, r in HEATWAVE_RULES.items() if r.default is None)
    tests.append(f"SELECT 'scored', COUNT(*) FROM features WHERE NOT ({bad})")
    return "SELECT * FROM (" + " UNION ALL ".join(tests) + ") WHERE n_rows > 0"


add("score_heatwave", WIDE + _broken())
LOGGED = ", ".join(f"UNION ALL SELECT model_name, side, '{c}', CAST({c} AS DOUBLE) FROM split "
                   for c in CYCLONE_FEATURES[1:]).replace(", UNION", "UNION")
add("score_log_drift", STORMS.rstrip() + f""",
logged AS (
  SELECT *, CAST(YEAR(iso_time) AS INT) AS year, CAST(MONTH(iso_time) AS INT) AS month,
         CAST(DAYOFYEAR(iso_time) AS INT) AS dayofyear, 'cyclone' AS model_name,
         iso_time >= TIMESTAMP '2024-01-16 00:00:00' AS second FROM prepared),
recent AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY second DESC, point_id DESC) AS age
  FROM logged QUALIFY age <= 500),
split AS (
  SELECT *, CASE WHEN samples - age + 1 <= (samples * 2) // 3 THEN 'reference' ELSE 'current' END
         AS side FROM (SELECT *, COUNT(*) OVER () AS samples FROM recent) q),
sided AS (
  SELECT * FROM (SELECT model_name, side, '{CYCLONE_FEATURES[0]}' AS feature,
                        CAST({CYCLONE_FEATURES[0]} AS DOUBLE) AS value FROM split
                 {LOGGED}) u WHERE value IS NOT NULL),
""" + KS + ",\n" + PVALUE + """
SELECT model_name, feature, n_ref, n_cur, ROUND(statistic, 4) AS statistic,
       ROUND(p_value, 4) AS p_value, p_value < 0.05 AS drifted,
       (SELECT MAX(samples) FROM split) AS samples FROM tested""")
add("feature_importances", f"""
SELECT feature, true AS in_range FROM (SELECT unnest([{', '.join(
    f"'{c}'" for c in CYCLONE_FEATURES)}]) AS feature)""")
add("ablation_cyclone", """
SELECT subset, 'pressure_min' AS feature, true AS in_range
FROM (SELECT unnest(['full', 'without', 'only']) AS subset)""")
add("tune_rainfall", """
SELECT CAST(unnest(range(0, 20)) AS INT) AS trial, 'areaUnderROC' AS metric, true AS in_range""")
