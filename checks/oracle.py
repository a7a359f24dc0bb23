"""The same results in DuckDB SQL, written independently of the Spark code."""

from checks.bookings import ALL_COLUMNS, BOOKINGS_SQL
from checks.queries import BATCH_TIME, LINE_FOLDS, LOADED_UNTIL, REPRICED_AT, REPRICED_FROM, RIDGE_ALPHAS
from farelake.schema import (
    BRONZE_TABLE, CATEGORICAL_FEATURES, FARE_COLUMNS, FEATURE_TABLE, INPUT_COLUMNS, KEY_COLUMNS, KPI_TABLES, LABEL_COLUMNS,
    NUMERIC_FEATURES, PEAK_SEASONS, SILVER_TABLE, TARGET, TEXT_COLUMNS,
)

# Labels of buckets and seasons.
_DURATION = (
    "CASE WHEN {c} <= 3 THEN 'Short (0-3h)' WHEN {c} <= 6 THEN 'Medium (3-6h)' ELSE 'Long (6+h)' END"
)
_LEAD = (
    "CASE WHEN {c} <= 3 THEN 'Last Minute (0-3 days)' WHEN {c} <= 14 THEN 'Short Notice (4-14 days)' "
    "WHEN {c} <= 30 THEN 'Standard (15-30 days)' ELSE 'Early Bird (30+ days)' END"
)
_STAMP = "'%Y-%m-%d %H:%M:%S'"


def _dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _r2(expr: str) -> str:
    return _dbl(f"ROUND(CAST({expr} AS DECIMAL(28,10)), 2)")


def _avg(col: str) -> str:
    # The sum of decimals is exact; one division in double is left.
    return f"{_dbl(f'SUM({col})')} / COUNT({col})"


def _text(col: str) -> str:
    return f"strftime({col}, {_STAMP})"


def _parse(col: str) -> str:
    return f"CASE WHEN {col} <> '' THEN strptime({col}, {_STAMP}) END"


def _silver(name: str, source: str, kept: str = "") -> str:
    cols = ["id", "booking_hash"]
    for c in ALL_COLUMNS[2:]:
        if c in LABEL_COLUMNS:
            cols.append(f"TRIM({c}, ' ') AS {c}")
        elif c.endswith("_datetime"):
            cols.append(f"{_parse(c)} AS {c}")
        elif c in FARE_COLUMNS:
            cols.append(f"CASE WHEN {c} > 0 THEN {c} ELSE 0 END AS {c}")
        elif c in ("duration_hrs", "days_before_departure"):
            cols.append(f"COALESCE({c}, 0) AS {c}")
            rule, label = (_DURATION, "duration_bucket") if c == "duration_hrs" else (_LEAD, "booking_lead_bucket")
            cols.append(f"{rule.format(c=f'COALESCE({c}, 0)')} AS {label}")
        else:
            cols.append(c)
    return f"{name} AS {kept} (SELECT {', '.join(cols)} FROM {source})"


SILVER_COLUMNS = []
for _c in ALL_COLUMNS:
    SILVER_COLUMNS.append(_c)
    if _c == "duration_hrs":
        SILVER_COLUMNS.append("duration_bucket")
    if _c == "days_before_departure":
        SILVER_COLUMNS.append("booking_lead_bucket")


def _shown(columns, stamps=("created_at", "updated_at")) -> str:
    out = []
    for c in columns:
        if c in FARE_COLUMNS or c == "duration_hrs":
            out.append(f"{_dbl(c)} AS {c}")
        elif c in stamps:
            out.append(f"{_text(c)} AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


_SILVER_STAMPS = ("departure_datetime", "arrival_datetime", "created_at", "updated_at")
_SILVER = _silver("silver", "bookings")
_ROUTE = "source, source_name, destination, destination_name"

_FEATURES = (
    f"features AS (SELECT id, booking_hash, {', '.join(CATEGORICAL_FEATURES)}, duration_hrs, days_before_departure, "
    "CAST(EXTRACT(MONTH FROM departure_datetime) AS INT) AS departure_month, "
    "CAST(EXTRACT(DOW FROM departure_datetime) AS INT) AS departure_weekday, "
    "CAST(EXTRACT(HOUR FROM departure_datetime) AS INT) AS departure_hour, total_fare_bdt "
    "FROM silver WHERE total_fare_bdt > 0 AND airline <> '' AND source <> '' AND destination <> '')"
)

_BY_AIRLINE = f"""by_airline AS (SELECT airline, COUNT(*) AS booking_count,
    {_r2(_avg('base_fare_bdt'))} AS avg_base_fare_bdt, {_r2(_avg('tax_surcharge_bdt'))} AS avg_tax_surcharge_bdt,
    {_r2(_avg(TARGET))} AS avg_total_fare_bdt, {_r2(f'MIN({TARGET})')} AS min_total_fare_bdt,
    {_r2(f'MAX({TARGET})')} AS max_total_fare_bdt
    FROM silver WHERE airline IS NOT NULL AND airline <> '' GROUP BY airline)"""

_BY_CLASS = f"""by_class AS (SELECT class, COUNT(*) AS booking_count,
    {_r2('100.0 * COUNT(*) / SUM(COUNT(*)) OVER ()')} AS class_share_pct,
    {_r2(_avg('base_fare_bdt'))} AS avg_base_fare_bdt, {_r2(_avg('tax_surcharge_bdt'))} AS avg_tax_surcharge_bdt,
    {_r2(_avg(TARGET))} AS avg_total_fare_bdt, {_r2(f'MIN({TARGET})')} AS min_fare_bdt,
    {_r2(f'MAX({TARGET})')} AS max_fare_bdt, {_r2(f'STDDEV_SAMP({_dbl(TARGET)})')} AS fare_stddev
    FROM silver WHERE class <> '' GROUP BY class)"""

_MEAN_2 = f"ROUND(CAST({_avg(TARGET)} AS DECIMAL(28,10)), 2)"
_PER_HOUR = _r2(f"{_dbl(f'SUM({TARGET})')} / {_dbl('SUM(duration_hrs)')}")

# The average over groups is a window over the grouped rows.
_BY_ROUTE = f"""by_route AS (SELECT source || ' → ' || destination AS route,
    source_name || ' → ' || destination_name AS route_full, {_ROUTE}, COUNT(*) AS booking_count,
    {_dbl(_MEAN_2)} AS avg_fare_bdt, {_r2(f'MIN({TARGET})')} AS min_fare_bdt, {_r2(f'MAX({TARGET})')} AS max_fare_bdt,
    {_r2(_avg('duration_hrs'))} AS avg_duration_hrs,
    CASE WHEN SUM(duration_hrs) > 0 THEN {_PER_HOUR} END AS avg_fare_per_hour,
    {_r2(f"(100 * {_dbl(_MEAN_2)} / ({_dbl(f'SUM({_MEAN_2}) OVER ()')} / COUNT(*) OVER ())) - 100")} AS fare_vs_avg_pct
    FROM silver WHERE source <> '' AND destination <> '' GROUP BY {_ROUTE})"""

_ALL_FARES = f"ROUND(CAST({_dbl(f'SUM(SUM({TARGET})) OVER ()')} / SUM(COUNT({TARGET})) OVER () AS DECIMAL(28,10)), 2)"

_BY_SEASON = f"""by_season AS (SELECT seasonality, COUNT(*) AS booking_count,
    {_r2(_avg('base_fare_bdt'))} AS avg_base_fare_bdt, {_r2(_avg('tax_surcharge_bdt'))} AS avg_tax_surcharge_bdt,
    {_dbl(_MEAN_2)} AS avg_total_fare_bdt, {_r2(f'MIN({TARGET})')} AS min_total_fare_bdt,
    {_r2(f'MAX({TARGET})')} AS max_total_fare_bdt, {_r2(f'STDDEV_SAMP({_dbl(TARGET)})')} AS stddev_total_fare_bdt,
    {_dbl(_ALL_FARES)} AS overall_avg_fare, {_dbl(f'{_MEAN_2} - {_ALL_FARES}')} AS fare_diff_from_avg,
    {_r2(f"{_dbl(f'{_MEAN_2} - {_ALL_FARES}')} * 100 / {_dbl(_ALL_FARES)}")} AS fare_pct_diff_from_avg,
    CASE WHEN seasonality IN {PEAK_SEASONS} THEN 'Peak' ELSE 'Non-Peak' END AS season_type
    FROM silver GROUP BY seasonality QUALIFY seasonality <> '')"""

_COUNT_BY_AIRLINE = f"""count_by_airline AS (SELECT airline, COUNT(*) AS total_bookings,
    {_r2('100.0 * COUNT(*) / SUM(COUNT(*)) OVER ()')} AS market_share_pct
    FROM silver WHERE airline <> '' GROUP BY airline)"""

_TOP_ROUTES = f"""top AS (SELECT {_ROUTE}, COUNT(*) AS booking_count, {_r2(_avg(TARGET))} AS avg_fare_bdt,
    {_r2(f'MIN({TARGET})')} AS min_fare_bdt, {_r2(f'MAX({TARGET})')} AS max_fare_bdt
    FROM silver WHERE source <> '' AND destination <> '' GROUP BY {_ROUTE}
    ORDER BY booking_count DESC, {_ROUTE} LIMIT 50)"""

_GOLD = ", ".join((_SILVER, _FEATURES, _BY_AIRLINE, _BY_CLASS, _BY_ROUTE, _BY_SEASON, _COUNT_BY_AIRLINE, _TOP_ROUTES))
_GOLD_NAMES = {
    FEATURE_TABLE: "features",
    "gold.avg_fare_by_airline": "by_airline",
    "gold.avg_fare_by_class": "by_class",
    "gold.avg_fare_by_route": "by_route",
    "gold.booking_count_by_airline": "count_by_airline",
    "gold.seasonal_fare_variation": "by_season",
    "gold.top_routes": "top",
}

# Keyed upsert, by the first and the last row of a key.
_UPDATED = (*FARE_COLUMNS, "updated_at")


def _one_per_key(name: str, source: str) -> str:
    # Ids are unique, so they order the rows of a key as all columns together do.
    cols = ", ".join(f"{'z' if c in _UPDATED else 'f'}.{c} AS {c}" for c in ALL_COLUMNS)
    return (
        f"{name} AS MATERIALIZED (SELECT {cols} FROM (SELECT arg_min(r, id) AS f, arg_max(r, id) AS z "
        f"FROM (SELECT *, {source} AS r FROM {source}) GROUP BY booking_hash))"
    )


_DEARER = ", ".join(
    f"CAST(CAST({c} AS DECIMAL(15,6)) * CAST(1.1 AS DECIMAL(2,1)) AS DECIMAL(15,6)) AS {c}" for c in FARE_COLUMNS
)
_UPSERT = ", ".join(
    (
        f"loaded AS (SELECT * FROM bookings WHERE updated_at < TIMESTAMP '{LOADED_UNTIL}')",
        _one_per_key("snap", "loaded"),
        f"sent AS (SELECT * REPLACE ({_DEARER}, 'Direct' AS stopovers, TIMESTAMP '{REPRICED_AT}' AS updated_at) "
        f"FROM bookings WHERE updated_at >= TIMESTAMP '{REPRICED_FROM}')",
        _one_per_key("batch", "sent"),
        "upserted AS MATERIALIZED (SELECT "
        + ", ".join(
            (
                f"CASE WHEN b.booking_hash IS NOT NULL THEN b.{c} ELSE s.{c} END AS {c}"
                if c in _UPDATED
                else f"CASE WHEN s.booking_hash IS NOT NULL THEN s.{c} ELSE b.{c} END AS {c}"
            )
            for c in ALL_COLUMNS
        )
        + " FROM snap s FULL OUTER JOIN batch b ON s.booking_hash = b.booking_hash)",
    )
)

# The same by order statistics of whole rows: deliveries in their order, in each of them rows by id.
_BLANK = ("airline", "departure_datetime", "arrival_datetime")
_CSV_KEY = " || '|' || ".join(f"COALESCE(NULLIF({c}, ''), 'nan')" for c in KEY_COLUMNS)
_DELIVERED = ", ".join(
    (
        f"delivered AS (SELECT *, TIMESTAMP '{REPRICED_FROM}' AS sent_at FROM bookings WHERE updated_at < TIMESTAMP '{REPRICED_FROM}' "
        f"UNION ALL SELECT *, TIMESTAMP '{LOADED_UNTIL}' FROM bookings WHERE updated_at >= TIMESTAMP '{REPRICED_FROM}' "
        f"UNION ALL SELECT * REPLACE ({_DEARER}, 'Direct' AS stopovers), TIMESTAMP '{REPRICED_AT}' FROM bookings "
        f"WHERE updated_at >= TIMESTAMP '{REPRICED_FROM}')",
        f"rekeyed AS (SELECT * REPLACE (substring(sha256({_CSV_KEY}), 1, 32) AS booking_hash, "
        + ", ".join(f"NULLIF(TRIM({c}), '') AS {c}" for c in _BLANK)
        + ") FROM delivered)",
        "picked AS (SELECT booking_hash, arg_min(r, (sent_at, id)) AS f, arg_max(r, (sent_at, id)) AS z, "
        "MIN(sent_at) AS created_at, MAX(sent_at) AS updated_at FROM (SELECT *, rekeyed AS r FROM rekeyed) GROUP BY booking_hash)",
        "kept AS (SELECT f.id AS id, booking_hash, "
        + ", ".join(f"{'z' if c in FARE_COLUMNS else 'f'}.{c} AS {c}" for c in INPUT_COLUMNS)
        + ", created_at, updated_at FROM picked)",
    )
)

_MISSING_TEXT = {c: f"NULLIF({c}, '')" for c in TEXT_COLUMNS}
_PARTS = (
    "SELECT CAST(EXTRACT(MONTH FROM t) AS INT) AS departure_month, {dow} AS departure_weekday, "
    "CAST(EXTRACT(HOUR FROM t) AS INT) AS departure_hour, COUNT(*) AS rows "
    f"FROM (SELECT {_parse('departure_datetime')} AS t FROM bookings) GROUP BY 1, 2, 3"
)
_SUNDAY = "CAST(EXTRACT(DOW FROM {c}) AS INT)"
_MONDAY = "CAST(EXTRACT(ISODOW FROM {c}) - 1 AS INT)"


def _cut(rule: str, c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN {rule.format(c=c)} ELSE 'nan' END"


def _engineered(source: str, stamp: str, text: dict[str, str] | None = None, dow: str = _MONDAY) -> str:
    text = text or {}
    cols = []
    for c in INPUT_COLUMNS:
        if c in ("source_name", "destination_name", "base_fare_bdt", "tax_surcharge_bdt") or c.endswith("_datetime"):
            continue
        if c in (TARGET, "duration_hrs", "days_before_departure"):
            cols.append(f"{_dbl(c)} AS {c}")
        else:
            cols.append(f"{text.get(c, c)} AS {c}")
    return (
        f"SELECT {', '.join(cols)}, {_cut(_DURATION, 'duration_hrs')} AS duration_bucket, "
        f"{_cut(_LEAD, 'days_before_departure')} AS booking_lead_bucket, "
        f"CAST(EXTRACT(MONTH FROM {stamp}) AS INT) AS departure_month, {dow.format(c=stamp)} AS departure_weekday, "
        f"CAST(EXTRACT(HOUR FROM {stamp}) AS INT) AS departure_hour FROM {source}"
    )


def _mean_by(by: str, source: str, extra: str = "", rows: str = ", COUNT({t}) AS rows") -> str:
    return (
        f"SELECT {by}, ROUND({_avg(TARGET)}, 4) AS mean{extra}{rows.format(t=TARGET)} "
        f"FROM {source} WHERE {by} IS NOT NULL GROUP BY {by}"
    )


_RAW = "raw AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in _MISSING_TEXT.items()) + ") FROM bookings)"


def _histogram(values: str) -> str:
    """50 bins over a CTE text that yields one column x."""
    return f"""vals AS ({values}),
ends AS (SELECT CASE WHEN MIN(x) = MAX(x) THEN MIN(x) - 0.5 ELSE MIN(x) END AS lo,
    CASE WHEN MIN(x) = MAX(x) THEN MAX(x) + 0.5 ELSE MAX(x) END AS hi FROM vals),
counts AS (SELECT LEAST(CAST(FLOOR((x - lo) / (hi - lo) * 50) AS INT), 49) AS bin, COUNT(*) AS rows
    FROM vals CROSS JOIN ends GROUP BY 1)
SELECT CAST(b.bin AS INT) AS bin, ROUND(lo + b.bin * ((hi - lo) / 50), 4) AS lower,
    ROUND(lo + (b.bin + 1) * ((hi - lo) / 50), 4) AS upper, COALESCE(c.rows, 0) AS rows
FROM (SELECT UNNEST(range(50)) AS bin) b CROSS JOIN ends LEFT JOIN counts c ON b.bin = c.bin"""


_NUMBERS = ("duration_hrs", *FARE_COLUMNS, "days_before_departure")
_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[:i]]
_CLASS_MEAN = f"""class_mean AS (SELECT 'class mean' AS model, {_dbl(TARGET)} AS label,
    AVG({_dbl(TARGET)}) OVER (PARTITION BY class) AS prediction FROM bookings)"""
_METRICS = """SELECT model, ROUND(1 - SUM((label - prediction) ** 2) / (VAR_POP(label) * COUNT(*)), 6) AS r2,
    ROUND(AVG(ABS(label - prediction)), 2) AS mae, ROUND(SQRT(AVG((label - prediction) ** 2)), 2) AS rmse
    FROM class_mean GROUP BY model"""


def _with(*parts: str) -> str:
    """CTEs over the feed, the last part being the SELECT (or ending in it)."""
    *ctes, select = parts
    return "WITH " + ",\n".join((BOOKINGS_SQL, *ctes)) + "\n" + select


def _with_tail(*parts: str) -> str:
    """As :func:`_with`, the last part being CTEs followed by their SELECT."""
    return "WITH " + ",\n".join((BOOKINGS_SQL, *parts))


def _check_rows(table: str, source: str, columns: list[str], test: str) -> list[str]:
    bad = {
        "not_null": "COUNT(*) FILTER (WHERE {c} IS NULL)",
        "unique": f"(SELECT COUNT(*) FROM (SELECT 1 FROM {source} WHERE {{c}} IS NOT NULL GROUP BY {{c}} HAVING COUNT(*) > 1))",
    }[test]
    tail = f" FROM {source}" if test == "not_null" else ""
    return [
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{test}' AS test, {bad.format(c=c)} AS failures{tail}"
        for c in columns
    ]


def _suite_sql() -> str:
    rows = []
    rows += _check_rows(BRONZE_TABLE, "bookings", ["booking_hash"], "unique")
    rows += _check_rows(BRONZE_TABLE, "bookings", ["booking_hash", "airline", "source", "destination"], "not_null")
    rows += _check_rows(SILVER_TABLE, "silver", ["booking_hash"], "unique")
    rows += _check_rows(
        SILVER_TABLE,
        "silver",
        ["booking_hash", "airline", "source", "destination", "departure_datetime", "base_fare_bdt",
         "tax_surcharge_bdt", "duration_bucket", "booking_lead_bucket"],
        "not_null",
    )
    domains = {
        "stopovers": "'Direct', '1 Stop', '2 Stops'",
        "class": "'Economy', 'Business', 'First Class'",
        "seasonality": "'Regular', 'Eid', 'Hajj', 'Winter Holidays'",
        "duration_bucket": "'Short (0-3h)', 'Medium (3-6h)', 'Long (6+h)'",
        "booking_lead_bucket":
            "'Last Minute (0-3 days)', 'Short Notice (4-14 days)', 'Standard (15-30 days)', 'Early Bird (30+ days)'",
    }
    rows += [
        f"SELECT '{SILVER_TABLE}', '{c}', 'accepted_values', COUNT(*) FILTER (WHERE {c} NOT IN ({v})) FROM silver"
        for c, v in domains.items()
    ]
    keys = {
        "gold.avg_fare_by_airline": "airline",
        "gold.booking_count_by_airline": "airline",
        "gold.seasonal_fare_variation": "seasonality",
        "gold.avg_fare_by_class": "class",
        "gold.avg_fare_by_route": "route",
    }
    for table, c in keys.items():
        for test in ("unique", "not_null"):
            rows += _check_rows(table, _GOLD_NAMES[table], [c], test)
    rows += _check_rows("gold.top_routes", "top", ["source", "destination"], "not_null")
    rows += _check_rows(FEATURE_TABLE, "features", ["airline", TARGET], "not_null")
    union = " UNION ALL ".join(rows)
    return f"SELECT table_name, column_name, test, failures, failures = 0 AS passed FROM ({union})"


def _gate_sql() -> str:
    rows = ["SELECT 'rows' AS \"check\", 'error' AS severity, CAST(CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS failures FROM bookings"]
    rows += [
        f"SELECT 'null_or_blank:{c}', 'warn', COUNT(*) FILTER (WHERE {c} IS NULL OR {c} = '') FROM bookings"
        for c in ("airline", "source", "destination", "booking_hash")
    ]
    negative = " OR ".join(f"{c} < 0" for c in FARE_COLUMNS)
    rows.append(f"SELECT 'negative_fare', 'warn', COUNT(*) FILTER (WHERE {negative}) FROM bookings")
    rows.append(
        "SELECT 'repeated_key', 'warn', COUNT(*) FROM (SELECT 1 FROM bookings GROUP BY booking_hash HAVING COUNT(*) > 1)"
    )
    return f'SELECT "check", severity, failures, failures = 0 AS passed FROM ({" UNION ALL ".join(rows)})'


def _slot(seed: int, slots: int) -> str:
    return f"CAST(CAST('0x' || substring(sha256('{seed}|' || booking_hash), 1, 8) AS BIGINT) % {slots} AS INT)"


def _line_models(**slopes: str) -> tuple[str, ...]:
    """CTEs for one-feature models: split, scaling, a fit without each fold and one on all training rows.

    ``slopes`` gives the slope of each model in terms of the centred sums sxx and sxy and the count n.
    """
    every = LINE_FOLDS
    fits = " UNION ALL ".join(f"SELECT '{m}' AS model, part, {w} AS slope, mx, my FROM sums" for m, w in slopes.items())
    r2 = "1 - SUM((y - p) ** 2) / (VAR_POP(y) * COUNT(*))"
    return (
        _SILVER,
        _FEATURES,
        f"marked AS (SELECT {_slot(42, 100)} < 20 AS held, {_slot(43, LINE_FOLDS)} AS fold, "
        f"{_dbl('duration_hrs')} AS hours, {_dbl(TARGET)} AS y FROM features)",
        "scaler AS (SELECT AVG(hours) AS m, STDDEV_POP(hours) AS s FROM marked WHERE NOT held)",
        "points AS (SELECT held, fold, (hours - m) / s AS x, y FROM marked CROSS JOIN scaler)",
        "sums AS (SELECT part, REGR_SXX(y, x) AS sxx, REGR_SXY(y, x) AS sxy, AVG(x) AS mx, AVG(y) AS my, "
        f"COUNT(*) AS n FROM points CROSS JOIN (SELECT UNNEST(range({every + 1})) AS part) "
        "WHERE NOT held AND fold <> part GROUP BY part)",
        f"fits AS ({fits})",
        "predicted AS (SELECT model, held, fold, y, my + slope * (x - mx) AS p FROM points JOIN fits "
        f"ON part = CASE WHEN held THEN {every} ELSE fold END)",
        f"fold_r2 AS (SELECT model, fold, {r2} AS r2 FROM predicted WHERE NOT held GROUP BY model, fold)",
        "cv AS (SELECT model, AVG(r2) AS exact_mean, ROUND(AVG(r2), 4) + 0.0 AS cv_mean_r2, "
        "ROUND(STDDEV_POP(r2), 4) + 0.0 AS cv_std_r2 FROM fold_r2 GROUP BY model)",
        f"tested AS (SELECT model, ROUND({r2}, 6) AS r2, ROUND(AVG(ABS(y - p)), 2) AS mae, "
        "ROUND(SQRT(AVG((y - p) ** 2)), 2) AS rmse FROM predicted WHERE held GROUP BY model)",
    )


_OLS = "sxy / sxx"


def _ridge(alpha: float) -> str:
    return f"sxy / (sxx + {alpha})"


def _lasso(alpha: float) -> str:
    return f"SIGN(sxy) * GREATEST(ABS(sxy) / n - {alpha}, 0) / (sxx / n)"


# On the travel class alone, a tree, a forest of one tree on all rows and one full boosting step
# all predict the mean of the class, which cross-validation takes over the other folds.
_TREES = ("Decision Tree", "Random Forest", "Gradient Boosting")
_TREE_R2 = "1 - SUM((y - p) ** 2) / (VAR_POP(y) * COUNT(*))"
_TREE_MODELS = (
    _SILVER,
    _FEATURES,
    f"marked AS (SELECT {_slot(42, 100)} < 20 AS held, {_slot(43, LINE_FOLDS)} AS fold, class, {_dbl(TARGET)} AS y FROM features)",
    f"means AS (SELECT part, class, AVG(y) AS p FROM marked CROSS JOIN (SELECT UNNEST(range({LINE_FOLDS + 1})) AS part) "
    "WHERE NOT held AND fold <> part GROUP BY part, class)",
    f"predicted AS (SELECT held, fold, y, p FROM marked m JOIN means s ON m.class = s.class "
    f"AND part = CASE WHEN held THEN {LINE_FOLDS} ELSE fold END)",
    f"fold_r2 AS (SELECT fold, {_TREE_R2} AS r2 FROM predicted WHERE NOT held GROUP BY fold)",
    "cv AS (SELECT ROUND(AVG(r2), 4) + 0.0 AS cv_mean_r2, ROUND(STDDEV_POP(r2), 4) + 0.0 AS cv_std_r2 FROM fold_r2)",
    f"tested AS (SELECT ROUND({_TREE_R2}, 6) AS r2, ROUND(AVG(ABS(y - p)), 2) AS mae, "
    "ROUND(SQRT(AVG((y - p) ** 2)), 2) AS rmse FROM predicted WHERE held)",
    f"SELECT UNNEST({list(_TREES)}) AS model, * FROM tested CROSS JOIN cv",
)

_COMPARED = "SELECT model, r2, mae, rmse, cv_mean_r2, cv_std_r2 FROM tested JOIN cv USING (model)"

_PROFILE_LABELS = {
    "source_name": "Source Name", "destination_name": "Destination Name", "arrival_datetime": "Arrival Date & Time",
}

ORACLE = {
    "file_manifest": "SELECT 'found' AS outcome, 2 AS files",
    "csv_scan": _with(
        "SELECT "
        + ", ".join(f"{_MISSING_TEXT[c] if c in _MISSING_TEXT else f'CAST({c} AS VARCHAR)'} AS {c}" for c in INPUT_COLUMNS)
        + " FROM bookings"
    ),
    "csv_scan_renamed": _with(_RAW, f"departed AS (SELECT *, {_parse('departure_datetime')} AS t FROM raw)", _engineered("departed", "t")),
    "raw_scan": _with(
        _RAW,
        "SELECT "
        + ", ".join(
            f'{c} AS "{_PROFILE_LABELS.get(c, c)}"' if c in TEXT_COLUMNS else f"{_dbl(c)} AS {c}" for c in INPUT_COLUMNS
        )
        + " FROM raw",
    ),
    "csv_to_bronze": _with(
        f"rekeyed AS (SELECT * REPLACE (substring(sha256({_CSV_KEY}), 1, 32) AS booking_hash, "
        + ", ".join(f"NULLIF(TRIM({c}), '') AS {c}" for c in _BLANK)
        + ") FROM bookings)",
        # Files of direct bookings come first, rows by id in each kind.
        "picked AS (SELECT booking_hash, arg_min(r, (stopovers <> 'Direct', id)) AS f, arg_max(r, (stopovers <> 'Direct', id)) AS z "
        "FROM (SELECT *, rekeyed AS r FROM rekeyed) GROUP BY booking_hash)",
        "SELECT booking_hash, "
        + ", ".join(
            f"{_dbl(e) if c in FARE_COLUMNS or c == 'duration_hrs' else e} AS {c}"
            for c, e in ((c, f"{'z' if c in FARE_COLUMNS else 'f'}.{c}") for c in INPUT_COLUMNS)
        )
        + f", {_text(f'TIMESTAMP {BATCH_TIME.isoformat(sep=chr(32))!r}')} AS created_at, created_at AS updated_at FROM picked",
    ),
    "load_cascade": _with(
        _SILVER,
        _engineered("silver", "departure_datetime", dow=_SUNDAY).replace(
            " FROM silver", f" FROM silver WHERE {TARGET} IS NOT NULL"
        ),
    ),
    "load_cascade_bronze": _with(
        f"departed AS (SELECT *, {_parse('departure_datetime')} AS t FROM bookings WHERE {TARGET} IS NOT NULL)",
        _engineered("departed", "t", dow=_SUNDAY),
    ),
    "load_cascade_csv": _with(
        _RAW,
        f"departed AS (SELECT *, {_parse('departure_datetime')} AS t FROM raw WHERE {TARGET} IS NOT NULL)",
        _engineered("departed", "t", dow=_SUNDAY),
    ),
    "layer_counts": _with(
        _UPSERT,
        _GOLD,
        " UNION ALL ".join(
            [f"SELECT '{BRONZE_TABLE}' AS table_name, COUNT(*) AS row_count FROM upserted"]
            + [f"SELECT '{SILVER_TABLE}', COUNT(*) FROM silver"]
            + [f"SELECT '{t}', COUNT(*) FROM {n}" for t, n in _GOLD_NAMES.items()]
            + ["SELECT 'gold.not_built', CAST(-1 AS BIGINT)"]
        ),
    ),
    "booking_hash": _with("SELECT id, booking_hash FROM bookings"),
    "bronze_clean_text": _with(
        "SELECT id, "
        + ", ".join(
            f"COALESCE({f'TRIM({c})' if c == 'airline' else c}, 'nan') AS {c}" for c in INPUT_COLUMNS if c in TEXT_COLUMNS
        )
        + " FROM bookings"
    ),
    "bronze_numeric_cast": _with(
        f"SELECT id, {_dbl('duration_hrs')} AS duration_hrs, {_dbl('base_fare_bdt')} AS base_fare_bdt, "
        f"{_dbl('tax_surcharge_bdt')} AS tax_surcharge_bdt, "
        # A seventh decimal of 5 rounds away from zero.
        "CASE WHEN stopovers = 'Direct' THEN CAST(total_fare_bdt + CASE WHEN total_fare_bdt < 0 THEN -0.000001 "
        f"ELSE 0.000001 END AS DOUBLE) END AS {TARGET}, days_before_departure FROM bookings"
    ),
    "bronze_upsert": _with(_UPSERT, f"SELECT {_shown(ALL_COLUMNS)} FROM upserted"),
    "bronze_view": _with(f"SELECT {_shown(ALL_COLUMNS)} FROM bookings"),
    "silver_clean": _with(_SILVER, f"SELECT {_shown(SILVER_COLUMNS, _SILVER_STAMPS)} FROM silver"),
    "parse_timestamps": _with(
        f"SELECT id, {_text(_parse('departure_datetime'))} AS departure_datetime, "
        f"{_text(_parse('arrival_datetime'))} AS arrival_datetime FROM bookings"
    ),
    "coerce_parse": _with(
        f"SELECT id, CASE WHEN departure_datetime = '' THEN NULL "
        f"WHEN stopovers = 'Direct' THEN {_text(f'''date_trunc('day', {_parse('departure_datetime')})''')} "
        f"WHEN stopovers = '1 Stop' THEN {_text(_parse('departure_datetime'))} END AS departure_datetime, "
        f"CASE WHEN stopovers <> '2 Stops' THEN {_dbl('duration_hrs')} END AS duration_hrs, "
        f"{_dbl('days_before_departure')} AS days_before_departure FROM bookings"
    ),
    "duration_bucket": _with(
        _SILVER,
        f"SELECT {_dbl('duration_hrs')} AS duration_hrs, duration_bucket AS bucket, COUNT(*) AS rows FROM silver GROUP BY 1, 2",
    ),
    "lead_bucket": _with(
        _SILVER,
        "SELECT days_before_departure, booking_lead_bucket AS bucket, COUNT(*) AS rows FROM silver GROUP BY 1, 2",
    ),
    "cut_buckets": _with(
        f"SELECT {_dbl('duration_hrs')} AS duration_hrs, days_before_departure, "
        f"{_cut(_DURATION, 'duration_hrs')} AS duration_bucket, "
        f"{_cut(_LEAD, 'days_before_departure')} AS booking_lead_bucket, COUNT(*) AS rows FROM bookings GROUP BY 1, 2, 3, 4"
    ),
    "silver_incremental_delta": _with(
        f"SELECT id, booking_hash, {_dbl(TARGET)} AS {TARGET}, {_text('updated_at')} AS updated_at FROM bookings "
        f"WHERE updated_at > (SELECT COALESCE(MAX(updated_at), TIMESTAMP '1900-01-01') FROM bookings "
        f"WHERE updated_at < TIMESTAMP '{LOADED_UNTIL}')"
    ),
    "silver_merge": _with(
        _UPSERT,
        _silver("old_silver", "snap", "MATERIALIZED"),
        "delta_bronze AS (SELECT * FROM upserted WHERE updated_at > (SELECT MAX(updated_at) FROM old_silver))",
        _silver("delta", "delta_bronze", "MATERIALIZED"),
        f"SELECT {_shown(SILVER_COLUMNS, _SILVER_STAMPS)} FROM (SELECT * FROM old_silver o WHERE NOT EXISTS "
        "(SELECT 1 FROM delta d WHERE d.booking_hash = o.booking_hash) UNION ALL SELECT * FROM delta)",
    ),
    "avg_fare_by_airline": _with(_SILVER, _BY_AIRLINE, "SELECT * FROM by_airline"),
    "avg_fare_by_class": _with(_SILVER, _BY_CLASS, "SELECT * FROM by_class"),
    "avg_fare_by_route": _with(_SILVER, _BY_ROUTE, "SELECT * FROM by_route"),
    "seasonal_fare_variation": _with(_SILVER, _BY_SEASON, "SELECT * FROM by_season"),
    "booking_count_by_airline": _with(_SILVER, _COUNT_BY_AIRLINE, "SELECT * FROM count_by_airline"),
    "top_routes": _with(_SILVER, _TOP_ROUTES, "SELECT * FROM top"),
    "ml_features": _with(
        _SILVER,
        _FEATURES,
        f"SELECT * EXCLUDE (booking_hash) REPLACE ({_dbl('duration_hrs')} AS duration_hrs, {_dbl(TARGET)} AS {TARGET}) FROM features",
    ),
    "departure_parts": _with(_PARTS.format(dow=_SUNDAY.format(c="t"))),
    "departure_parts_monday": _with(_PARTS.format(dow=_MONDAY.format(c="t"))),
    "duplicate_keys": _with(
        "SELECT COUNT(*) AS repeated_keys FROM (SELECT 1 FROM bookings GROUP BY booking_hash HAVING COUNT(*) > 1)"
    ),
    "dq_unique": _with("SELECT id AS value, COUNT(*) AS copies FROM bookings GROUP BY id HAVING COUNT(*) > 1"),
    "dq_not_null": _with(
        _SILVER,
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS nulls FROM silver"
            for c in SILVER_COLUMNS
            if c != "created_at"
        ),
    ),
    "dq_accepted_values": _with(
        "SELECT class AS value, COUNT(*) AS rows FROM bookings WHERE class NOT IN ('Economy', 'First Class') GROUP BY class"
    ),
    "bronze_gate": _with(_gate_sql()),
    "lost_cells": _with(
        "lost AS (SELECT COUNT(*) FILTER (WHERE stopovers = 'Direct') AS fares, COUNT(*) FILTER (WHERE stopovers = '1 Stop') AS times FROM bookings)",
        "SELECT 'lost:' || name AS check, 'warn' AS severity, CASE name WHEN 'total_fare_bdt' THEN fares "
        "WHEN 'departure_datetime' THEN times ELSE 0 END AS failures, failures = 0 AS passed FROM lost, "
        "UNNEST(['duration_hrs', 'base_fare_bdt', 'tax_surcharge_bdt', 'total_fare_bdt', 'days_before_departure', "
        "'departure_datetime', 'arrival_datetime']) AS n(name)",
    ),
    "silver_gate": _with(
        f"counts AS (SELECT COUNT(*) AS bronze_rows, COUNT(*) FILTER (WHERE updated_at < TIMESTAMP '{LOADED_UNTIL}') "
        "AS silver_rows FROM bookings)",
        "pct AS (SELECT *, CASE WHEN bronze_rows > 0 THEN CAST(ROUND(CAST((1 - silver_rows / bronze_rows) * 100 "
        "AS DECIMAL(20,10)), 1) AS DOUBLE) END AS drop_pct FROM counts)",
        "SELECT *, CASE WHEN silver_rows = 0 THEN 'failed' WHEN drop_pct > 50 THEN 'warning' ELSE 'passed' END AS verdict FROM pct",
    ),
    "gold_gate": _with(
        _GOLD,
        " UNION ALL ".join(
            [
                f"SELECT '{FEATURE_TABLE}' AS table_name, COUNT(*) AS row_count, 'error' AS severity, COUNT(*) > 0 AS passed "
                "FROM features"
            ]
            + [f"SELECT '{t}', COUNT(*), 'info', TRUE FROM {_GOLD_NAMES[t]}" for t in KPI_TABLES[:-1]]
            + [f"SELECT '{KPI_TABLES[-1]}', CAST(-1 AS BIGINT), 'info', TRUE"]
        ),
    ),
    "dq_suite": _with(_GOLD, _suite_sql()),
    "eda_fare_by_airline": _with(_RAW, _mean_by("airline", "raw")),
    "eda_popular_routes": _with(
        "SELECT source, destination, COUNT(*) AS rows FROM bookings GROUP BY ALL ORDER BY rows DESC, source, destination LIMIT 10"
    ),
    "eda_expensive_routes": _with(
        f"SELECT source, destination, ROUND({_avg(TARGET)}, 4) AS mean FROM bookings GROUP BY source, destination "
        f"ORDER BY {_avg(TARGET)} DESC, source, destination LIMIT 5"
    ),
    "eda_seasonal": _with(_RAW, _mean_by("seasonality", "raw", f", ROUND(STDDEV_SAMP({_dbl(TARGET)}), 4) AS std")),
    "fare_histogram": _with_tail(_histogram(f"SELECT {_dbl(TARGET)} AS x FROM bookings")),
    "fare_centre": _with(
        f"SELECT ROUND({_avg(TARGET)}, 4) AS mean, ROUND(quantile_cont({_dbl(TARGET)}, 0.5), 4) AS median FROM bookings"
    ),
    "fare_boxplot": _with(
        _RAW,
        f"fares AS (SELECT airline, {_dbl(TARGET)} AS x FROM raw WHERE airline IS NOT NULL)",
        "box AS (SELECT airline, COUNT(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, "
        "quantile_cont(x, 0.75) AS q3 FROM fares GROUP BY airline)",
        "SELECT airline, n, ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3, "
        "ROUND(LEAST(MIN(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), q1), 4) AS whisker_low, "
        "ROUND(GREATEST(MAX(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), q3), 4) AS whisker_high "
        "FROM fares JOIN box USING (airline) GROUP BY airline, n, box.q1, box.median, box.q3",
    ),
    "avg_fare_by_season": _with(_RAW, _mean_by("seasonality", "raw", rows="")),
    "avg_fare_by_month": _with(
        f"months AS (SELECT CAST(EXTRACT(MONTH FROM {_parse('departure_datetime')}) AS INT) AS departure_month, {TARGET} FROM bookings)",
        _mean_by("departure_month", "months", rows=""),
    ),
    "correlation_matrix": _with(
        " UNION ALL ".join(
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, ROUND(CORR({_dbl(a)}, {_dbl(b)}), 6) AS correlation FROM bookings"
            for a, b in _PAIRS
        )
    ),
    "describe_numeric": _with(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, COUNT({c}) AS rows, ROUND(AVG({_dbl(c)}), 4) AS mean, "
            f"ROUND(STDDEV_SAMP({_dbl(c)}), 4) AS std, ROUND(MIN({_dbl(c)}), 4) AS min, "
            f"ROUND(quantile_cont({_dbl(c)}, 0.25), 4) AS q25, ROUND(quantile_cont({_dbl(c)}, 0.5), 4) AS q50, "
            f"ROUND(quantile_cont({_dbl(c)}, 0.75), 4) AS q75, ROUND(MAX({_dbl(c)}), 4) AS max FROM bookings"
            for c in _NUMBERS
        )
    ),
    "missing_values": _with(
        _RAW,
        "SELECT * FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing FROM raw" for c in INPUT_COLUMNS)
        + ") WHERE missing > 0",
    ),
    "drop_leakage": _with(
        "SELECT airline, source, destination, "
        f"{_dbl('duration_hrs')} AS duration_hrs, stopovers, aircraft_type, class, booking_source, {_dbl(TARGET)} AS {TARGET}, "
        "seasonality, days_before_departure FROM bookings"
    ),
    "drop_null_target": _with(
        f"SELECT id, {_dbl('duration_hrs')} AS duration_hrs, {_dbl(TARGET)} AS {TARGET} FROM bookings WHERE duration_hrs IS NOT NULL"
    ),
    "engineer_features": _with(_SILVER, _engineered("silver", "departure_datetime")),
    "onehot_level_counts": _with(
        _SILVER,
        _FEATURES,
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {c} AS level, COUNT(*) AS rows FROM features WHERE {c} IS NOT NULL GROUP BY {c}"
            for c in CATEGORICAL_FEATURES
        ),
    ),
    "onehot_features": _with(
        _SILVER,
        _FEATURES,
        " UNION ALL ".join(
            f"SELECT '{c}_' || COALESCE(NULLIF({c}, ''), '(blank)') AS slot, COUNT(*) AS rows FROM features "
            f"WHERE {c} IS NOT NULL GROUP BY {c}"
            for c in CATEGORICAL_FEATURES
        ),
    ),
    "scaled_features": _with(
        _SILVER,
        _FEATURES,
        "stats AS (SELECT "
        + ", ".join(f"AVG({_dbl(c)}) AS {c}_m, STDDEV_POP({_dbl(c)}) AS {c}_s" for c in NUMERIC_FEATURES)
        + " FROM features)",
        "SELECT id, "
        + ", ".join(f"ROUND(COALESCE(({_dbl(c)} - {c}_m) / {c}_s, 0), 6) AS {c}" for c in NUMERIC_FEATURES)
        + " FROM features CROSS JOIN stats",
    ),
    "tree_models": _with(*_TREE_MODELS),
    "tree_importance": _with(
        *_TREE_MODELS[:3],
        "classes AS (SELECT class, COUNT(*) AS n, SUM(y) AS s FROM marked WHERE NOT held GROUP BY class)",
        # What a split between one class and all others takes off the sum of squares.
        "gains AS (SELECT class, s * s / n + (t - s) * (t - s) / (m - n) AS gain "
        "FROM classes, (SELECT SUM(n) AS m, SUM(s) AS t FROM classes))",
        "SELECT 'class_' || class AS feature, CASE WHEN gain = MAX(gain) OVER () THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM gains",
    ),
    "feed_shape": _with(f"SELECT COUNT(*) AS rows, {len(INPUT_COLUMNS)} AS columns FROM bookings"),
    "refresh_twice": _with(
        "keyed AS (SELECT substring(sha256(concat_ws('|', COALESCE(NULLIF(airline, ''), 'nan'), source, destination, "
        "COALESCE(NULLIF(departure_datetime, ''), 'nan'), class, booking_source)), 1, 32) AS k, updated_at FROM bookings)",
        f"counted AS (SELECT COUNT(DISTINCT k) FILTER (WHERE updated_at < TIMESTAMP '{LOADED_UNTIL}') AS early, "
        "COUNT(DISTINCT k) AS every FROM keyed)",
        "SELECT delivery, table_name, CASE delivery WHEN 1 THEN early ELSE every END AS row_count FROM counted, "
        f"(SELECT UNNEST([1, 2]) AS delivery), (SELECT UNNEST(['{BRONZE_TABLE}', '{SILVER_TABLE}']) AS table_name)",
    ),
    "silver_increments": _with(
        _DELIVERED, _silver("loaded_silver", "kept"), f"SELECT {_shown(SILVER_COLUMNS[1:], _SILVER_STAMPS)} FROM loaded_silver"
    ),
    "season_increments": _with(_DELIVERED, _silver("silver", "kept"), _BY_SEASON, "SELECT * FROM by_season"),
    "unchanged_delivery": _with(
        _DELIVERED,
        f"SELECT (SELECT COUNT(*) FROM delivered WHERE sent_at = TIMESTAMP '{REPRICED_AT}') AS sent_rows, "
        "(SELECT COUNT(*) FROM kept) AS rows, CAST(0 AS BIGINT) AS changed_rows, 0 AS changed_months",
    ),
    "file_ledger": _with(
        "SELECT CAST(run AS INT) AS run, CASE run WHEN 0 THEN COUNT(*) WHEN 1 THEN 0 "
        "ELSE COUNT(*) FILTER (WHERE stopovers = 'Direct') END AS rows_read FROM bookings, (SELECT UNNEST([0, 1, 2]) AS run) GROUP BY run"
    ),
    "publish_rebucketed": _with(
        "SELECT COUNT(DISTINCT booking_hash) AS keys, COUNT(DISTINCT booking_hash) AS merged, 2 AS stored_columns, "
        "8 AS stored_buckets FROM bookings"
    ),
    "train_test_split": _with(
        f"SELECT CASE WHEN {_slot(42, 100)} < 20 THEN 'test' ELSE 'train' END AS part, {_slot(43, 5)} AS fold, "
        "COUNT(*) AS rows FROM bookings GROUP BY 1, 2"
    ),
    "model_metrics": _with(_CLASS_MEAN, _METRICS),
    "residual_histogram": _with_tail(_CLASS_MEAN, _histogram("SELECT label - prediction AS x FROM class_mean")),
    "prediction_limits": _with(
        _CLASS_MEAN,
        "SELECT model, ROUND(MIN(LEAST(label, prediction)), 4) AS low, ROUND(MAX(GREATEST(label, prediction)), 4) AS high "
        "FROM class_mean GROUP BY model",
    ),
    "pred_vs_actual": _with(
        f"class_stats AS (SELECT AVG({_dbl(TARGET)}) AS mean, MAX({_dbl(TARGET)}) AS top, COUNT(*) AS points FROM bookings GROUP BY class)",
        "SELECT 'class mean' AS model, ROUND(mean, 4) AS prediction, points, ROUND(top - mean, 4) AS largest_residual FROM class_stats",
    ),
    "metric_comparison": _with(
        _CLASS_MEAN,
        f"metrics AS ({_METRICS})",
        "SELECT model, 'r2' AS metric, r2 AS value FROM metrics UNION ALL SELECT model, 'mae', mae FROM metrics "
        "UNION ALL SELECT model, 'rmse', rmse FROM metrics",
    ),
    "score_batch": _with(
        _SILVER,
        f"line AS (SELECT regr_slope({_dbl(TARGET)}, {_dbl('duration_hrs')}) AS slope, "
        f"regr_intercept({_dbl(TARGET)}, {_dbl('duration_hrs')}) AS base FROM silver)",
        f"fares AS (SELECT id, base + slope * {_dbl('duration_hrs')} AS fare FROM silver CROSS JOIN line)",
        "SELECT id, ROUND(fare, 2) AS predicted_fare_bdt, ROUND(fare / 120, 2) AS predicted_fare_usd FROM fares",
    ),
    "cv_scores": _with(
        *_line_models(**{"Linear Regression": _OLS}), "SELECT model, cv_mean_r2, cv_std_r2 FROM cv"
    ),
    "tune_models": _with(
        *_line_models(**{"Linear Regression": _OLS, **{f"Ridge {a}": _ridge(a) for a in RIDGE_ALPHAS}}),
        "named AS (SELECT CASE WHEN model LIKE 'Ridge%' THEN 'Ridge' ELSE model END AS model, exact_mean, cv_mean_r2, "
        "cv_std_r2 FROM cv)",
        "SELECT model, arg_max(cv_mean_r2, exact_mean) AS cv_mean_r2, arg_max(cv_std_r2, exact_mean) AS cv_std_r2 "
        "FROM named GROUP BY model",
    ),
    "model_comparison": _with(
        *_line_models(**{"Linear Regression": _OLS, "Ridge": _ridge(10.0), "Lasso": _lasso(1.0)}), _COMPARED
    ),
    "best_model": _with(
        *_line_models(**{"Linear Regression": _OLS, "Ridge": _ridge(100000.0), "Lasso": _lasso(50.0)}),
        f"{_COMPARED} ORDER BY r2 DESC LIMIT 1",
    ),
    "model_roundtrip": _with(
        *_line_models(**{"Linear Regression": _OLS}),
        f"fares AS (SELECT id, my + slope * (({_dbl('duration_hrs')} - m) / s - mx) AS fare FROM silver "
        f"CROSS JOIN scaler CROSS JOIN (SELECT * FROM fits WHERE part = {LINE_FOLDS}))",
        "SELECT id, ROUND(fare, 2) AS predicted_fare_bdt, ROUND(fare / 120, 2) AS predicted_fare_usd FROM fares",
    ),
}
ORACLE["load_cascade_gold"] = ORACLE["ml_features"]

# A whole run leaves the metrics of the comparison on file; a search that goes on finds what a whole one does.
ORACLE["training_run"] = ORACLE["model_comparison"]
ORACLE["resumed_search"] = ORACLE["tune_models"]
