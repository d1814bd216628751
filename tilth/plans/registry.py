"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: The hourly grid g(device, ts, i, value) of the event stream.
GRID = """
h AS (SELECT event_type AS device, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2),
b AS (SELECT device, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY 1),
e AS (SELECT device, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b),
g AS MATERIALIZED (SELECT e.device, e.ts, row_number() OVER (PARTITION BY e.device ORDER BY e.ts) - 1 AS i, h.value
      FROM e LEFT JOIN h ON e.device = h.device AND e.ts = h.ts)"""

#: Folds of that grid: f(device, ts, i, value, n, fold).
FOLDS = (
    GRID
    + """,
gn AS (SELECT *, count(*) OVER (PARTITION BY device) AS n FROM g),
f AS MATERIALIZED (SELECT *, CAST(-1 + """
    + " + ".join(f"CAST(i >= n // 2 + CAST(round_even({k} * (n - n // 2) / 5.0, 0) AS BIGINT) AS INT)" for k in range(5))
    + """ AS INT) AS fold FROM gn)"""
)

#: Daily weather wd(date, temp_max_c, temp_min_c, precip_mm, et0_mm) with gaps.
WEATHER = """
wd AS (SELECT CAST(ts AS DATE) AS date, max(value) / 20 AS temp_max_c, avg(value) / 20 AS temp_min_c,
       CASE WHEN dayofyear(CAST(ts AS DATE)) % 5 <> 0 THEN sum(value) FILTER (event_type = 'error') / 1000 END AS precip_mm,
       avg(value) FILTER (event_type = 'view') / 20 AS et0_mm
       FROM events GROUP BY CAST(ts AS DATE) HAVING dayofyear(CAST(ts AS DATE)) % 7 <> 0)"""


def phi(x: str) -> str:
    """SQL of the normal distribution function at a column, by its series of odd powers over double factorials."""
    terms = f"list_sum(list_transform(range(0, 130), lambda k: power({x}::DOUBLE, 2 * k + 1) / exp(lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))"
    return f"(CASE WHEN {x} < -8 THEN 0.0 WHEN {x} > 8 THEN 1.0 ELSE 0.5 + exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {terms} END)"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
