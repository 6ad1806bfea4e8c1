"""The adapter views as ANSI SQL common table expressions, used only to state expected results."""

from __future__ import annotations

from skyledger.sources.adapters import MOVEMENT_COLUMNS, flight_columns

_COLUMNS = flight_columns(lambda later, earlier: f"date_diff('day', {earlier}, {later})")

FLIGHTS = (
    "flights AS (SELECT " + ", ".join(f"{e} AS {n}" for n, (_, e) in _COLUMNS.items())
    + " FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey"
      " LEFT JOIN customer ON o_custkey = c_custkey)"
)

MOVEMENTS = (
    "movements AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in MOVEMENT_COLUMNS.items())
    + ", CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS dep_seconds FROM events)"
)

SCORED = FLIGHTS + """, scored AS (SELECT *, CAST(arr_delay >= 120 AS INT) AS label,
  CAST(date_diff('day', DATE '1970-01-01', flight_date) AS BIGINT) AS day,
  year(flight_date) * 12 + month(flight_date) AS month,
  CASE WHEN year(flight_date) <= 1999 THEN 'development' WHEN year(flight_date) = 2000 THEN 'validation' ELSE 'final_test' END AS period
  FROM flights WHERE cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL)"""

REGIONS = "regions AS (SELECT 'N' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS airport, 'R' || CAST(n_regionkey AS STRING) AS region FROM nation)"


def div(a: str, b: str) -> str:
    """Double ratio, null for a zero denominator."""
    return f"(CAST({a} AS DOUBLE) / NULLIF({b}, 0))"
