"""Route-graph queries: daily graphs for paths and components, yearly graphs for exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import disruption as D
from skyledger.operators import graph as G
from skyledger.operators import paths as P
from skyledger.plans.disruption import _UTC, _UTC_SUMS, utc_outcomes
from skyledger.plans.oracle_views import FLIGHTS, div
from skyledger.session import cut_lineage, stage
from skyledger.sources.adapters import flights


def _round(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _daily(spark, folder):
    df = flights(spark, folder, "flight_date", "origin", "destination").withColumn("day", F.unix_date("flight_date"))
    return G.route_edges(df, "day")


def _yearly(spark, folder):
    return G.route_edges(flights(spark, folder, "flight_date", "origin", "destination").withColumn("year", F.year("flight_date")), "year")


def route_graph_summary(spark, folder):
    return _round(G.graph_summary(_daily(spark, folder), "day"), "density")


def edge_checks(spark, folder):
    """The edge audit on a copy of the daily edges with spoiled rows: blank ends, loops, odd weights and repeats."""
    edges = _daily(spark, folder)
    spoiled = edges.select(
        "day", F.when((F.col("weight") == 1) & (F.col("src") == "N05"), " ").otherwise(F.col("src")).alias("src"), F.when(F.col("src") == "N07", F.col("src")).otherwise(F.col("dst")).alias("dst"),
        F.when(F.col("dst") == "N11", 0.0).when(F.col("dst") == "N12", 1.5).otherwise(F.col("weight").cast("double")).alias("weight"))
    return G.edge_problems(spoiled.unionByName(spoiled.where(F.col("src") == "N03")))


def degree_metrics(spark, folder):
    return G.degrees(_daily(spark, folder), "day").select("day", "node", "in_degree", "out_degree", "weighted_in", "weighted_out")


def route_hhi(spark, folder):
    return _round(G.degrees(_yearly(spark, folder), "year").select("year", "node", "outgoing_hhi", "incoming_hhi"), "outgoing_hhi", "incoming_hhi")


def components(spark, folder):
    """Weakly and strongly connected components per daily graph."""
    edges = cut_lineage(_daily(spark, folder))
    weak = G.weak_components(edges, "day").groupBy("day").agg(F.count("*").alias("nodes"), F.countDistinct("label").alias("weak_components"))
    strong = G.strong_components(edges, "day").groupBy("day").agg(F.countDistinct("label").alias("strong_components"))
    return weak.join(strong, "day")


def all_pairs_bfs(spark, folder):
    return P.reach(_daily(spark, folder), "day")


def betweenness(spark, folder):
    return _round(P.centrality(stage(_daily(spark, folder)), "day"), "betweenness").select("day", "node", "betweenness")


def closeness(spark, folder):
    return _round(P.centrality(stage(_daily(spark, folder)), "day", between=False), "closeness")


def pagerank(spark, folder):
    return _round(G.pagerank(cut_lineage(_yearly(spark, folder)), "year"), "pagerank", digits=8)


def _tables(spark, folder):
    """Route outcomes and node metrics of the UTC-year graphs."""
    df = utc_outcomes(spark, folder)
    routes = cut_lineage(D.routes_by_period(df, "utc_year"))
    edges = cut_lineage(routes.select("utc_year", F.col("origin").alias("src"), F.col("destination").alias("dst"), F.col("scheduled").alias("weight")))
    return routes, edges, cut_lineage(P.node_metrics(edges, "utc_year"))


def yearly_metrics(spark, folder):
    _, _, metrics = _tables(spark, folder)
    return _round(metrics, "outgoing_hhi", "incoming_hhi", "betweenness", "closeness", "pagerank")


EXPOSED = ("density", "mean_betweenness", "max_betweenness", "mean_outgoing_hhi", "max_pagerank", "top_10_share", "cancellation_rate", "diversion_rate", "severe_rate")


def network_exposure(spark, folder):
    routes, edges, metrics = _tables(spark, folder)
    return _round(G.exposure(routes, metrics, G.graph_summary(edges, "utc_year"), "utc_year"), *EXPOSED, digits=8)


def network_regimes(spark, folder):
    routes, edges, metrics = _tables(spark, folder)
    out = G.regime_comparison(G.exposure(routes, metrics, G.graph_summary(edges, "utc_year"), "utc_year"), metrics, "utc_year", 1995, 2001)
    return _round(out, *[c for c in out.columns if c != "utc_year"], digits=7)


def centrality_disruption(spark, folder):
    routes, _, metrics = _tables(spark, folder)
    out = G.centrality_outcomes(routes, metrics, "utc_year", 100)
    return _round(out, "outgoing_hhi", "incoming_hhi", "betweenness", "closeness", "pagerank", "severe_rate", "cancellation_rate", digits=8)


def busiest_subgraph(spark, folder):
    return G.busiest_subgraph(_yearly(spark, folder), "year", 10, 15)


QUERIES = {f.__name__: f for f in (
    route_graph_summary, edge_checks, degree_metrics, route_hhi, components, all_pairs_bfs, betweenness, closeness, pagerank, yearly_metrics,
    network_exposure, network_regimes, centrality_disruption, busiest_subgraph)}

_DAY = "CAST(date_diff('day', DATE '1970-01-01', flight_date) AS INT)"


def _edges(window: str, name: str) -> str:
    return f"{FLIGHTS}, e AS (SELECT {window} AS {name}, origin AS src, destination AS dst, count(*) AS weight FROM flights WHERE origin <> destination GROUP BY 1, 2, 3)"


_ED = _edges(_DAY, "day")
_EY = _edges("year(flight_date)", "year")
_EU = _UTC + ", e AS (SELECT utc_year, origin AS src, destination AS dst, count(*) AS weight FROM u WHERE origin <> destination AND utc_year IS NOT NULL GROUP BY 1, 2, 3)"


def _nodes(w: str) -> str:
    return f"nd AS (SELECT DISTINCT {w}, unnest([src, dst]) AS node FROM e), ns AS (SELECT {w}, count(*) AS n FROM nd GROUP BY 1)"


def _degree(w: str) -> str:
    return f"""dg AS (SELECT {w}, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i * weight) AS BIGINT) AS weighted_in, CAST(sum(o * weight) AS BIGINT) AS weighted_out,
  coalesce(sum(o * weight * weight)::DOUBLE / nullif(sum(o * weight) ** 2, 0), 0) AS outgoing_hhi, coalesce(sum(i * weight * weight)::DOUBLE / nullif(sum(i * weight) ** 2, 0), 0) AS incoming_hhi
  FROM (SELECT {w}, src AS node, 0 AS i, 1 AS o, weight FROM e UNION ALL SELECT {w}, dst, 1, 0, weight FROM e) GROUP BY 1, 2)"""


def _levels(w: str) -> str:
    """Breadth-first search that keeps only first visits, one level per recursion step."""
    return f"""bf({w}, s, v, d, seen) AS (SELECT {w}, node, node, 0, [node] FROM nd UNION ALL
  SELECT {w}, s, unnest(fresh), d + 1, seen || fresh FROM (SELECT {w}, s, d, seen, list_filter(nx, lambda x: NOT list_contains(seen, x)) AS fresh FROM
    (SELECT b.{w}, s, any_value(d) AS d, any_value(seen) AS seen, list(DISTINCT dst) AS nx FROM bf b JOIN e ON e.{w} = b.{w} AND e.src = v GROUP BY 1, 2)) WHERE len(fresh) > 0),
ds AS (SELECT {w}, s, v, d FROM bf)"""


def _sigma(w: str) -> str:
    return f"""sg({w}, s, v, d, sigma) AS (SELECT {w}, node, node, 0, 1.0::DOUBLE FROM nd UNION ALL
  SELECT g.{w}, g.s, e.dst, any_value(g.d) + 1, sum(sigma) FROM sg g JOIN e ON e.{w} = g.{w} AND e.src = g.v JOIN ds ON ds.{w} = g.{w} AND ds.s = g.s AND ds.v = e.dst AND ds.d = g.d + 1 GROUP BY g.{w}, g.s, e.dst),
bt AS (SELECT a.{w}, a.v AS node, sum(a.sigma * b.sigma / t.sigma) AS b FROM sg a JOIN sg b ON a.{w} = b.{w} AND a.v = b.s JOIN sg t ON t.{w} = a.{w} AND t.s = a.s AND t.v = b.v AND t.d = a.d + b.d
  WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v GROUP BY 1, 2),
bw AS (SELECT nd.{w}, nd.node, CASE WHEN n > 2 THEN coalesce(b, 0) / ((n - 1.0) * (n - 2.0)) ELSE 0 END::DOUBLE AS betweenness FROM nd JOIN ns USING ({w}) LEFT JOIN bt USING ({w}, node))"""


def _close(w: str) -> str:
    return f"""cl AS (SELECT {w}, v AS node, CASE WHEN sum(d) > 0 THEN (count(*) - 1)::DOUBLE / sum(d) * ((count(*) - 1)::DOUBLE / (any_value(n) - 1)) ELSE 0 END::DOUBLE AS closeness FROM ds JOIN ns USING ({w}) GROUP BY 1, 2)"""


def _rank(w: str) -> str:
    return f"""tw AS (SELECT {w}, src, sum(weight) AS t FROM e GROUP BY 1, 2), mv AS (SELECT e.{w}, e.src, e.dst, weight::DOUBLE / t AS p FROM e JOIN tw ON tw.{w} = e.{w} AND tw.src = e.src),
st AS (SELECT nd.{w}, node, n, tw.src IS NULL AS loose FROM nd JOIN ns USING ({w}) LEFT JOIN tw ON tw.{w} = nd.{w} AND tw.src = node),
pr(it, {w}, node, r, done) AS (SELECT 0, {w}, node, 1.0::DOUBLE / n, false FROM st UNION ALL
  SELECT it + 1, {w}, node, nr, sum(abs(nr - r)) OVER (PARTITION BY {w}) < n * 1e-6 FROM (
    SELECT c.it, c.{w}, c.node, c.r, st.n, 0.85 * (coalesce(i.x, 0) + l.x / st.n) + 0.15 / st.n AS nr FROM pr c JOIN st ON st.{w} = c.{w} AND st.node = c.node
    LEFT JOIN (SELECT mv.{w}, dst, sum(p2.r * p) AS x FROM mv JOIN pr p2 ON p2.{w} = mv.{w} AND p2.node = mv.src GROUP BY 1, 2) i ON i.{w} = c.{w} AND i.dst = c.node
    JOIN (SELECT p3.{w}, sum(CASE WHEN loose THEN p3.r ELSE 0 END) AS x FROM pr p3 JOIN st s3 ON s3.{w} = p3.{w} AND s3.node = p3.node GROUP BY 1) l ON l.{w} = c.{w} WHERE NOT c.done) WHERE it < 100),
pg AS (SELECT {w}, node, arg_max(r, it) AS pagerank FROM pr GROUP BY 1, 2)"""


_W = "WITH RECURSIVE "
_ALL = f"{_EU}, {_nodes('utc_year')}, {_degree('utc_year')}, {_levels('utc_year')}, {_sigma('utc_year')}, {_close('utc_year')}, {_rank('utc_year')}, mt AS (SELECT * FROM dg JOIN bw USING (utc_year, node) JOIN cl USING (utc_year, node) JOIN pg USING (utc_year, node))"
_ROUTES = f"ro AS (SELECT utc_year, origin, destination, {_UTC_SUMS} FROM u WHERE origin <> destination AND utc_year IS NOT NULL GROUP BY 1, 2, 3)"
_EXPOSURE = f"""{_ALL}, {_ROUTES}, gsum AS (SELECT utc_year, any_value(n) AS node_count, count(*) AS edge_count, CAST(sum(weight) AS BIGINT) AS scheduled_flights, count(*)::DOUBLE / (any_value(n) * (any_value(n) - 1)) AS density FROM e JOIN ns USING (utc_year) GROUP BY 1),
tt AS (SELECT utc_year, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in D.COUNTS)}, count(*) AS route_count FROM ro GROUP BY 1),
ap AS (SELECT utc_year, airport, sum(scheduled) AS n FROM (SELECT utc_year, unnest([origin, destination]) AS airport, scheduled FROM ro) GROUP BY 1, 2),
ar AS (SELECT *, row_number() OVER (PARTITION BY utc_year ORDER BY n DESC, airport) AS r FROM ap),
apt AS (SELECT utc_year, count(*) AS airport_count, CAST(sum(n) AS BIGINT) AS airport_appearances, CAST(sum(n) FILTER (r <= 10) AS BIGINT) AS top_10_appearances FROM ar GROUP BY 1),
md AS (SELECT utc_year, count(*) AS metric_airports, avg(betweenness) AS mean_betweenness, max(betweenness) AS max_betweenness, avg(outgoing_hhi) AS mean_outgoing_hhi, max(pagerank) AS max_pagerank FROM mt GROUP BY 1),
xp AS (SELECT *, top_10_appearances::DOUBLE / airport_appearances AS top_10_share, {div('cancelled_flights', 'scheduled')} AS cancellation_rate, {div('diverted_flights', 'scheduled')} AS diversion_rate, {div('severe', 'completed')} AS severe_rate,
  scheduled_flights = scheduled AND edge_count = route_count AND node_count = airport_count AND node_count = metric_airports AND airport_appearances = 2 * scheduled AS reconciles
  FROM gsum JOIN tt USING (utc_year) JOIN apt USING (utc_year) JOIN md USING (utc_year))"""
_M = "in_degree, out_degree, weighted_in, weighted_out"


def _r(columns, digits=9):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


_REGIME_COLUMNS = ("cancellation_rate", "severe_rate", "density", "median_betweenness", "p90_betweenness", "median_pagerank", "median_outgoing_hhi",
                   "cancellation_change_pp", "severe_change_pp", "density_change", "volume_change_pct", "route_change_pct")

SQL = {
    "route_graph_summary": f"WITH {_ED}, {_nodes('day')} SELECT day, any_value(n) AS node_count, count(*) AS edge_count, CAST(sum(weight) AS BIGINT) AS scheduled_flights, round(count(*)::DOUBLE / (any_value(n) * (any_value(n) - 1)), 9) AS density FROM e JOIN ns USING (day) GROUP BY 1",
    "edge_checks": f"""WITH {_ED}, s AS (SELECT day, CASE WHEN weight = 1 AND src = 'N05' THEN ' ' ELSE src END AS src, CASE WHEN src = 'N07' THEN src ELSE dst END AS dst,
  CASE dst WHEN 'N11' THEN 0.0 WHEN 'N12' THEN 1.5 ELSE weight END::DOUBLE AS weight FROM e), a AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE src = 'N03'),
g AS (SELECT day, src, dst, count(*) AS n, min(weight) AS low, max(weight % 1) AS part FROM a GROUP BY ALL)
SELECT count(*) FILTER (trim(src) = '' OR trim(dst) = '') AS blank_ends, count(*) FILTER (src = dst) AS self_loops, count(*) FILTER (low <= 0) AS non_positive, count(*) FILTER (part <> 0) AS fractional, count(*) FILTER (n > 1) AS duplicates FROM g""",
    "degree_metrics": f"WITH {_ED}, {_degree('day')} SELECT day, node, {_M} FROM dg",
    "route_hhi": f"WITH {_EY}, {_degree('year')} SELECT year, node, {_r(['outgoing_hhi', 'incoming_hhi'])} FROM dg",
    "components": f"""{_W}{_ED}, {_nodes('day')}, {_levels('day')}, un AS (SELECT day, src, dst FROM e UNION SELECT day, dst, src FROM e),
wk(day, node, label) AS (SELECT day, node, node FROM nd UNION SELECT w.day, dst, label FROM wk w JOIN un ON un.day = w.day AND un.src = w.node WHERE label < dst),
wl AS (SELECT day, node, min(label) AS label FROM wk GROUP BY 1, 2), sl AS (SELECT a.day, a.s AS node, min(a.v) AS label FROM ds a JOIN ds b ON a.day = b.day AND a.s = b.v AND a.v = b.s GROUP BY 1, 2),
wc AS (SELECT day, count(*) AS nodes, count(DISTINCT label) AS weak_components FROM wl GROUP BY 1), sc AS (SELECT day, count(DISTINCT label) AS strong_components FROM sl GROUP BY 1) SELECT * FROM wc JOIN sc USING (day)""",
    "all_pairs_bfs": f"{_W}{_ED}, {_nodes('day')}, {_levels('day')} SELECT day, s AS source, count(*) AS reached, CAST(max(d) AS INT) AS eccentricity, CAST(sum(d) AS BIGINT) AS distance_sum FROM ds GROUP BY 1, 2",
    "betweenness": f"{_W}{_ED}, {_nodes('day')}, {_levels('day')}, {_sigma('day')} SELECT day, node, round(betweenness, 9) AS betweenness FROM bw",
    "closeness": f"{_W}{_ED}, {_nodes('day')}, {_levels('day')}, {_close('day')} SELECT day, node, round(closeness, 9) AS closeness FROM cl",
    "pagerank": f"{_W}{_EY}, {_nodes('year')}, {_rank('year')} SELECT year, node, round(pagerank, 8) AS pagerank FROM pg",
    "yearly_metrics": f"{_W}{_ALL} SELECT utc_year, node, {_M}, {_r(['outgoing_hhi', 'incoming_hhi', 'betweenness', 'closeness', 'pagerank'])} FROM mt",
    "network_exposure": f"{_W}{_EXPOSURE} SELECT * REPLACE ({', '.join(f'round({c}, 8) AS {c}' for c in EXPOSED)}) FROM xp",
    "network_regimes": f"""{_W}{_EXPOSURE}, sp AS (SELECT utc_year, median(betweenness) AS median_betweenness, quantile_cont(betweenness, 0.9) AS p90_betweenness, median(pagerank) AS median_pagerank, median(outgoing_hhi) AS median_outgoing_hhi FROM mt GROUP BY 1),
rf AS (SELECT * FROM xp WHERE utc_year = 1995), rg AS (SELECT xp.utc_year, xp.cancellation_rate, xp.severe_rate, xp.density, sp.* EXCLUDE (utc_year), (xp.cancellation_rate - rf.cancellation_rate) * 100 AS cancellation_change_pp,
  (xp.severe_rate - rf.severe_rate) * 100 AS severe_change_pp, xp.density - rf.density AS density_change, CASE WHEN xp.utc_year <> 2001 THEN (xp.scheduled::DOUBLE / rf.scheduled - 1) * 100 END AS volume_change_pct,
  CASE WHEN xp.utc_year <> 2001 THEN (xp.edge_count::DOUBLE / rf.edge_count - 1) * 100 END AS route_change_pct FROM xp JOIN sp USING (utc_year), rf) SELECT utc_year, {_r(_REGIME_COLUMNS, 7)} FROM rg""",
    "centrality_disruption": f"""{_W}{_ALL}, {_ROUTES}, og AS (SELECT utc_year, origin AS node, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('scheduled', 'cancelled_flights', 'completed', 'severe'))} FROM ro GROUP BY 1, 2)
SELECT utc_year, node, scheduled, cancelled_flights, completed, severe, {_M}, {_r(['outgoing_hhi', 'incoming_hhi', 'betweenness', 'closeness', 'pagerank'], 8)}, round({div('severe', 'completed')}, 8) AS severe_rate,
round({div('cancelled_flights', 'scheduled')}, 8) AS cancellation_rate, completed >= 100 AS supported, weighted_out = scheduled AS flights_agree FROM og LEFT JOIN mt USING (utc_year, node)""",
    "busiest_subgraph": f"""WITH {_EY}, tp AS (SELECT node FROM (SELECT unnest([src, dst]) AS node, weight FROM e) GROUP BY 1 ORDER BY sum(weight) DESC, node LIMIT 10)
SELECT year, src, dst, weight, CAST(row_number() OVER (PARTITION BY year ORDER BY weight DESC, src, dst) AS INT) AS rank FROM e WHERE src IN (FROM tp) AND dst IN (FROM tp) QUALIFY rank <= 15""",
}
