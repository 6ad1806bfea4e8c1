"""Airport bin, lookback and trailing-count queries over the movement view."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import bins as B
from skyledger.operators.schema import enforce
from skyledger.plans.oracle_views import MOVEMENTS, div
from skyledger.sources.adapters import movements
from skyledger.session import scratch_folder
from skyledger.sources.files import publish, read_parquet

VALIDATION_FROM, FINAL_FROM = 1705795200, 1706227200  # 2024-01-21 and 2024-01-26 UTC
WINDOW = B.LOOKBACK * B.BIN_HOURS * 3600


def _moves(spark, folder):
    df = movements(spark, folder)
    second = F.col("dep_seconds")
    return df.select("*", (second - 7200).alias("prediction_seconds"),
                     F.when(second < VALIDATION_FROM, "development").when(second < FINAL_FROM, "validation").otherwise("final_test").alias("split"))


def _looked(spark, folder):
    df = _moves(spark, folder)
    grid = B.grid_for(df)
    return B.lookback(df, B.airport_bins(df, grid), grid), grid


def airport_bins(spark, folder):
    df = _moves(spark, folder)
    return B.airport_bins(df, B.grid_for(df))


def lookback_sequences(spark, folder):
    df, _ = _looked(spark, folder)
    return df.select("movement_id", "end_bin", "valid_bins", F.posexplode("sequence").alias("position", "s")).select(
        "movement_id", "end_bin", "valid_bins", "position", *[f"s.{c}" for c in B.CHANNELS], "s.real")


def lookback_guard(spark, folder):
    """The lookback audit on a copy in which some rows read a bin that is still open."""
    df, grid = _looked(spark, folder)
    ahead = F.when(F.col("movement_id") % 97 == 0, 1).otherwise(0)
    return B.late_bins(df.withColumn("end_bin", F.col("end_bin") + ahead), grid)


def lookback_availability(spark, folder):
    df, _ = _looked(spark, folder)
    return B.availability(df, "split").withColumn("share_not_full", F.round("share_not_full", 9))


def _prior(df, keys):
    facts = df.select(*keys, F.col("dep_seconds").alias("second"))
    return B.past_counts(facts, df.where(F.col("split") == "development").select(*keys, F.col("prediction_seconds").alias("second")), keys, WINDOW)


def trailing_counts(spark, folder):
    return _prior(_moves(spark, folder), ["airport", "destination"])


def lookback_density(spark, folder):
    df = _moves(spark, folder)
    keys = {"origin": ["airport"], "route": ["airport", "destination"], "carrier_at_origin": ["carrier", "airport"]}
    parts = [B.density(_prior(df, k), name) for name, k in keys.items()]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumns({c: F.round(c, 9) for c in ("share_zero", "share_below_5")})


def bin_recount(spark, folder):
    """Seeded cells recounted from the rows, against a copy of the bins in which some counts are spoiled."""
    df = _moves(spark, folder)
    grid = B.grid_for(df)
    spoiled = B.airport_bins(df, grid).withColumn("departures", F.col("departures") + F.when(F.col("bin") % 13 == 0, 1).otherwise(0))
    return B.recount_cells(df, spoiled, grid, 200, 1)


def channel_scaler(spark, folder):
    df, _ = _looked(spark, folder)
    return B.channel_scaler(df.where(F.col("split") == "development")).withColumns({c: F.round(c, 9) for c in ("mean", "std")})


def scaled_sequences(spark, folder):
    """Sum of the scaled values per movement and channel."""
    df, _ = _looked(spark, folder)
    scaled = B.scale_sequences(df, B.channel_scaler(df.where(F.col("split") == "development")))
    return scaled.select("movement_id", *[F.round(B.channel_sum(c), 6).alias(c) for c in B.CHANNELS])


def sequence_perturb(spark, folder):
    """Every named change of the lookback, as real positions and summed departures per movement."""
    df, _ = _looked(spark, folder)
    changes = F.explode(F.array(*[F.struct(F.lit(n).alias("change"), c.alias("sequence")) for n, c in B.perturbations().items()]))
    long = df.select("movement_id", changes.alias("c"))
    return long.select("movement_id", "c.change", F.size(F.filter("c.sequence", lambda s: s["real"])).alias("real_positions"),
                       B.channel_sum("departures", "c.sequence").alias("departures"))


def sequence_shuffle(spark, folder):
    """Lookbacks handed to other movements in a seeded order; the multiset of lookbacks stays the same."""
    df, _ = _looked(spark, folder)
    shuffled = B.shuffle_sequences(df, "movement_id", 7)
    return shuffled.select("movement_id", B.channel_sum("departures").alias("departures"))


def saved_bins(spark, folder):
    """The bin table published as a checked Parquet table, partition-free and long, and read back with a pushed filter."""
    df = _moves(spark, folder)
    path = scratch_folder(spark)
    publish(B.airport_bins(df, B.grid_for(df)), path, lambda t: enforce(t.agg(F.count("*").alias("n")), {"not empty": F.col("n") > 0}))
    return read_parquet(spark, path, ["airport", "bin", "departures"], F.col("arrivals") > 0)


QUERIES = {f.__name__: f for f in (
    airport_bins, lookback_sequences, lookback_guard, lookback_availability, trailing_counts, lookback_density, bin_recount, channel_scaler,
    scaled_sequences, sequence_perturb, sequence_shuffle, saved_bins)}

_PLACED = "(elapsed > 0 AND elapsed <= 1440)"
_BINS = f"""{MOVEMENTS}, mv AS (SELECT *, dep_seconds - 7200 AS prediction_seconds, CASE WHEN dep_seconds < {VALIDATION_FROM} THEN 'development' WHEN dep_seconds < {FINAL_FROM} THEN 'validation' ELSE 'final_test' END AS split,
  CASE WHEN {_PLACED} THEN dep_seconds + CAST(round_even(elapsed * 60, 0) AS BIGINT) END AS arr_seconds FROM movements),
g AS (SELECT CAST(floor(min(dep_seconds) / 86400.0) AS BIGINT) * 86400 AS g0 FROM mv),
x AS (SELECT mv.*, CAST(floor((dep_seconds - g0) / 10800.0) AS INT) AS db, CAST(floor((arr_seconds - g0) / 10800.0) AS INT) AS ab, CAST(floor((prediction_seconds - g0) / 10800.0) AS INT) AS end_bin FROM mv, g),
bd AS (SELECT airport, db AS bin, count(*) AS departures, count(DISTINCT destination) AS u FROM x GROUP BY 1, 2),
ba AS (SELECT destination AS airport, ab AS bin, count(*) AS arrivals FROM x WHERE ab IS NOT NULL GROUP BY 1, 2),
bins AS (SELECT coalesce(bd.airport, ba.airport) AS airport, coalesce(bd.bin, ba.bin) AS bin, coalesce(departures, 0) AS departures, coalesce(arrivals, 0) AS arrivals, coalesce(u, 0) AS distinct_destinations
  FROM bd FULL JOIN ba ON bd.airport = ba.airport AND bd.bin = ba.bin)"""
_LOOK = _BINS + """, lk AS (SELECT movement_id, split, airport, end_bin, CAST(least(greatest(end_bin - 8, 0), 16) AS INT) AS valid_bins, CAST(p AS INT) AS position, end_bin - 16 + p AS b FROM x, range(0, 16) r(p)),
sq AS (SELECT lk.*, b >= 8 AS real, CASE WHEN b >= 8 THEN coalesce(departures, 0) ELSE 0 END::DOUBLE AS departures, CASE WHEN b >= 8 THEN coalesce(arrivals, 0) ELSE 0 END::DOUBLE AS arrivals,
  CASE WHEN b >= 8 THEN coalesce(distinct_destinations, 0) ELSE 0 END::DOUBLE AS distinct_destinations FROM lk LEFT JOIN bins ON bins.airport = lk.airport AND bins.bin = lk.b)"""


def _prior_sql(keys: str) -> str:
    on = " AND ".join(f"f.{k} = q.{k}" for k in keys.split(", "))
    return f"""SELECT {', '.join('q.' + k for k in keys.split(', '))}, q.second, any_value(q.rows) AS rows, count(f.dep_seconds) AS prior
FROM (SELECT {keys}, prediction_seconds AS second, count(*) AS rows FROM x WHERE split = 'development' GROUP BY ALL) q
LEFT JOIN x f ON {on} AND f.dep_seconds >= q.second - {WINDOW} AND f.dep_seconds < q.second GROUP BY ALL"""


def _density_sql(name: str, keys: str) -> str:
    return f"""SELECT '{name}' AS entity, count(*) AS flights, quantile_cont(prior, 0.1)::DOUBLE AS p10, quantile_cont(prior, 0.5)::DOUBLE AS p50, quantile_cont(prior, 0.9)::DOUBLE AS p90,
round({div('count(*) FILTER (prior = 0)', 'count(*)')}, 9) AS share_zero, round({div('count(*) FILTER (prior < 5)', 'count(*)')}, 9) AS share_below_5
FROM (SELECT prior, unnest(range(0, rows)) FROM ({_prior_sql(keys)}))"""


_SCALER = _LOOK + ", sc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS channel, count(*) AS positions, avg(ln(1 + {c})) AS mean, stddev_pop(ln(1 + {c})) AS std FROM sq WHERE split = 'development' AND real" for c in B.CHANNELS) + ")"
_CHANGES = [("baseline", "false"), ("no_sequence", "true"), ("keep_newest_1", "position < 15"), ("keep_newest_4", "position < 12"), ("keep_newest_8", "position < 8"),
            ("mask_oldest_quarter", "position < 4"), ("mask_second_oldest_quarter", "position BETWEEN 4 AND 7"),
            ("mask_second_newest_quarter", "position BETWEEN 8 AND 11"), ("mask_newest_quarter", "position >= 12")]

SQL = {
    "saved_bins": f"WITH {_BINS} SELECT airport, bin, departures FROM bins WHERE arrivals > 0",
    "airport_bins": f"WITH {_BINS} SELECT * FROM bins",
    "lookback_sequences": f"WITH {_LOOK} SELECT movement_id, end_bin, valid_bins, position, departures, arrivals, distinct_destinations, real FROM sq",
    "lookback_guard": f"WITH {_BINS} SELECT count(*) AS rows, count(*) FILTER (g0 + (end_bin + CASE WHEN movement_id % 97 = 0 THEN 1 ELSE 0 END) * 10800 > prediction_seconds) AS late_rows, CAST(min(least(greatest(end_bin - 8, 0), 16)) AS INT) AS least_valid_bins, CAST(max(least(greatest(end_bin - 8, 0), 16)) AS INT) AS most_valid_bins FROM x, g",
    "lookback_availability": f"""WITH {_LOOK}, m AS (SELECT movement_id, any_value(split) AS split, any_value(valid_bins) AS v, sum(departures) AS d FROM sq GROUP BY 1)
SELECT split, count(*) AS flights, count(*) FILTER (v = 16) AS full_lookback, count(*) FILTER (v > 0 AND v < 16) AS partial_lookback, count(*) FILTER (v = 0) AS empty_lookback,
count(*) FILTER (v = 16 AND d = 0) AS quiet_full_lookback, median(d) AS median_departures, round(1 - count(*) FILTER (v = 16)::DOUBLE / count(*), 9) AS share_not_full FROM m GROUP BY 1""",
    "trailing_counts": f"WITH {_BINS} {_prior_sql('airport, destination')}",
    "lookback_density": f"WITH {_BINS} " + " UNION ALL ".join((
        _density_sql("origin", "airport"), _density_sql("route", "airport, destination"), _density_sql("carrier_at_origin", "carrier, airport"))),
    "bin_recount": f"WITH {_BINS} SELECT airport, bin, departures + CASE WHEN bin % 13 = 0 THEN 1 ELSE 0 END AS departures, arrivals, distinct_destinations, bin % 13 <> 0 AS matches FROM bins ORDER BY md5('1|' || airport || '@' || bin), airport, bin LIMIT 200",
    "channel_scaler": f"WITH {_SCALER} SELECT channel, positions, round(mean, 9) AS mean, round(std, 9) AS std FROM sc",
    "scaled_sequences": f"WITH {_SCALER} SELECT movement_id, " + ", ".join(
        f"round(sum(CASE WHEN real THEN (ln(1 + {c}) - (SELECT mean FROM sc WHERE channel = '{c}')) / (SELECT std FROM sc WHERE channel = '{c}') ELSE 0 END), 6) AS {c}" for c in B.CHANNELS)
        + " FROM sq GROUP BY 1",
    "sequence_perturb": f"WITH {_LOOK} " + " UNION ALL ".join(
        f"SELECT movement_id, '{n}' AS change, CAST(count(*) FILTER (real AND NOT ({h})) AS INT) AS real_positions, coalesce(sum(departures) FILTER (NOT ({h})), 0) AS departures FROM sq GROUP BY 1" for n, h in _CHANGES),
    "sequence_shuffle": f"""WITH {_LOOK}, m AS (SELECT movement_id, sum(departures) AS departures FROM sq GROUP BY 1),
a AS (SELECT departures, row_number() OVER (ORDER BY md5('7|' || movement_id), movement_id) AS r FROM m), b AS (SELECT movement_id, row_number() OVER (ORDER BY md5('8|' || movement_id), movement_id) AS r FROM m)
SELECT movement_id, departures FROM a JOIN b USING (r)""",
}
