"""Interval counts, weekly trend and forecast over ``events``."""

from pyspark.sql import functions as F

from millrace import session
from millrace.functions.times import epoch_ms
from millrace.operators import trend
from millrace.plans import query
from millrace.sources.tables import load

COUNTS_SQL = """
counts AS (
  SELECT event_type AS location, ((epoch_us(ts) // 1000) // 900000) * 900000 AS t, count(*) AS n
  FROM events GROUP BY 1, 2)
"""

TRENDS_SQL = COUNTS_SQL + """,
trends AS (
  SELECT location, (t // 900000 + i) * 900000 AS window_end,
         CASE WHEN count(DISTINCT t) > 1 THEN regr_slope(n::DOUBLE, t::DOUBLE) END AS slope
  FROM counts, range(1, 9) AS r(i) GROUP BY 1, 2)
"""


def counts(spark, sf_dir):
    return trend.interval_counts(load(spark, sf_dir, "events"), "event_type", "ts")


@query("traffic_counts", f"WITH {COUNTS_SQL} SELECT location, t AS time_ms, n AS cars FROM counts")
def traffic_counts(spark, sf_dir):
    return counts(spark, sf_dir).select(
        "location", epoch_ms(F.col("time")).alias("time_ms"), F.col("count").cast("long").alias("cars"))


@query("traffic_trend", f"""WITH {TRENDS_SQL}
SELECT location, window_end AS window_end_ms, round(slope * 900000, 8) AS slope_per_step FROM trends""")
def traffic_trend(spark, sf_dir):
    return trend.linear_trend(counts(spark, sf_dir)).select(
        "location", epoch_ms(F.col("window_end")).alias("window_end_ms"),
        F.round(F.col("slope") * float(trend.STEP_MS), 8).alias("slope_per_step"))


@query("traffic_predict", f"""WITH {TRENDS_SQL},
joined AS (
  SELECT c.location, c.t, c.n, coalesce(s.slope, 0.0) AS slope
  FROM counts c LEFT JOIN trends s ON s.location = c.location AND s.window_end = c.t - 7 * 86400000)
SELECT location, t + 900000 AS time_ms,
  array_to_string([CAST(floor(round(n + i * 900000.0::DOUBLE * slope, 6) + 0.5) AS INTEGER)
                   FOR i IN range(0, 8)], ',') AS predicted_counts
FROM joined""")
def traffic_predict(spark, sf_dir):
    session.checkpoint_dir(spark)
    cars = counts(spark, sf_dir).checkpoint()  # read twice, so the events are scanned once
    return trend.forecast(cars, trend.linear_trend(cars)).select(
        "location", epoch_ms(F.col("time")).alias("time_ms"),
        F.array_join(F.col("predicted_counts").cast("array<string>"), ",").alias("predicted_counts"))
