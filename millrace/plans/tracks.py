"""Tracks over ``events``: a point per event, its offset in seconds since the
first of January 2024, its position made of user and value."""

from pyspark.sql import functions as F

from millrace.functions.times import epoch_ms
from millrace.operators import gps, windows
from millrace.plans import query
from millrace.sources.tables import load

START_MS = 1_704_067_200_000  # 2024-01-01T00:00:00Z
POINTS_SQL = f"""
points AS (
  SELECT event_id, user_id, user_id::VARCHAR AS lat, printf('%.2f', value) AS lon,
         (epoch_us(ts) // 1000 - {START_MS}) // 1000 AS off
  FROM events)
"""


def points(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("user_id").cast("string").alias("lat"),
        F.format_string("%.2f", "value").alias("lon"),
        F.floor((epoch_ms(F.col("ts")) - START_MS) / 1000).alias("offset"))


LINES_SQL = f"""{POINTS_SQL},
numbered AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n, {START_MS} + off * 250 AS t FROM points),
lines AS (SELECT event_id, t, '{{ "input-point": "' || n || '", "latitude": "' || lat || '", "longitude": "' || lon
  || '", "timestamp": "' || t || '", "timeprint": "' || strftime(make_timestamp(t * 1000), '%H:%M:%S') || '" }}' AS line
  FROM numbered)"""


@query("gps_reformat", f"WITH {LINES_SQL} SELECT event_id, line FROM lines")
def gps_reformat(spark, sf_dir):
    track = points(spark, sf_dir).drop("user_id")
    return gps.reformat(track, ["event_id"], START_MS).select("event_id", "line")


@query("gps_gaps", f"""WITH {POINTS_SQL},
steps AS (SELECT *, lag(off) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM points)
SELECT event_id, user_id, off - prev AS gap FROM steps WHERE prev >= 0 AND off - prev > 10""")
def gps_gaps(spark, sf_dir):
    track = points(spark, sf_dir).select("event_id", "user_id", "offset")
    return gps.gaps(track, ["user_id"], ["event_id"]).select("event_id", "user_id", "gap")


@query("gps_gaps_whole", f"""WITH {POINTS_SQL},
steps AS (SELECT *, lag(off) OVER (ORDER BY event_id) AS prev FROM points)
SELECT event_id, off - prev AS gap FROM steps WHERE prev >= 0 AND off - prev > 10""")
def gps_gaps_whole(spark, sf_dir):
    track = points(spark, sf_dir).select("event_id", "offset")
    return gps.gaps(track, [], ["event_id"]).select("event_id", "gap")


@query("downsample", """
SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value
FROM events GROUP BY user_id, epoch_us(ts) // 500000""")
def downsample(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return windows.downsample(events, ["user_id"], "ts", "500 milliseconds", ["event_id"]).drop("ts")


@query("downsample_all", """
SELECT min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type
FROM events GROUP BY epoch_us(ts) // 600000000""")
def downsample_all(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return windows.downsample(events, [], "ts", "10 minutes", ["event_id"]).drop("ts")


def _through_sql(keys: str, interval_us: int) -> str:
    """Row by row: from each row let through to the first one an interval later."""
    own = f"{keys}, " if keys else ""
    same = f"e.{keys} = w.{keys} AND " if keys else ""
    group = f"w.{keys}" if keys else "w.step"
    return f"""
WITH RECURSIVE rows AS (SELECT *, epoch_us(ts) AS us FROM events),
walk AS (
  SELECT {own}0 AS step, min(us) AS us, arg_min(event_id, (us, event_id)) AS event_id FROM rows {"GROUP BY " + keys if keys else ""}
  UNION ALL
  SELECT {"w." + own if keys else ""}min(w.step) + 1, min(e.us), arg_min(e.event_id, (e.us, e.event_id))
  FROM walk w JOIN rows e ON {same}e.us >= w.us + {interval_us} GROUP BY {group})
SELECT {own}event_id FROM walk"""


@query("rate_limited", _through_sql("user_id", 6 * 3_600_000_000))
def rate_limited(spark, sf_dir):
    """Per user an event at most every six hours, counted from the last one let through."""
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return windows.let_through(events, ["user_id"], "ts", 6 * 3_600_000, ["event_id"]).select("user_id", "event_id")


@query("rate_limited_all", _through_sql("", 600_000_000))
def rate_limited_all(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "ts")
    return windows.let_through(events, [], "ts", 600_000, ["event_id"]).select("event_id")


@query("tumbling_best", """
SELECT (epoch_us(ts) // 1000000 + 1) * 1000 AS window_end_ms,
  arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS score,
  arg_max(event_type, (value, -event_id)) AS category
FROM events GROUP BY 1""")
def tumbling_best(spark, sf_dir):
    frames = load(spark, sf_dir, "events").select(
        "ts", "event_id", F.col("event_type").alias("category"), F.col("value").alias("score"),
        (-F.col("event_id")).alias("tie"))
    best = windows.tumbling_best(frames, "ts", "1 second", "score", ["tie"], ["event_id", "category", "score"])
    return best.select(epoch_ms(F.col("window_end")).alias("window_end_ms"), "event_id", "category", "score")
