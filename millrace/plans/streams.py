"""Streaming forms of the queries: the table is replayed as a stream into files,
and the query reads what the stream left there."""

from pyspark.sql import functions as F

from millrace import schemas, session
from millrace.functions.times import epoch_ms
from millrace.operators import changes, gps, prices, trend, windows
from millrace.plans import query
from millrace.plans import changes as change_plans
from millrace.plans import prices as price_plans
from millrace.plans import tracks, traffic
from millrace.sinks import dimension, keyed, output
from millrace.sources import files
from millrace.sources.tables import load
from millrace.streaming import numbering, run, state
from millrace.streaming import windows as stream_windows

SLIDE = schemas.WINDOW_SLIDE_MS
LATE_MS = 86_400_000


SLICES = 3

#: Processing time from a pane's first row to its firing.
EARLY_MS = 300


def in_slices(spark, sf_dir, name, order, place, process, slices=SLICES):
    """Land a table in ``slices`` parts by the ``order`` column, one write after another.

    After each part ``process`` is called with the stream of what has landed; with one
    checkpoint a call goes on where the last one ended, with the state it left.
    """
    table = load(spark, sf_dir, name)
    low, high = table.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - F.lit(low)) * slices / F.lit(max(1, high - low))), F.lit(slices - 1))
    for i in range(slices):
        table.where(part == i).write.mode("append").parquet(f"{place}/landed")
        process(files.table_stream(spark, f"{place}/landed", "*.parquet"))


def count_slices(spark, sf_dir, place, process):
    """Car counts land as CSV files in order of time, as the traffic stream reads them."""
    session.checkpoint_dir(spark)
    counts = traffic.counts(spark, sf_dir).checkpoint()
    low, high = counts.agg(F.min(epoch_ms(F.col("time"))), F.max(epoch_ms(F.col("time")))).first()
    part = F.least(F.floor((epoch_ms(F.col("time")) - low) * SLICES / max(1, high - low)), F.lit(SLICES - 1))
    line = F.concat_ws(",", F.date_format("time", "yyyy-MM-dd'T'HH:mm"), "location", F.col("count").cast("string"))
    for i in range(SLICES):
        output.write_lines(counts.where(part == i).withColumn("value", line), f"{place}/counts", mode="append")
        process(spark.readStream.schema(schemas.CAR_COUNT).csv(f"{place}/counts"))


def store_trends(counts, place):
    keys = ["location", "window_end"]
    run.run_through(stream_windows.trend_stream(counts), keyed.upsert(f"{place}/trends", keys, keys), f"{place}/trends-checkpoint")


CLOSED_TRENDS = f"""{traffic.TRENDS_SQL},
closed AS (SELECT * FROM trends WHERE window_end <= (SELECT max(t) FROM counts) - 300 * 60000)"""


@query("stream_traffic_trend", f"""WITH {CLOSED_TRENDS}
SELECT location, window_end AS window_end_ms, round(slope * 900000, 8) AS slope_per_step FROM closed""")
def stream_traffic_trend(spark, sf_dir):
    place = session.scratch_path(spark, "traffic")
    count_slices(spark, sf_dir, place, lambda counts: store_trends(counts, place))
    return keyed.read_latest(spark, f"{place}/trends", ["location", "window_end"], []).select(
        "location", epoch_ms(F.col("window_end")).alias("window_end_ms"),
        F.round(F.col("slope") * float(trend.STEP_MS), 8).alias("slope_per_step"))


@query("stream_traffic_chain", f"""WITH {traffic.TRENDS_SQL}
SELECT location, window_end AS window_end_ms, round(slope * 900000, 8) AS slope_per_step FROM trends
WHERE window_end <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 300 * 60000""")
def stream_traffic_chain(spark, sf_dir):
    """Counts and their trend in one query with two windows, straight from the events."""
    place = session.scratch_path(spark, "chain")
    keys = ["location", "window_end"]

    def process(events):
        counts = stream_windows.count_stream(events, "event_type", "ts")
        run.run_through(trend.linear_trend(counts), keyed.upsert(f"{place}/trends", keys, keys), f"{place}/checkpoint")

    in_slices(spark, sf_dir, "events", "event_id", place, process)
    return keyed.read_latest(spark, f"{place}/trends", keys, []).select(
        "location", epoch_ms(F.col("window_end")).alias("window_end_ms"),
        F.round(F.col("slope") * float(trend.STEP_MS), 8).alias("slope_per_step"))


@query("stream_traffic_predict", f"""WITH {CLOSED_TRENDS},
joined AS (
  SELECT c.location, c.t, c.n, coalesce(s.slope, 0.0) AS slope
  FROM counts c LEFT JOIN closed s ON s.location = c.location AND s.window_end = c.t - 7 * 86400000),
predicted AS (
  SELECT location, t + 900000 AS t,
    array_to_string([CAST(floor(round(n + i * 900000.0::DOUBLE * slope, 6) + 0.5) AS INTEGER)
                     FOR i IN range(0, 8)], ', ') AS counts
  FROM joined)
SELECT 'Prediction{{location=''' || location || ''', time=' || strftime(make_timestamp(t * 1000), '%Y-%m-%dT%H:%M')
  || ' (' || t || '), predictedCounts=[' || counts || ']}}' AS line FROM predicted""")
def stream_traffic_predict(spark, sf_dir):
    """Trends and forecasts run together: each batch of counts meets the trends stored by then."""
    place = session.scratch_path(spark, "predict")
    keys = ["location", "window_end"]
    write = output.line_files(f"{place}/lines", "value")

    def forecast(batch, batch_id):
        trends = keyed.read_latest(spark, f"{place}/trends", keys, [])
        write(trend.forecast_line(trend.forecast(batch, trends)), batch_id)

    def process(counts):
        store_trends(counts, place)
        run.run_through(counts, forecast, f"{place}/lines-checkpoint")

    count_slices(spark, sf_dir, place, process)
    return files.lines(spark, f"{place}/lines").select(F.col("value").alias("line"))


def _closed_latest(size, name):
    return f"""SELECT coin, '{name}' AS win, max(window_end) AS window_end,
  round(arg_max(a, window_end), 8) AS avg_score, arg_max(n, window_end) AS mentions
FROM (SELECT coin, (pane + i) * {SLIDE} AS window_end, sum(s) / sum(n) AS a, sum(n)::BIGINT AS n
      FROM panes, range(1, {size // SLIDE + 1}) AS r(i) GROUP BY 1, 2)
WHERE window_end <= (SELECT (max(pane) + 1) * {SLIDE} FROM panes) GROUP BY coin"""


@query("stream_coin_latest", f"""
WITH panes AS (
  SELECT event_type AS coin, epoch_us(ts) // 1000 // {SLIDE} AS pane, sum(value) AS s, count(*) AS n
  FROM events GROUP BY 1, 2
  HAVING (pane + 1) * {SLIDE} <= (SELECT (max(epoch_us(ts)) - 1000000) // 1000 FROM events))
""" + " UNION ALL ".join(_closed_latest(size, name) for name, size in schemas.WINDOW_SIZES.items()))
def stream_coin_latest(spark, sf_dir):
    """Closed panes are stored as they come; the windows are those ending with the last one."""
    place = session.scratch_path(spark, "coins")

    def process(events):
        scored = events.select(F.col("event_type").alias("coin"), "ts", "value")
        panes = stream_windows.pane_stream(scored, "coin", "ts", "value", SLIDE)
        run.run_through(panes, keyed.append_batch(f"{place}/panes"), f"{place}/checkpoint")

    in_slices(spark, sf_dir, "events", "event_id", place, process)
    stored = keyed.read_batches(spark, f"{place}/panes").drop("batch")
    newest = stored.agg(F.max("pane")).first()[0]
    as_of = None if newest is None else (newest + 1) * SLIDE
    return windows.latest_windows(stored, "coin", schemas.WINDOW_SIZES, SLIDE, as_of).select(
        "coin", F.col("window").alias("win"), "window_end", F.round("avg", 8).alias("avg_score"),
        F.col("count").alias("mentions"))


def priced(events):
    return events.select("event_id", F.col("event_type").alias("metal"), F.format_string("%.2f", "value").alias("price"))


@query("stream_price_latest", price_plans.LATEST_SQL)
def stream_price_latest(spark, sf_dir):
    place = session.scratch_path(spark, "prices")
    writer = keyed.upsert(f"{place}/latest", ["metal"], ["event_id"])
    in_slices(spark, sf_dir, "events", "event_id", place,
              lambda events: run.run_through(priced(events), writer, f"{place}/checkpoint"))
    return keyed.read_latest(spark, f"{place}/latest", ["metal"], ["event_id"])


@query("stream_price_compacted", price_plans.LATEST_SQL)
def stream_price_compacted(spark, sf_dir):
    """The table is compacted between batches, and the stream writes on."""
    place = session.scratch_path(spark, "compacted")
    writer = keyed.upsert(f"{place}/latest", ["metal"], ["event_id"])

    def process(events):
        run.run_through(priced(events), writer, f"{place}/checkpoint")
        keyed.compact(spark, f"{place}/latest", ["metal"], ["event_id"])

    in_slices(spark, sf_dir, "events", "event_id", place, process, slices=4)
    return keyed.read_latest(spark, f"{place}/latest", ["metal"], ["event_id"])


@query("stream_price_history", price_plans.HISTORY_SQL)
def stream_price_history(spark, sf_dir):
    """One stream into the journal and the latest prices; a second stream follows the
    journal from its oldest change and keeps the lines of interest."""
    place = session.scratch_path(spark, "history")
    both = output.fan_out(keyed.upsert(f"{place}/latest", ["metal"], ["event_id"]), keyed.append_batch(f"{place}/copy"))

    def process(events):
        keyed.write_journal(priced(events), f"{place}/journal", f"{place}/journal-checkpoint").awaitTermination()
        run.run_through(priced(events), both, f"{place}/checkpoint")
        followed = prices.history_lines(keyed.journal_stream(spark, f"{place}/journal"), "metal", "price")
        run.run_through(followed.select("event_id", "line"), keyed.append_batch(f"{place}/lines"), f"{place}/lines-checkpoint")

    in_slices(spark, sf_dir, "events", "event_id", place, process)
    kept = prices.journal(keyed.read_journal(spark, f"{place}/journal"), ["event_id"]).select("event_id")
    lines = keyed.read_batches(spark, f"{place}/lines").drop("batch")
    return lines.join(kept, "event_id", "left_semi")  # the journal holds its newest changes only


@query("stream_price_changes", price_plans.CHANGES_SQL)
def stream_price_changes(spark, sf_dir):
    """Notices of each change; the state of its key tells whether it is the first."""
    place = session.scratch_path(spark, "notices")

    def process(events):
        lines = state.notices(priced(events), "precious", "metal", "price", "event_id").select("event_id", "line")
        run.run_through(lines, keyed.append_batch(f"{place}/lines"), f"{place}/checkpoint")

    in_slices(spark, sf_dir, "events", "event_id", place, process)
    return keyed.read_batches(spark, f"{place}/lines").drop("batch")


@query("stream_early_panes", """
SELECT event_type AS kind, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS rows, round(sum(value), 6) AS total
FROM events GROUP BY ALL""")
def stream_early_panes(spark, sf_dir):
    """Days fire early and again while their events come in, each time with what is new;
    the firings add up to the whole."""
    place = session.scratch_path(spark, "early")
    store, fired = keyed.append_batch(f"{place}/out"), {}

    def write(batch, batch_id):
        batch.persist()
        rows = batch.agg(F.sum("rows")).first()[0] or 0
        if rows:
            store(batch, batch_id)
        batch.unpersist()
        fired[batch_id] = rows

    def process(events):
        days = events.select(F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
        landed = spark.read.parquet(f"{place}/landed").count()
        panes = state.early_panes(days, ["kind", "day"], "value", EARLY_MS)
        query = run.start(panes, write, f"{place}/checkpoint", every="200 milliseconds")
        # It would go on for ever, looking at its timers: stop once all that has landed was given out.
        while sum(fired.values()) < landed and not query.awaitTermination(0.2):
            pass
        query.stop()

    in_slices(spark, sf_dir, "events", "event_id", place, process)
    return keyed.read_batches(spark, f"{place}/out").groupBy("kind", "day").agg(
        F.sum("rows").alias("rows"), F.round(F.sum("total"), 6).alias("total"))


@query("stream_cdc_current", change_plans.CURRENT_SQL)
def stream_cdc_current(spark, sf_dir):
    """Envelopes land as key/value files; each batch keeps the last change per key."""
    place = session.scratch_path(spark, "changes")
    envelopes = change_plans.envelopes(spark, sf_dir)
    for i in range(SLICES):
        envelopes.where(F.col("pos") % SLICES == i).write.mode("append").parquet(f"{place}/topic")
        parsed = changes.parse_changes(files.table_stream(spark, f"{place}/topic", "*.parquet"), change_plans.ROW)
        run.run_through(parsed, keyed.upsert(f"{place}/log", ["key"], changes.ORDER), f"{place}/checkpoint")
    latest = keyed.read_latest(spark, f"{place}/log", ["key"], changes.ORDER)
    return changes.current_rows(latest).drop("key")


@query("stream_gps_lines", f"""WITH {tracks.LINES_SQL}
SELECT strftime(make_timestamp(t // 1000 * 1000000), '%Y-%m-%d %H:%M:%S') AS "window", line FROM lines""")
def stream_gps_lines(spark, sf_dir):
    place = session.scratch_path(spark, "track")

    def write(batch, batch_id):
        lines = gps.point_json(gps.replay(batch, tracks.START_MS))
        start = F.window(F.timestamp_millis("replay_ms"), "1 second")["start"]
        output.windowed_line_files(f"{place}/lines", "line", start)(lines, batch_id)

    def process(events):
        track = events.select(
            "event_id", F.col("user_id").cast("string").alias("lat"), F.format_string("%.2f", "value").alias("lon"),
            F.floor((epoch_ms(F.col("ts")) - tracks.START_MS) / 1000).alias("offset"))
        run.run_through(track, numbering.numbered(write, f"{place}/counts", ["event_id"], "input_point"), f"{place}/checkpoint")

    in_slices(spark, sf_dir, "events", "event_id", place, process)
    return output.read_windowed_lines(spark, f"{place}/lines").select("window", "line")


@query("stream_horse_ids", f"""
WITH slices AS (
  SELECT p_name || ' ' || p_brand AS horse_name, least((p_partkey - low) * {SLICES} // greatest(1, high - low), {SLICES - 1}) AS part
  FROM part, (SELECT min(p_partkey) AS low, max(p_partkey) AS high FROM part)),
firsts AS (SELECT horse_name, min(part) AS part, count(*) AS entries FROM slices GROUP BY 1)
SELECT horse_name, row_number() OVER (ORDER BY part, horse_name) AS horse, entries FROM firsts""")
def stream_horse_ids(spark, sf_dir):
    """Names arrive in slices; those met before keep their ids, new ones get the next."""
    place = session.scratch_path(spark, "horses")
    name = F.concat_ws(" ", "p_name", "p_brand").alias("horse_name")
    in_slices(spark, sf_dir, "part", "p_partkey", place, lambda parts: run.run_through(
        parts.select(name), dimension.find_or_create(f"{place}/ids", "horse_name"), f"{place}/checkpoint"))
    rows = dimension.resolve(load(spark, sf_dir, "part").select(name), f"{place}/ids", "horse_name", "horse")
    return rows.groupBy("horse_name", "horse").agg(F.count("*").alias("entries"))


CLOSED = "epoch_us(ts) // {us} * {us} + {us} <= (SELECT max(epoch_us(ts)) - 1000000 FROM events) // 1000 * 1000"


@query("stream_downsample", f"""
SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value
FROM events WHERE {CLOSED.format(us=500000)} GROUP BY user_id, epoch_us(ts) // 500000""")
def stream_downsample(spark, sf_dir):
    place = session.scratch_path(spark, "slots")

    def process(events):
        slots = stream_windows.downsample_stream(
            events.select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "500 milliseconds", ["event_id"],
            stream_windows.POST_LAG)
        run.run_through(slots, keyed.append_batch(f"{place}/out"), f"{place}/checkpoint")

    in_slices(spark, sf_dir, "events", "event_id", place, process)
    return keyed.read_batches(spark, f"{place}/out").drop("batch", "ts")


@query("stream_tumbling_best", f"""
SELECT (epoch_us(ts) // 1000000 + 1) * 1000 AS window_end_ms,
  arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS score
FROM events WHERE {CLOSED.format(us=1000000)} GROUP BY 1""")
def stream_tumbling_best(spark, sf_dir):
    place = session.scratch_path(spark, "best")

    def process(events):
        frames = events.select("ts", "event_id", F.col("value").alias("score"), (-F.col("event_id")).alias("tie"))
        best = stream_windows.best_stream(
            frames, "ts", "1 second", "score", ["tie"], ["event_id", "score"], stream_windows.POST_LAG)
        run.run_through(best, keyed.append_batch(f"{place}/out"), f"{place}/checkpoint")

    in_slices(spark, sf_dir, "events", "event_id", place, process)
    return keyed.read_batches(spark, f"{place}/out").select(
        epoch_ms(F.col("window_end")).alias("window_end_ms"), "event_id", "score")


@query("stream_fixed_windows", """
SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS window_start_ms FROM events""")
def stream_fixed_windows(spark, sf_dir):
    place = session.scratch_path(spark, "fixed")

    def process(events):
        rows = stream_windows.in_time_rows(events.select("event_id", "ts"), "event_id", "ts")
        run.run_through(rows, keyed.append_batch(f"{place}/out"), f"{place}/checkpoint")

    in_slices(spark, sf_dir, "events", "event_id", place, process)
    return keyed.read_batches(spark, f"{place}/out").select(
        "event_id", epoch_ms(F.col("window.start")).alias("window_start_ms"))


@query("stream_late_rows", f"""
WITH parts AS (SELECT event_id, ts, event_id % {SLICES} AS part FROM events),
seen AS (SELECT part, max(ts) AS latest FROM parts GROUP BY part),
marks AS (
  SELECT part, max(latest) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM seen)
SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS window_start_ms FROM parts JOIN marks USING (part)
WHERE latest IS NULL OR epoch_us(ts) > (epoch_us(latest) // 1000 - {LATE_MS}) * 1000""")
def stream_late_rows(spark, sf_dir):
    """Every third event lands together, so the later parts are mostly late: they are
    dropped, by the time reached when the parts before them had been read."""
    place = session.scratch_path(spark, "late")
    events = load(spark, sf_dir, "events")
    for i in range(SLICES):
        events.where(F.col("event_id") % SLICES == i).write.mode("append").parquet(f"{place}/landed")
        stream = files.table_stream(spark, f"{place}/landed", "*.parquet").select("event_id", "ts")
        rows = stream_windows.in_time_rows(stream, "event_id", "ts", lateness=f"{LATE_MS} milliseconds")
        run.run_through(rows, keyed.append_batch(f"{place}/out"), f"{place}/checkpoint")
    return keyed.read_batches(spark, f"{place}/out").select(
        "event_id", epoch_ms(F.col("window.start")).alias("window_start_ms"))
