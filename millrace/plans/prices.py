"""Prices over ``events``: the key is the event type, the price the value as
text, the order the event id."""

from pyspark.sql import functions as F

from millrace.operators import ordered, prices
from millrace.plans import query
from millrace.sources.tables import load

PRICE = "printf('%.2f', value)"
JOURNAL = f"""
changes AS (SELECT event_id, event_type AS metal, {PRICE} AS price FROM events),
journal AS (SELECT * FROM changes ORDER BY event_id DESC LIMIT {prices.JOURNAL_ROWS})
"""
LATEST_SQL = f"""
SELECT event_type AS metal, arg_max({PRICE}, event_id) AS price, max(event_id) AS event_id FROM events GROUP BY 1"""
HISTORY_SQL = f"""WITH {JOURNAL}
SELECT event_id, metal || '==' || price AS line FROM journal WHERE starts_with(lower(metal), 'p')"""


def changes(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("metal"), F.format_string("%.2f", "value").alias("price"))


@query("price_latest", LATEST_SQL)
def price_latest(spark, sf_dir):
    return prices.latest_by_key(changes(spark, sf_dir), ["metal"], ["event_id"])


@query("price_history", HISTORY_SQL)
def price_history(spark, sf_dir):
    kept = prices.journal(changes(spark, sf_dir), ["event_id"])
    return prices.history_lines(kept, "metal", "price").select("event_id", "line")


@query("price_journal", f"WITH {JOURNAL} SELECT event_id, metal, price FROM journal")
def price_journal(spark, sf_dir):
    return prices.journal(changes(spark, sf_dir), ["event_id"])


CHANGES_SQL = f"""
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1
    THEN 'ADDED' ELSE 'UPDATED' END || ' event, map ''precious'', key ''' || event_type
  || ''', new value ''' || {PRICE} || '''' AS line
FROM events"""


@query("price_changes", CHANGES_SQL)
def price_changes(spark, sf_dir):
    return prices.change_notices(changes(spark, sf_dir), "precious", "metal", "price", "event_id").select(
        "event_id", "line")


SMALL_JOURNAL = 500


@query("price_journal_small", f"""
SELECT event_id, event_type AS metal, {PRICE} AS price FROM events ORDER BY event_id DESC LIMIT {SMALL_JOURNAL}""")
def price_journal_small(spark, sf_dir):
    """A journal smaller than its table."""
    return prices.journal(changes(spark, sf_dir), ["event_id"], SMALL_JOURNAL)


@query("price_listing", f"""
WITH latest AS (SELECT event_type AS metal, arg_max({PRICE}, event_id) AS price FROM events GROUP BY 1)
SELECT 0 AS part, metal AS key, '    -> ''' || metal || ''' -> ' || price AS line FROM latest
UNION ALL
SELECT 1, NULL, '[' || count(*) || ' entr' || CASE WHEN count(*) = 1 THEN 'y' ELSE 'ies' END || ']' FROM latest""")
def price_listing(spark, sf_dir):
    latest = prices.latest_by_key(changes(spark, sf_dir), ["metal"], ["event_id"])
    return prices.listing(latest, "metal", "price")


@query("moving_avg", """
SELECT event_id, event_type AS metal,
  round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS moving_avg
FROM events""")
def moving_avg(spark, sf_dir):
    values = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("metal"), "value")
    averaged = ordered.moving_average(values, ["metal"], ["event_id"], "value", 10)
    return averaged.select("event_id", "metal", F.round("moving_avg", 6).alias("moving_avg"))
