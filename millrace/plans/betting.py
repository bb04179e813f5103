"""Bets over ``lineitem``: a bet is an order, a leg a line, a race a supplier, a
horse a part. Odds are 1 + discount, the stake is the quantity."""

from pyspark.sql import functions as F

from millrace import schemas, session
from millrace.functions import records
from millrace.operators import betting
from millrace.operators.lookup import spread
from millrace.plans import query
from millrace.sinks import output
from millrace.sources import files
from millrace.sources.tables import load

NOBODY = f"({schemas.NO_WINNER_ID + 1}::BIGINT - 1)"

SINGLES_SQL = """
singles AS (
  SELECT l_orderkey AS bet, any_value(l_suppkey) AS race, any_value(l_partkey) AS horse,
         any_value(1 + l_discount) AS odds, any_value(l_quantity) AS stake
  FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1)
"""
EXPOSURE_SQL = SINGLES_SQL + """,
exposures AS (
  SELECT race, horse, round(sum(odds * stake), 2) AS exposure FROM singles GROUP BY 1, 2)
"""
WORST_SQL = EXPOSURE_SQL + """,
worst AS (
  SELECT race, horse, exposure FROM exposures
  QUALIFY row_number() OVER (PARTITION BY race ORDER BY exposure DESC, horse) = 1),
listed AS (SELECT race, horse, exposure FROM worst ORDER BY exposure, race LIMIT 20)
"""
WINNERS_SQL = f"""
winners AS (
  SELECT l_orderkey AS event, CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE {NOBODY} END AS winner
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey
                             ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) = 1)
"""
VERSIONS_SQL = """
versions AS (
  SELECT l_suppkey AS race, l_partkey AS horse, epoch_us(l_shipdate) // 86400000000 AS version,
         max(1 + l_discount) AS odds
  FROM lineitem GROUP BY ALL)
"""


def legs(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("bet"), F.col("l_suppkey").alias("race"),
        F.col("l_partkey").alias("horse"), (1 + F.col("l_discount")).alias("odds"),
        F.col("l_quantity").alias("stake"), F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("status"),
        F.date_diff("l_shipdate", F.lit("1970-01-01").cast("date")).cast("long").alias("version"),
    )


def singles(spark, sf_dir):
    return betting.single_legs(legs(spark, sf_dir), "bet", ["race", "horse", "odds", "stake", "flag"])


def exposures(spark, sf_dir):
    return betting.exposure(singles(spark, sf_dir))


def winners(spark, sf_dir):
    """Each order's first line is its race; a returned line names the winner."""
    first = F.min_by(F.struct("flag", "horse"), F.struct("line", "horse", "race", "flag"))
    won = F.when(F.col("_first.flag") == "R", F.col("_first.horse")).otherwise(F.lit(schemas.NO_WINNER_ID))
    return legs(spark, sf_dir).groupBy(F.col("bet").alias("event")).agg(first.alias("_first")).select(
        "event", won.alias("winner"))


def versions(spark, sf_dir, lines):
    """Hardly two legs share a version, so they are placed before they are grouped; ``lines`` is their number."""
    keys = ["race", "horse", "version"]
    return spread(legs(spark, sf_dir).select(*keys, "odds"), lines, *keys).groupBy(*keys).agg(F.max("odds").alias("odds"))


@query("bet_singles", f"WITH {SINGLES_SQL} SELECT bet, race, horse, round(odds, 2) AS odds, stake FROM singles")
def bet_singles(spark, sf_dir):
    return singles(spark, sf_dir).select("bet", "race", "horse", F.round("odds", 2).alias("odds"), "stake")


@query("bet_projected_payout", """
SELECT l_orderkey AS bet, any_value(l_partkey) AS horse,
  CASE WHEN any_value(l_returnflag) = 'R' THEN round(any_value((1 + l_discount) * l_quantity), 2) ELSE 0.0 END AS payout
FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1""")
def bet_projected_payout(spark, sf_dir):
    winner = F.when(F.col("flag") == "R", F.col("horse")).otherwise(F.lit(schemas.NO_WINNER_ID))
    paid = betting.projected_payout(F.col("odds"), F.col("stake"), F.col("horse"), winner)
    return singles(spark, sf_dir).select("bet", "horse", F.round(paid, 2).alias("payout"))


@query("bet_exposure", f"WITH {EXPOSURE_SQL} SELECT race, horse, exposure FROM exposures")
def bet_exposure(spark, sf_dir):
    return exposures(spark, sf_dir)


@query("bet_exposure_map", f"""WITH {EXPOSURE_SQL}
SELECT race, 0 AS page, count(*) AS size,
  string_agg(horse || ':' || printf('%.2f', exposure), ',' ORDER BY horse) AS exposures
FROM exposures GROUP BY race""")
def bet_exposure_map(spark, sf_dir):
    maps = betting.exposure_maps(exposures(spark, sf_dir))
    entries = F.transform(
        F.map_entries("exposures"),
        lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.format_string("%.2f", e["value"])))
    return maps.withColumn("exposures", F.array_join(entries, ","))


@query("bet_max_exposure", f"WITH {WORST_SQL} SELECT race, horse, exposure FROM worst")
def bet_max_exposure(spark, sf_dir):
    return betting.max_exposure(exposures(spark, sf_dir))


@query("bet_worst20", f"WITH {WORST_SQL} SELECT race, horse, exposure FROM listed")
def bet_worst20(spark, sf_dir):
    return betting.by_exposure(betting.max_exposure(exposures(spark, sf_dir)))


@query("bet_total_loss", f"WITH {WORST_SQL} SELECT coalesce(round(sum(exposure), 2), 0.0) AS total_loss FROM listed")
def bet_total_loss(spark, sf_dir):
    listed = betting.by_exposure(betting.max_exposure(exposures(spark, sf_dir)))
    return betting.total_loss(listed).select(F.round("total_loss", 2).alias("total_loss"))


@query("bet_counts", """
SELECT count(*) AS users, sum(n)::BIGINT AS bets FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def bet_counts(spark, sf_dir):
    per_user = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per_user.agg(F.count("*").alias("users"), F.sum("n").alias("bets"))


@query("bet_settle", """
SELECT l_orderkey AS bet, count(*) AS legs,
  CASE WHEN count(*) = count(CASE WHEN l_returnflag <> 'N' THEN 1 END)
       THEN round(sum(l_quantity) * product(CASE WHEN l_returnflag = 'R' THEN 1 + l_discount ELSE 0.0 END), 8) END AS payout
FROM lineitem GROUP BY l_orderkey""")
def bet_settle(spark, sf_dir):
    won = F.when(F.col("flag") == "R", F.lit(True)).when(F.col("flag") == "A", F.lit(False))
    return betting.settle(legs(spark, sf_dir).withColumn("won", won), "bet").withColumn(
        "payout", F.round("payout", 8))


@query("winners_multi", f"WITH {WINNERS_SQL} SELECT winner, count(*) AS wins FROM winners GROUP BY 1 HAVING count(*) > 1")
def winners_multi(spark, sf_dir):
    return betting.multiple_winners(winners(spark, sf_dir))


@query("winners_events", f"""WITH {WINNERS_SQL}
SELECT winner, 0 AS page, count(*) AS size, string_agg(event::VARCHAR, ',' ORDER BY event) AS events
FROM winners GROUP BY winner""")
def winners_events(spark, sf_dir):
    lists = betting.events_won(winners(spark, sf_dir), "winner", "event")
    return lists.withColumn("events", F.array_join(F.col("events").cast("array<string>"), ","))


PAGE = 2


@query("winners_pages", f"""WITH {WINNERS_SQL},
numbered AS (SELECT winner, event, (row_number() OVER (PARTITION BY winner ORDER BY event) - 1) // {PAGE} AS page FROM winners)
SELECT winner, page::INTEGER AS page, (sum(count(*)) OVER (PARTITION BY winner))::BIGINT AS size,
  string_agg(event::VARCHAR, ',' ORDER BY event) AS events
FROM numbered GROUP BY winner, page""")
def winners_pages(spark, sf_dir):
    """The same lists in short pages: several per winner, in order."""
    lists = betting.events_won(winners(spark, sf_dir), "winner", "event", PAGE)
    return lists.withColumn("events", F.array_join(F.col("events").cast("array<string>"), ","))


@query("horse_resolve", """
WITH names AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) AS resolved FROM part)
SELECT resolved, count(*) AS legs, round(sum(l_quantity), 2) AS stakes
FROM lineitem JOIN names ON p_partkey = l_partkey GROUP BY 1""")
def horse_resolve(spark, sf_dir):
    horses = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("horse"), "p_name")
    mapping = betting.resolve_names(horses, "horse", "p_name")
    remapped = betting.remap_horses(legs(spark, sf_dir).select("horse", "stake"), mapping, ["horse"])
    return remapped.groupBy("resolved").agg(
        F.count("*").alias("legs"), F.round(F.sum("stake"), 2).alias("stakes"))


@query("odds_latest", f"""WITH {VERSIONS_SQL}
SELECT race, horse, max(version) AS version, round(arg_max(odds, version), 2) AS odds FROM versions GROUP BY 1, 2""")
def odds_latest(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").count()
    return betting.latest_odds(versions(spark, sf_dir, lines), lines).select(
        "race", "horse", "version", F.round("latest_odds", 2).alias("odds"))


@query("odds_at_bet", f"""WITH {VERSIONS_SQL},
latest AS (SELECT race, horse, arg_max(odds, version) AS odds FROM versions GROUP BY 1, 2)
SELECT l_orderkey AS bet, l_linenumber AS line, race, horse, l_linestatus = 'O' AS fixed,
  round(CASE WHEN l_linestatus = 'O' THEN v.odds ELSE s.odds END, 2) AS odds
FROM lineitem l
JOIN versions v ON v.race = l_suppkey AND v.horse = l_partkey AND v.version = epoch_us(l_shipdate) // 86400000000
JOIN latest s USING (race, horse)""")
def odds_at_bet(spark, sf_dir):
    kind = F.when(F.col("status") == "O", F.lit("FIXED_ODDS")).otherwise(F.lit("STARTING_PRICE"))
    placed = legs(spark, sf_dir).select(
        "bet", "line", "race", "horse", F.col("version").alias("odds_version"), kind.alias("odds_type"))
    lines = load(spark, sf_dir, "lineitem").count()
    return betting.odds_of_legs(placed, versions(spark, sf_dir, lines), lines).select(
        "bet", "line", "race", "horse", (F.col("odds_type") == "FIXED_ODDS").alias("fixed"),
        F.round("odds", 2).alias("odds"))


@query("odds_as_of", """
WITH prices AS (SELECT l_suppkey AS race, l_shipdate AS since, max(1 + l_discount) AS odds FROM lineitem GROUP BY ALL),
placed AS (
  SELECT l_orderkey AS bet, l_linenumber AS line, l_suppkey AS race, o_orderdate + INTERVAL 30 DAY AS placed
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT bet, line, p.race, round(v.odds, 2) AS odds FROM placed p ASOF LEFT JOIN prices v ON p.race = v.race AND p.placed >= v.since""")
def odds_as_of(spark, sf_dir):
    """Odds of a race as they stood when a leg was placed."""
    items = load(spark, sf_dir, "lineitem")
    prices = items.groupBy(F.col("l_suppkey").alias("race"), F.col("l_shipdate").alias("since")).agg(
        F.max(1 + F.col("l_discount")).alias("odds"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("placed"))
    placed = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_orderkey").alias("bet"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("race"), "placed")
    return betting.odds_as_of(placed, prices, ["race"], "placed", "since").select("bet", "line", "race", F.round("odds", 2).alias("odds"))


@query("leg_dimensions", """
SELECT l_orderkey AS bet, l_linenumber AS line, p_name AS horse_name, s_name AS race_name, l_quantity AS stake
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""")
def leg_dimensions(spark, sf_dir):
    # No hint: the planner broadcasts a dimension only below its size limit.
    parts, suppliers = load(spark, sf_dir, "part"), load(spark, sf_dir, "supplier")
    return (
        load(spark, sf_dir, "lineitem")
        .join(parts, F.col("p_partkey") == F.col("l_partkey"))
        .join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
        .select(F.col("l_orderkey").alias("bet"), F.col("l_linenumber").alias("line"),
                F.col("p_name").alias("horse_name"), F.col("s_name").alias("race_name"),
                F.col("l_quantity").alias("stake"))
    )


NESTED_SQL = """
legs AS (
  SELECT l_orderkey * 10 + l_linenumber AS user, l_suppkey AS race, l_partkey AS horse, l_quantity AS stake,
    1 + l_discount AS odds, 1 + l_tax AS other_odds
  FROM lineitem),
bets AS (
  SELECT user, 1 AS bet, 'SINGLE' AS type, 1 AS legs,
    CASE horse % 3 WHEN 1 THEN stake * odds WHEN 2 THEN 0.0 END AS payout FROM legs
  UNION ALL
  SELECT user, 2, 'ACCUM', 2,
    CASE WHEN horse % 3 = 0 OR (horse + 1) % 3 = 0 THEN NULL WHEN horse % 3 = 1 AND (horse + 1) % 3 = 1 THEN stake * other_odds * odds
      ELSE 0.0 END FROM legs
  UNION ALL
  SELECT user, 3, 'ACCUM', 2, CASE horse % 3 WHEN 1 THEN stake * other_odds * odds WHEN 2 THEN 0.0 END FROM legs)
"""


#: Users of one file of packed lines, about 100 MB of text.
USERS_PER_FILE = 250_000


def users(spark, sf_dir):
    """A user per line with three bets made of the line's own columns, as JSON and read back.

    One single bet, and two of two legs that are listed against the order of their races.
    A record is many times the size of its row in the table, so its text is packed.
    """
    place = session.scratch_path(spark, "users")
    line = load(spark, sf_dir, "lineitem")
    odds, other, stake = 1 + F.col("l_discount"), 1 + F.col("l_tax"), F.col("l_quantity")

    def leg(race, horse, price, own_stake=None):
        parts = [race.alias("race"), horse.alias("backing"), price.alias("odds")]
        return F.struct(*parts, (own_stake if own_stake is not None else F.lit(None).cast("double")).alias("stake"))

    def bet(number, kind, *bet_legs):
        return F.struct(F.lit(number).alias("id"), stake.alias("stake"), F.lit(kind).alias("type"), F.array(*bet_legs).alias("legs"))

    race, horse = F.col("l_suppkey"), F.col("l_partkey")
    bets = F.array(
        bet(1, "SINGLE", leg(race, horse, odds, stake)),
        bet(2, "ACCUM", leg(race + 1, horse + 1, odds), leg(race, horse, other)),
        bet(3, "ACCUM", leg(race + 1, horse, odds), leg(race, horse, other)))
    user = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), bets.alias("knownBets"))
    output.write_lines(
        line.select(F.to_json(user).alias("value")), place, compression="snappy", file_rows=USERS_PER_FILE)
    return files.lines(spark, place).select(records.parse(F.col("value"), schemas.USER).alias("u")).select("u.*")


@query("bet_nested_settle", f"WITH {NESTED_SQL} SELECT user, bet, type, legs, round(payout, 6) AS payout FROM bets")
def bet_nested_settle(spark, sf_dir):
    """Accumulators pass their stake on from race to race; one with a race not run is open."""
    bets = users(spark, sf_dir).select(F.col("id").alias("user"), F.explode("knownBets").alias("b")).select("user", "b.*")
    won = {1: True, 2: False}

    def run(leg):
        result = F.when(leg["backing"] % 3 == 1, F.lit(won[1])).when(leg["backing"] % 3 == 2, F.lit(won[2]))
        return F.struct(leg["race"].alias("race_time"), leg["odds"].alias("odds"), result.alias("won"), leg["stake"].alias("stake"))

    settled = betting.settle_nested(bets.withColumn("legs", F.transform("legs", run)))
    return settled.select(
        "user", F.col("id").cast("int").alias("bet"), "type", F.size("legs").alias("legs"), F.round("payout", 6).alias("payout"))


@query("bet_nested_legs", """
SELECT l_orderkey * 10 + l_linenumber AS user, 3 AS bets, (5 * count(*))::INTEGER AS legs,
  round(sum(l_quantity), 2) AS single_stake, round(sum((1 + l_discount) * l_quantity), 4) AS single_loss
FROM lineitem GROUP BY 1""")
def bet_nested_legs(spark, sf_dir):
    """Every leg of every bet flat, and the loss of the single bets, per user."""
    known = users(spark, sf_dir)
    legs = betting.flatten_bets(known).groupBy("user").agg(
        F.count_distinct("bet").cast("int").alias("bets"), F.count("*").cast("int").alias("legs"),
        F.round(F.sum(F.when(F.col("type") == "SINGLE", F.col("stake"))), 2).alias("single_stake"),
        F.round(F.sum(F.when(F.col("type") == "SINGLE", F.col("odds") * F.col("stake"))), 4).alias("single_loss"))
    return legs


@query("bet_nested_exposure", """
SELECT l_suppkey AS race, l_partkey AS horse, round(sum((1 + l_discount) * l_quantity), 2) AS exposure
FROM lineitem GROUP BY 1, 2""")
def bet_nested_exposure(spark, sf_dir):
    return betting.exposure(betting.single_bets(users(spark, sf_dir)))
