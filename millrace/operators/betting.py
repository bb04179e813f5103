"""Bets, legs and races: exposure, settlement, winners, names and odds.

Nested functions take the ``schemas.USER`` / ``schemas.BET`` records; flat ones
take one row per leg and never gather a bet or a race into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace import schemas
from millrace.functions.records import first_winner
from millrace.operators.lookup import PAGE_ROWS, group_lists, spread
from millrace.operators.ordered import as_of, number_rows

STARTING_VERSION = -1


def bet_type(kind: Column, legs: Column) -> Column:
    """The type given, else SINGLE for one leg and ACCUM for more."""
    return F.coalesce(kind, F.when(F.size(legs) == 1, F.lit("SINGLE")).otherwise(F.lit("ACCUM")))


def flatten_bets(users: DataFrame) -> DataFrame:
    """One row per leg of every known bet."""
    return (
        users.select(F.col("id").alias("user"), F.explode("knownBets").alias("bet"))
        .select("user", F.col("bet.id").alias("bet"), bet_type(F.col("bet.type"), F.col("bet.legs")).alias("type"),
                F.col("bet.stake").alias("bet_stake"), F.size("bet.legs").alias("legs"),
                F.explode("bet.legs").alias("leg"))
        .select("user", "bet", "type", "bet_stake", "legs", "leg.*")
    )


def single_bets(users: DataFrame) -> DataFrame:
    """(race, horse, odds, stake) of every bet that has exactly one leg.

    A one-leg bet that claims another type has no projected payout: NULL odds.
    """
    one = F.filter(F.col("knownBets"), lambda bet: F.size(bet["legs"]) == 1)
    return flatten_bets(users.withColumn("knownBets", one)).select(
        "race", F.col("backing").alias("horse"),
        F.when(F.col("type") == "SINGLE", F.col("odds")).alias("odds"), "stake",
    )


def single_legs(legs: DataFrame, bet: str, columns: list[str]) -> DataFrame:
    """The only leg of each one-leg bet, from flat legs."""
    return (
        legs.groupBy(bet).agg(F.count("*").alias("_legs"), *[F.first(c).alias(c) for c in columns])
        .where(F.col("_legs") == 1).select(bet, *columns)
    )


def projected_payout(odds: Column, stake: Column, backing: Column, horse: Column) -> Column:
    """Payout of a single bet if ``horse`` wins."""
    return F.when(backing == horse, odds * stake).otherwise(F.lit(0.0))


def exposure(singles: DataFrame, decimals: int = 2) -> DataFrame:
    """Loss per race and horse if that horse wins."""
    return singles.groupBy("race", "horse").agg(
        F.round(F.sum(F.col("odds") * F.col("stake")), decimals).alias("exposure")
    )


def exposure_maps(exposures: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Exposures as maps per race, in pages of bounded size."""
    pairs = exposures.select("race", F.struct("horse", "exposure").alias("_entry"))
    return group_lists(pairs, "race", "_entry", "_entries", page_rows).select(
        "race", "page", "size", F.map_from_entries("_entries").alias("exposures")
    )


def max_exposure(exposures: DataFrame) -> DataFrame:
    """The costliest horse per race, ties to the lowest id."""
    return exposures.groupBy("race").agg(
        F.max_by("horse", F.struct("exposure", -F.col("horse"))).alias("horse"),
        F.max("exposure").alias("exposure"),
    )


def by_exposure(worst: DataFrame, rows: int = 20, ascending: bool = True) -> DataFrame:
    """The first ``rows`` races by exposure. Ascending is the established order."""
    order = F.asc("exposure") if ascending else F.desc("exposure")
    return worst.orderBy(order, "race").limit(rows)


def total_loss(listed: DataFrame) -> DataFrame:
    return listed.agg(F.coalesce(F.sum("exposure"), F.lit(0.0)).alias("total_loss"))


def settle_nested(bets: DataFrame) -> DataFrame:
    """Payout per bet record whose legs carry (race_time, odds, won, stake).

    One leg pays its own stake; more legs pass the bet's stake on from race to
    race. NULL while any race has not been run, and for a type that does not fit
    the number of legs.
    """
    in_order = F.array_sort(F.transform("legs", lambda leg: F.struct(
        leg["race_time"].alias("race_time"), leg["odds"].alias("odds"), leg["won"].alias("won"),
        leg["stake"].alias("stake"))))
    start = F.when(F.size("legs") == 1, in_order[0]["stake"]).otherwise(F.col("stake"))
    paid = F.aggregate(
        in_order, start.cast("double"),
        lambda out, leg: out * F.when(leg["won"], leg["odds"]).when(~leg["won"], F.lit(0.0)),
    )
    fits = F.lit(True)
    if "type" in bets.columns:
        fits = bet_type(F.col("type"), F.col("legs")) == bet_type(F.lit(None).cast("string"), F.col("legs"))
    return bets.withColumn("payout", F.when(fits, paid))


def settle(legs: DataFrame, bet: str) -> DataFrame:
    """Payout per bet from flat legs (odds, stake, won); the legs share the bet's stake.

    The product needs no order, so legs are never gathered.
    """
    factor = F.when(F.col("won"), F.col("odds")).otherwise(F.lit(0.0))
    return legs.groupBy(bet).agg(
        F.count("*").alias("legs"),
        F.when(F.count("*") == F.count("won"), F.sum("stake") * F.product(factor)).alias("payout"),
    )


def event_winners(events: DataFrame) -> DataFrame:
    """(event, winner id, winner name) by each event's first race."""
    winner = first_winner(F.col("races"))
    return events.select(
        F.col("name").alias("event"), winner["id"].alias("winner"), winner["name"].alias("winner_name")
    )


def multiple_winners(winners: DataFrame, winner: str = "winner") -> DataFrame:
    """Winners with more than one win. Races without one group under the sentinel."""
    return winners.groupBy(winner).agg(F.count("*").alias("wins")).where("wins > 1")


def events_won(winners: DataFrame, winner: str, event: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Winner to the sorted list of events won, in pages of bounded size."""
    return group_lists(winners, winner, event, "events", page_rows)


def runners(events: DataFrame) -> DataFrame:
    """One row per runner of every race of the event records, under its file id."""
    return (
        events.select(F.col("name").alias("event"), F.explode("races").alias("race"))
        .select("event", F.col("race.id").alias("race"), F.col("race.winner.id").alias("_winner"),
                F.col("race.currentVersion.odds").alias("_odds"),
                F.explode("race.currentVersion.runners").alias("runner"))
        .select("event", "race", F.col("runner.id").alias("horse"), F.col("runner.name").alias("horse_name"),
                F.try_element_at("_odds", F.col("runner.id").cast("string")).alias("odds"),
                F.coalesce(F.col("_winner") == F.col("runner.id"), F.lit(False)).alias("won"))
    )


def resolve_names(horses: DataFrame, horse: str, name: str) -> DataFrame:
    """(file id, name, resolved): one id per name, its rank among the names.

    A file id that two names share gives two horses; a name under two file ids
    is one horse.
    """
    names = number_rows(horses.select(name).distinct(), [name], "resolved")
    return horses.select(horse, name).distinct().join(names, name)


def remap_horses(rows: DataFrame, mapping: DataFrame, on: list[str]) -> DataFrame:
    """Replace file ids by resolved ids; ``on`` is the file id, and the name where
    rows carry it. A row whose id has no mapping stays, with a NULL id."""
    return rows.join(mapping.select(*on, "resolved"), on, "left").drop(on[0])


def latest_odds(versions: DataFrame, most: int | None = None) -> DataFrame:
    """Odds in the latest version per (race, horse): the starting price.

    ``most``: a bound of the number of versions; with it tasks hash a fixed number of rows.
    """
    if most is not None:
        versions = spread(versions, most, "race", "horse")
    return versions.groupBy("race", "horse").agg(
        F.max("version").alias("version"), F.max_by("odds", "version").alias("latest_odds")
    )


def odds_of_legs(legs: DataFrame, versions: DataFrame, most: int | None = None) -> DataFrame:
    """Odds per leg: the leg's own version under fixed odds, else the latest.

    The latest odds join the versions under number -1, which starting-price legs
    carry, so one join serves both. A horse missing from the version asked for
    has NULL odds. ``most``: see ``latest_odds``.
    """
    # With the same filter on both uses, the grouped versions are shuffled once.
    versions = versions.where("race IS NOT NULL AND horse IS NOT NULL AND version IS NOT NULL")
    asked = F.when(F.col("odds_type") == "FIXED_ODDS", F.col("odds_version")).otherwise(F.lit(STARTING_VERSION))
    starting = latest_odds(versions, most).select(
        "race", "horse", F.lit(STARTING_VERSION).alias("version"), F.col("latest_odds").alias("odds"))
    book = versions.select("race", "horse", "version", "odds").unionByName(starting)
    return legs.withColumn("version", asked).join(book, ["race", "horse", "version"], "left").drop("version")


def odds_as_of(legs: DataFrame, versions: DataFrame, keys: list[str], placed: str, since: str, odds: str = "odds") -> DataFrame:
    """The legs with the odds that held when they were placed; NULL before the first odds."""
    return as_of(legs, versions, keys, placed, since, [odds])
