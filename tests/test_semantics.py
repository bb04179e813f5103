"""Small literal cases for the rules that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import numbers, records, text, times
from millrace.operators import (betting, changes, gps, prices, scoring, sentiment, topics, trend, wordchain)

MEETING = """
{"id": 31, "name": "HARBOUR 2019-03-02", "date": {"year": 2019, "monthValue": 3, "dayOfMonth": 2}, "races": [
  {"id": 4, "hasRun": true, "winner": {"name": "Slow Tide", "id": 12},
   "currentVersion": {"version": 2, "odds": {"10": 2.25, "11": 7.5, "12": 13.0},
     "raceTime": {"year": 2019, "monthValue": 3, "dayOfMonth": 2, "hour": 9, "minute": 5, "second": 0},
     "runners": [{"name": "Gull", "id": 10}, {"name": "Lamp", "id": 11}, {"name": "Slow Tide", "id": 12}]}},
  {"id": 5, "hasRun": false,
   "currentVersion": {"version": 0, "odds": {"20": 1.75, "21": 4.5},
     "raceTime": {"year": 2019, "monthValue": 3, "dayOfMonth": 2, "hour": 9, "minute": 50, "second": 0},
     "runners": [{"name": "Buoy", "id": 20}, {"name": "Keel", "id": 21}]}}]}
""".replace("\n", "")


def one(spark, column, **values):
    literals = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("none")]
    return spark.range(1).select(*literals).select(column.alias("out")).first().out


# --- word pairs and walks ----------------------------------------------------

@pytest.mark.parametrize("line,expected", [
    ("A kettle on Wet stones", ["a kettle", "on wet"]),
    ("end. the a .", [". the", "a ."]),
    ("one\ntwo three", ["two three"]),
    ("a  b", []),
    ("café noir", []),
    ("tab\there", ["tab here"]),
    ("", []),
])
def test_pairs_do_not_overlap_nor_cross_lines(spark, line, expected):
    assert one(spark, text.word_pairs(F.col("t")), t=line) == expected


def pair_frame(spark, pairs):
    return spark.createDataFrame(pairs, "word string, next_word string, count long")


def test_cumulative_probabilities_end_at_one(spark):
    table = wordchain.transitions(pair_frame(spark, [("org", w, 1) for w in ["d", "b", "a", "c"]] + [("x", "y", 3), ("x", "z", 7)]))
    rows = {(r.word, r.next_word): (r.low_p, r.cum_p) for r in table.collect()}
    assert rows == {("org", "a"): (0, 0.25), ("org", "b"): (0.25, 0.5), ("org", "c"): (0.5, 0.75), ("org", "d"): (0.75, 1.0),
                    ("x", "z"): (0, 0.7), ("x", "y"): (0.7, 1.0)}


def test_walk_restarts_after_a_dead_end(spark):
    table = wordchain.transitions(pair_frame(spark, [(".", "go", 2), ("go", "north", 1), ("go", ".", 0)]).where("count > 0"))
    walks = spark.range(3).withColumnRenamed("id", "walk_id")
    texts = {r.text for r in wordchain.random_walks(table, walks, "walk_id", 4).collect()}
    assert texts == {"Go north. Go north. Go"}


def test_walk_against_a_plain_loop(spark):
    import hashlib
    pairs = [(".", "a", 5), (".", "b", 3), ("a", ".", 2), ("a", "b", 2), ("b", "a", 1), ("b", "end", 4)] + [
        ("a", f"w{i}", 1) for i in range(30)]
    table = wordchain.transitions(pair_frame(spark, pairs))
    by_word = {}
    for r in sorted(table.collect(), key=lambda r: r.cum_p):
        by_word.setdefault(r.word, []).append((r.cum_p, r.next_word))

    def walk(i, steps):
        word, out = ".", ""
        for step in range(steps + 1):
            u = int(hashlib.md5(f"walk|{i}|{step}".encode()).hexdigest()[:8], 16) / 2 ** 32
            dead = word not in by_word
            word = next(w for p, w in by_word["." if dead else word] if p >= u)
            upper = word[:1].upper() + word[1:]
            out = upper if step == 0 else out + (". " + upper if dead else word if word == "." else " " + word)
        return out

    found = wordchain.random_walks(table, spark.range(40).withColumnRenamed("id", "w"), "w", 9)
    assert {r.w: r.text for r in found.collect()} == {i: walk(i, 9) for i in range(40)}


def test_walk_needs_a_start(spark):
    table = wordchain.transitions(pair_frame(spark, [("a", "b", 1)]))
    with pytest.raises(ValueError):
        wordchain.random_walks(table, spark.range(1), "id", 1)


# --- topics and sentiment ----------------------------------------------------

@pytest.mark.parametrize("tweet,expected", [
    ("#bitcoin", ["BTC", "BTC"]),
    ("Bitcoin Cash", ["BTC", "BCH"]),
    ("together", ["ETH"]),
    ("VIDEOS", ["EOS"]),
    ("nothing", []),
])
def test_one_hit_per_marker(spark, tweet, expected):
    frame = spark.createDataFrame([(tweet,)], "text string")
    assert [r.topic for r in topics.tag_topics(frame).collect()] == expected


def test_marker_terms_are_all_22():
    assert len(topics.marker_terms()) == 22


def sentences(spark, classes, probs=(0.1, 0.2, 0.3, 0.4, 0.5)):
    rows = [(1, c, list(probs)) for c in classes]
    return spark.createDataFrame(rows, "id long, class int, probs array<double>")


@pytest.mark.parametrize("classes,expected", [
    ([4, 2], 1.0 * 0.5), ([3], 0.5 * 0.5), ([3, 3, 1], (7 / 3 - 2) / 2 * 0.4), ([1, 3], 0.0), ([1, 1, 2], -0.5 * 0.2), ([0], -1.0 * 0.1),
])
def test_rollup_picks_the_column_by_band(spark, classes, expected):
    assert sentiment.sentiment_rollup(sentences(spark, classes), ["id"]).first().score == pytest.approx(expected)


def test_neutral_text_scores_nan_and_is_dropped(spark):
    scores = sentiment.sentiment_rollup(sentences(spark, [2, 2]), ["id"])
    assert math.isnan(scores.first().score)
    assert topics.finite_scores(scores).count() == 0


def test_infinite_scores_are_dropped(spark):
    frame = spark.createDataFrame([(float("inf"),), (float("-inf"),), (0.0,)], "score double")
    assert [r.score for r in topics.finite_scores(frame).collect()] == [0.0]


# --- traffic -----------------------------------------------------------------

def test_forecast_without_a_trend_repeats_the_count(spark):
    counts = spark.sql("SELECT TIMESTAMP'2016-03-23 18:15' AS time, '57A' AS location, 23 AS count")
    trends = trend.linear_trend(counts)
    row = trend.forecast(counts, trends).first()
    assert row.predicted_counts == [23] * 8
    assert str(row.time) == "2016-03-23 18:30:00"
    assert trends.where("slope IS NOT NULL").count() == 0  # one time only: no slope


def test_forecast_uses_the_window_ending_a_week_before(spark):
    history = ", ".join(f"(TIMESTAMP'2016-03-16 1{6 + i // 4}:{15 * (i % 4):02d}', '57A', {10 + 2 * i})" for i in range(8))
    counts = spark.sql(f"SELECT * FROM VALUES {history}, (TIMESTAMP'2016-03-23 18:00', '57A', 50) AS t(time, location, count)")
    rows = trend.forecast(counts, trend.linear_trend(counts)).where("time > '2016-03-20'").collect()
    assert rows[0].predicted_counts == [50, 52, 54, 56, 58, 60, 62, 64]


@pytest.mark.parametrize("value,expected", [(-2.5, -2), (2.5, 3), (-2.6, -3), (0.49, 0)])
def test_halves_round_up(spark, value, expected):
    assert one(spark, numbers.round_half_up(F.col("x")), x=value) == expected


# --- betting -----------------------------------------------------------------

def users(spark):
    single = '{"id":1,"stake":1.5,"type":"SINGLE","legs":[{"race":7,"backing":3,"oddsType":"FIXED_ODDS","odds":3.25,"stake":1.5}]}'
    double = '{"id":2,"stake":9.0,"type":"ACCUM","legs":[{"race":7,"backing":3,"odds":2.0},{"race":8,"backing":4,"odds":3.0}]}'
    raw = f'{{"id":1,"firstName":"Ruth","knownBets":[{single},{double}]}}'
    return spark.createDataFrame([(raw,)], "value string").select(records.parse(F.col("value"), schemas.USER).alias("u")).select("u.*")


def test_only_single_bets_count_and_leg_stakes_are_read(spark):
    assert betting.flatten_bets(users(spark)).count() == 3
    singles = betting.single_bets(users(spark))
    assert [tuple(r) for r in singles.collect()] == [(7, 3, 3.25, 1.5)]
    assert [tuple(r) for r in betting.exposure(singles).collect()] == [(7, 3, 4.88)]


def test_payout_only_if_the_backed_horse_wins(spark):
    paid = betting.projected_payout(F.lit(5.5), F.lit(4.0), F.lit(3), F.col("h"))
    assert one(spark, paid, h=3) == 22.0
    assert one(spark, paid, h=4) == 0.0


@pytest.mark.parametrize("won,payout", [((True, True), 60.0), ((True, False), 0.0), ((True, None), None)])
def test_accumulator_settlement(spark, won, payout):
    legs = [(20, 2.0, won[0], None), (10, 3.0, won[1], None)]
    bets = spark.createDataFrame([(1, 10.0, legs)], "id long, stake double, legs array<struct<race_time:long,odds:double,won:boolean,stake:double>>")
    assert betting.settle_nested(bets).first().payout == payout
    flat = spark.createDataFrame([(1, 2.0, 10.0, won[0]), (1, 3.0, 0.0, won[1])], "bet long, odds double, stake double, won boolean")
    assert betting.settle(flat, "bet").first().payout == payout


def test_single_bet_pays_its_leg_stake(spark):
    bets = spark.createDataFrame([(1, 10.0, [(1, 6.0, True, 2.0)])], "id long, stake double, legs array<struct<race_time:long,odds:double,won:boolean,stake:double>>")
    assert betting.settle_nested(bets).first().payout == 12.0


def test_a_type_that_does_not_fit_pays_null(spark):
    leg = (1, 6.0, True, 2.0)
    rows = [(1, "SINGLE", [leg]), (2, "ACCUM", [leg]), (3, None, [leg]), (4, "SINGLE", [leg, leg]), (5, None, [leg, leg])]
    bets = spark.createDataFrame(rows, "id long, type string, legs array<struct<race_time:long,odds:double,won:boolean,stake:double>>")
    paid = betting.settle_nested(bets.withColumn("stake", F.lit(1.0)))
    assert {r.id: r.payout for r in paid.collect()} == {1: 12.0, 2: None, 3: 12.0, 4: None, 5: 36.0}


def test_worst_list_is_ascending_and_empty_loss_is_zero(spark):
    worst = spark.createDataFrame([(r, r, float(30 - r)) for r in range(30)], "race long, horse long, exposure double")
    listed = betting.by_exposure(worst)
    assert [r.race for r in listed.collect()] == list(range(29, 9, -1))
    assert betting.total_loss(listed).first().total_loss == sum(range(1, 21))
    assert betting.total_loss(listed.where("race < 0")).first().total_loss == 0.0
    assert betting.by_exposure(worst, 1, ascending=False).first().race == 0


def test_event_record_and_its_winner(spark):
    frame = spark.createDataFrame([(MEETING,)], "value string").select(records.parse_event(F.col("value")).alias("e")).select("e.*")
    assert [tuple(r) for r in betting.event_winners(frame).collect()] == [("HARBOUR 2019-03-02", 12, "Slow Tide")]
    row = frame.select(times.date_from_parts(F.col("date")).alias("d"),
                       times.time_from_parts(F.col("races")[0]["currentVersion"]["raceTime"]).alias("t"),
                       records.long_keys(F.col("races")[0]["currentVersion"]["odds"]).alias("odds")).first()
    assert (str(row.d), str(row.t), row.odds) == ("2019-03-02", "2019-03-02 09:05:00", {10: 2.25, 11: 7.5, 12: 13.0})


def test_races_without_a_winner_share_the_sentinel(spark):
    lines = ['{"id":%d,"name":"e%d","races":[{"id":1,"hasRun":false}]}' % (i, i) for i in range(3)] + [
        '{"id":9,"name":"none","races":[]}', MEETING]
    frame = spark.createDataFrame([(v,) for v in lines], "value string").select(records.parse_event(F.col("value")).alias("e")).select("e.*")
    winners = betting.event_winners(frame)
    assert [tuple(r) for r in betting.multiple_winners(winners).collect()] == [(schemas.NO_WINNER_ID, 4)]
    lists = {r.winner: r.events for r in betting.events_won(winners, "winner", "event").collect()}
    assert lists == {schemas.NO_WINNER_ID: ["e0", "e1", "e2", "none"], 12: ["HARBOUR 2019-03-02"]}


def test_names_resolve_to_one_id(spark):
    horses = spark.createDataFrame([(1, "Red"), (5, "Red"), (5, "Blue")], "horse long, name string")
    mapping = betting.resolve_names(horses, "horse", "name")
    rows = spark.createDataFrame([(5, "Red", 3.0), (5, "Blue", 4.0), (1, "Red", 6.0)], "horse long, name string, odds double")
    remapped = betting.remap_horses(rows, mapping, ["horse", "name"])
    assert sorted(tuple(r) for r in remapped.select("resolved", "odds").collect()) == [(1, 4.0), (2, 3.0), (2, 6.0)]


def test_runners_carry_odds_and_the_winner(spark):
    frame = spark.createDataFrame([(MEETING,)], "value string").select(records.parse_event(F.col("value")).alias("e")).select("e.*")
    assert sorted(tuple(r) for r in betting.runners(frame).collect()) == [
        ("HARBOUR 2019-03-02", 4, 10, "Gull", 2.25, False), ("HARBOUR 2019-03-02", 4, 11, "Lamp", 7.5, False),
        ("HARBOUR 2019-03-02", 4, 12, "Slow Tide", 13.0, True), ("HARBOUR 2019-03-02", 5, 20, "Buoy", 1.75, False),
        ("HARBOUR 2019-03-02", 5, 21, "Keel", 4.5, False)]


def test_fixed_odds_win_and_a_missing_runner_is_null(spark):
    versions = spark.createDataFrame([(1, 1, 0, 2.0), (1, 1, 1, 5.0), (1, 2, 0, 7.0)], "race long, horse long, version long, odds double")
    legs = spark.createDataFrame([(1, 1, 1, 0, "FIXED_ODDS"), (2, 1, 1, -1, "STARTING_PRICE"), (3, 1, 2, 1, "FIXED_ODDS"), (4, 1, 9, -1, "STARTING_PRICE")],
                                 "bet long, race long, horse long, odds_version long, odds_type string")
    assert {r.bet: r.odds for r in betting.odds_of_legs(legs, versions).collect()} == {1: 2.0, 2: 5.0, 3: None, 4: None}


def test_absent_leg_fields_are_left_out_of_the_json(spark):
    leg = F.struct(F.lit(7).alias("race"), F.lit(None).cast("double").alias("odds"), F.lit(2.0).alias("stake"))
    assert one(spark, records.to_compact_json(leg)) == '{"race":7,"stake":2.0}'


# --- prices and changes ------------------------------------------------------

def test_history_keeps_keys_that_start_with_p(spark):
    metals = spark.createDataFrame([(0, "Gold", "1"), (1, "Palladium", "2"), (2, "platinum", "3"), (3, "Silver", "4")], "id long, metal string, price string")
    lines = prices.history_lines(prices.journal(metals, ["id"]), "metal", "price")
    assert sorted(r.line for r in lines.collect()) == ["Palladium==2", "platinum==3"]


def test_first_change_is_added(spark):
    changes_ = spark.createDataFrame([(0, "Gold", "1"), (1, "Gold", "2")], "id long, metal string, price string")
    lines = [r.line for r in prices.change_notices(changes_, "precious", "metal", "price", "id").orderBy("id").collect()]
    assert lines == ["ADDED event, map 'precious', key 'Gold', new value '1'", "UPDATED event, map 'precious', key 'Gold', new value '2'"]


def test_listing_counts_one_entry(spark):
    latest = spark.createDataFrame([("Gold", "1")], "metal string, price string")
    assert [r.line for r in prices.listing(latest, "metal", "price").collect()] == ["    -> 'Gold' -> 1", "[1 entry]"]


def envelope(op, pos, before=None, after=None, wrapped=True):
    import json
    event = {"before": before, "after": after, "op": op,
             "source": {"ts_ms": 0, "snapshot": "true", "file": "bin.000003", "pos": pos, "row": 0}}
    return json.dumps({"payload": event} if wrapped else event)


def customer(i, first):
    return {"id": i, "first_name": first, "last_name": "L", "email": f"{i}@x"}


@pytest.mark.parametrize("wrapped", [True, False])
def test_current_rows_from_changes(spark, wrapped):
    def key(i):
        return '{"payload":{"id":%d}}' % i if wrapped else '{"id":%d}' % i

    rows = [(key(31), envelope("r", 1, None, customer(31, "Mona"), wrapped)),
            (key(32), envelope("u", 9, customer(32, "Ida"), customer(32, "Ida Lou"), wrapped)),
            (key(32), envelope("r", 2, None, customer(32, "Ida"), wrapped)),
            (key(33), envelope("c", 10, None, customer(33, "Tess"), wrapped)),
            (key(33), None),
            (key(34), envelope("c", 3, None, customer(34, "Gone"), wrapped)),
            (key(34), envelope("d", 12, customer(34, "Gone"), None, wrapped))]
    raw = spark.createDataFrame(rows, "key string, value string")
    found = changes.current_rows(changes.parse_changes(raw)).collect()
    assert {(r.id, r.first_name) for r in found} == {(31, "Mona"), (32, "Ida Lou"), (33, "Tess")}
    assert changes.log_lines(raw).where("line LIKE '%,null)'").count() == 1


# --- track points ------------------------------------------------------------

def test_point_line_fields(spark):
    import json
    points = gps.parse_points(spark.createDataFrame([("48.1,-7.25,30",)], "value string"))
    line = gps.point_json(points.withColumn("input_point", F.lit(1).cast("long")).withColumn("replay_ms", F.lit(61_250).cast("long"))).first().line
    assert line == '{ "input-point": "1", "latitude": "48.1", "longitude": "-7.25", "timestamp": "61250", "timeprint": "00:01:01" }'
    assert json.loads(line)["latitude"] == "48.1"


def test_replayed_time_adds_the_offset(spark):
    assert one(spark, times.replay_ms(F.col("o"), 1_700_000_000_000, 1), o=642) == 1_700_000_000_642
    assert one(spark, times.replay_ms(F.col("o"), 1000), o=4) == 2000


def test_gaps_over_ten_only(spark):
    offsets = [0, 5, 16, 10, 40, 50]
    frame = spark.createDataFrame(list(enumerate(offsets)), "id long, offset long")
    assert [(r.offset, r.gap) for r in gps.gaps(frame, [], ["id"], chunk_rows=2).orderBy("id").collect()] == [(16, 11), (40, 30)]


# --- scoring -----------------------------------------------------------------

@pytest.mark.parametrize("review,expected", [
    ("we sat in row nine", ["we", "sat", "in", "row", "nine"]),
    ("late, but worth it!", ["late", "but", "worth", "it"]),
    ("'quoted' word", ["", "quoted", "word"]),
    ("...", []),
    ("", [""]),
])
def test_tokens(spark, review, expected):
    assert one(spark, text.words(F.col("t")), t=review) == expected


def test_review_codes(spark):
    index = spark.createDataFrame([("film", 17), ("the", 4)], "word string, code int")
    reviews = spark.createDataFrame([(0, "the film The"), (1, "..."), (2, "the " * 400)], "key long, text string")
    codes = {r.key: r.codes for r in scoring.encode_reviews(reviews, "text", index).collect()}
    assert codes[0][:5] == [1, 4, 17, 2, 0] and len(codes[0]) == 256
    assert codes[1] == [1] + [0] * 255
    assert codes[2] == [1] + [4] * 255


@pytest.mark.parametrize("letter,expected", [("b", "BENIGN"), ("M", "MALIGNENT"), ("x", None)])
def test_tumour_letters(spark, letter, expected):
    assert one(spark, text.tumour_type(F.col("t")), t=letter) == expected


def test_match_line_format(spark):
    scored = spark.createDataFrame([("B", "B", [0.75, 0.25]), ("B", "M", [0.1, 0.9]), ("?", "-", [0.5, 0.5])],
                                   "diagnosis string, predicted string, probabilities array<double>")
    lines = [r.line for r in scoring.match_diagnoses(scored).collect()]
    assert lines[0] == "Match: Actual: BENIGN         Prediction: BENIGN              0.75                     0.25                     "
    assert lines[1].startswith("Miss: Actual: BENIGN         Prediction: MALIGNENT")
    assert lines[2].startswith("Match: Actual: null ")
    assert scoring.match_rate(scoring.match_diagnoses(scored)).first().accuracy == pytest.approx(2 / 3)


def test_services_load_once_and_keep_row_order(spark):
    import os
    import pandas as pd
    frame = spark.range(100).coalesce(1)
    scored = scoring.map_with_service(
        frame, "pid", os.getpid, lambda pid, b: pd.DataFrame({"id": b["id"], "pid": pid}), "id long, pid long")
    assert len({r.pid for r in scored.collect()}) == 1
    from pyspark.sql import types as T
    answers = scoring.map_with_async_service(frame, "double", lambda: 2, lambda s, v: s * v, "id", "out", T.LongType())
    assert [r.out for r in answers.collect()] == [2 * i for i in range(100)]


def test_frames_are_classified_and_the_best_kept(spark):
    import pandas as pd
    from millrace.operators import windows
    frames = spark.createDataFrame([(100, bytearray([1, 9])), (900, bytearray([7, 2])), (1500, bytearray([3, 4]))], "ms long, image binary")

    def classify(labels, batch):
        scores = [list(image) for image in batch["image"]]
        return pd.DataFrame({"ms": batch["ms"], "score": [float(max(s)) for s in scores],
                             "category": [labels[s.index(max(s))] for s in scores]})

    scored = scoring.map_with_service(frames, "labels", lambda: ["cat", "dog"], classify, "ms long, score double, category string")
    best = windows.tumbling_best(scored.withColumn("ts", F.timestamp_millis("ms")), "ts", "1 second", "score", ["ms"], ["category", "score"])
    assert [(r.category, r.score) for r in best.orderBy("window_end").collect()] == [("dog", 9.0), ("dog", 4.0)]


def test_boosted_trees_separate_two_classes(spark):
    rows = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 * 5 + F.col("id") / 1000).alias("x"))
    model = scoring.train_boosted_trees(rows, ["x"], "label", trees=3)
    scored = scoring.score_binary(rows, model)
    assert scored.where("prediction <> label").count() == 0
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in scored.collect())


def test_text_classifier_learns_a_word(spark):
    rows = spark.createDataFrame([(f"good film {i}", 1.0) for i in range(20)] + [(f"bad film {i}", 0.0) for i in range(20)], "text string, label double")
    model = scoring.train_text_classifier(rows, "text", "label")
    assert scoring.classify_texts(rows, "text", model).where("prediction <> label").count() == 0


@pytest.mark.parametrize("pieces", [{}, {"piece_vectors": 3, "block_classes": 2}])
def test_nearest_class_in_any_pieces(spark, pieces):
    import numpy as np
    rng = np.random.default_rng(1)
    points = [(i, v.tolist(), i % 5) for i, v in enumerate(rng.normal(size=(40, 3)).round(1))]
    frame = spark.createDataFrame(points, "id long, v array<double>, label long")
    centres = scoring.class_centroids(frame, "v", "label")
    means = {c: np.mean([v for _, v, l in points if l == c], axis=0) for c in range(5)}
    assert {r.label: pytest.approx(means[r.label].tolist()) for r in centres.collect()} == {c: m.tolist() for c, m in means.items()}
    for r in scoring.nearest_class(frame, "id", "v", centres, **pieces).collect():
        distances = {c: float(((np.array(points[r.id][1]) - m) ** 2).sum()) for c, m in means.items()}
        assert r.distance == pytest.approx(min(distances.values())) and distances[r.predicted] == pytest.approx(r.distance)


def test_equal_keys_keep_their_own_texts(spark):
    index = spark.createDataFrame([("a", 4), ("b", 5)], "word string, code int")
    reviews = spark.createDataFrame([(1, "a a"), (1, "b"), (2, None)], "key long, text string")
    got = sorted((r.key, r.codes[:4]) for r in scoring.encode_reviews(reviews, "text", index).collect())
    assert got == [(1, [1, 4, 4, 0]), (1, [1, 5, 0, 0]), (2, [1, 0, 0, 0])]


def test_notices_of_null_keys_and_equal_orders(spark):
    rows = [(1, None, "a"), (2, None, "b"), (5, "k", "y"), (5, "k", "x"), (6, "k", "z"), (7, "old", "o")]
    frame = spark.createDataFrame(rows, "id long, metal string, price string")
    known = spark.createDataFrame([("old",)], "metal string")
    got = {(r.id, r.price): r.kind for r in prices.change_notices(frame, "t", "metal", "price", "id", known).collect()}
    assert got == {(1, "a"): "ADDED", (2, "b"): "UPDATED", (5, "x"): "ADDED", (5, "y"): "UPDATED", (6, "z"): "UPDATED", (7, "o"): "UPDATED"}


def test_a_leg_without_mapping_stays(spark):
    mapping = spark.createDataFrame([(1, 10)], "horse long, resolved long")
    legs = spark.createDataFrame([(1, 2.0), (9, 3.0)], "horse long, stake double")
    assert sorted(((r.resolved, r.stake) for r in betting.remap_horses(legs, mapping, ["horse"]).collect()), key=str) == [(10, 2.0), (None, 3.0)]
