"""Word pairs, transition probabilities, and random walks over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace import session
from millrace.functions.text import capitalise_first, word_pairs
from millrace.operators.ordered import running_total

START = "."
WALKS_PER_SLOT = 1_000
#: Walks, or transitions, that a task of one step holds, about.
STEP_ROWS = 200_000


def pair_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """How often each word is followed by each next word.

    Pairs are counted as one text and only the distinct ones are split.
    """
    halves = F.split("pair", " ")
    return (
        texts.select(F.explode(word_pairs(F.col(column))).alias("pair"))
        .groupBy("pair").agg(F.count("*").alias("count"))
        .select(halves[0].alias("word"), halves[1].alias("next_word"), "count")
    )


def transitions(counts: DataFrame) -> DataFrame:
    """Cumulative next-word probabilities, likeliest first, ties by word.

    ``low_p`` and ``cum_p`` bound a word's share; the last ``cum_p`` is exactly 1.
    """
    summed = running_total(counts, ["word"], [F.desc("count"), "next_word"], "count")
    return summed.select(
        "word", "next_word", "count",
        ((F.col("running") - F.col("count")) / F.col("total")).alias("low_p"),
        (F.col("running") / F.col("total")).alias("cum_p"),
        "total", "members",
    )


def transition_lines(table: DataFrame, states: int = 10) -> DataFrame:
    """Printed transition rows of the first ``states`` words in word order. The line's layout is a fixed value."""
    chosen = table.select("word").distinct().orderBy("word").limit(states)
    return table.join(F.broadcast(chosen), "word").select(
        "word", F.format_string("|  %.4f     | %-12s|", "cum_p", "next_word").alias("line")
    )


def uniform(seed: str, walk: Column, step: int) -> Column:
    """Repeatable number in [0, 1) per (seed, walk, step)."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), walk.cast("string"), F.lit(str(step))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def slot_count(pairs: int, hot_slots: int) -> Column:
    """Slots a word's [0, 1] is cut into: one per successor, and more for a word
    so common that a slot would draw over ``1 / hot_slots`` of all walks. The
    latter adds ``hot_slots`` slots over all words, the start state as many."""
    share = F.when(F.col("word") == START, F.lit(hot_slots)).otherwise(
        F.ceil(hot_slots * F.col("total") / F.lit(pairs)))
    return F.greatest(F.col("members"), share).cast("long")


def guide(table: DataFrame, pairs: int, hot_slots: int) -> DataFrame:
    """Transitions indexed for inverse lookup, with the slots of the next word.

    A row is stored under each slot it reaches into, so a lookup meets about two
    rows however many successors a word has, and no slot is hot.
    """
    slots = slot_count(pairs, hot_slots)
    sizes = table.select(F.col("word").alias("next_word"), slots.alias("next_slots"), "low_p")
    sizes = sizes.where("low_p = 0").drop("low_p")  # one row per word: its first
    rows = table.join(sizes, "next_word", "left")
    first = F.floor(F.col("low_p") * slots)
    last = F.least(F.floor(F.col("cum_p") * slots), slots - 1)
    return rows.select(
        "word", "next_word", "low_p", "cum_p", "next_slots",
        F.explode(F.sequence(F.least(first, last), last)).alias("slot"),
    )


def random_walks(table: DataFrame, walks: DataFrame, walk: str, steps: int,
                 seed: str = "walk") -> DataFrame:
    """Generate one text per walk id: a first word, then ``steps`` more.

    Every walk starts after a full stop. A word without successors restarts the
    sentence. All walks advance together, one equi-join per step; the index is
    placed by its key once, so that a step moves only the walk, its word and its
    slots. A step is narrow and the same ones come again and again, so it has as many
    tasks as its rows need and not as many as a shuffle of the session. The words
    drawn are written step by step and meet once, at the end.
    """
    spark = table.sparkSession
    session.checkpoint_dir(spark)
    kept = table.checkpoint()
    pairs, rows = kept.agg(F.sum("count"), F.count("*")).first()
    pairs, asked = pairs or 1, walks.count()
    hot_slots = max(1, -(-asked // WALKS_PER_SLOT))
    start = kept.where(F.col("word") == START).select(slot_count(pairs, hot_slots)).first()
    if start is None:
        raise ValueError("no transition starts at a full stop")
    start_slots = F.lit(start[0])
    places = max(spark.sparkContext.defaultParallelism, -(-max(asked, rows) // STEP_ROWS))
    # A cached table keeps its placement and order, so steps join it in place.
    index = (
        guide(kept, pairs, hot_slots).repartition(places, "word", "slot")
        .sortWithinPartitions("word", "slot").persist()
    )

    state = walks.select(F.col(walk).alias("walk"), F.lit(START).alias("word"), start_slots.alias("slots"))
    drawn_words = []
    for step in range(steps + 1):
        # A dead end has no successors of its own and draws from the start state.
        dead = F.col("slots").isNull()
        draw = uniform(seed, F.col("walk"), step)
        drawn = state.select(
            "walk", dead.alias("_dead"), draw.alias("_u"),
            F.when(dead, F.lit(START)).otherwise(F.col("word")).alias("word"),
            F.floor(draw * F.coalesce("slots", start_slots)).alias("slot"),
        ).repartition(places, "word", "slot")
        hit = (F.col("_u") <= F.col("cum_p")) & (
            (F.col("_u") > F.col("low_p")) | ((F.col("low_p") == 0) & (F.col("_u") == 0)))
        state = drawn.join(index, ["word", "slot"]).where(hit).select(
            "walk", F.col("next_word").alias("word"), F.col("next_slots").alias("slots"), "_dead").checkpoint()
        drawn_words.append(state.select("walk", F.struct(F.lit(step).alias("step"), "word", "_dead").alias("_drawn")))
    index.unpersist()
    texts = reduce(DataFrame.unionByName, drawn_words).groupBy("walk").agg(
        F.array_sort(F.collect_list("_drawn")).alias("_words"))
    text = F.aggregate("_words", F.lit(""), _extend)
    return texts.select(F.col("walk").alias(walk), text.alias("text"))


def _extend(text: Column, drawn: Column) -> Column:
    word, dead = drawn["word"], drawn["_dead"]
    return (
        F.when(drawn["step"] == 0, capitalise_first(word))
        .when(dead, F.concat(text, F.lit(". "), capitalise_first(word)))
        .when(word == START, F.concat(text, word))
        .otherwise(F.concat(text, F.lit(" "), word))
    )
