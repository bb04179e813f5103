"""File formats: the table is written by a sink and read back by the reader."""

import json

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Window, functions as F

from millrace import schemas, session
from millrace.functions.text import words
from millrace.functions.times import epoch_ms
from millrace.operators import betting, scoring
from millrace.plans import query, traffic
from millrace.sinks import keyed, output
from millrace.sources import files, kafka
from millrace.sources.tables import load, texts
from millrace.streaming import run
from millrace.streaming import windows as stream_windows


@query("io_car_counts", f"WITH {traffic.COUNTS_SQL} SELECT location, t AS time_ms, n::BIGINT AS cars FROM counts")
def io_car_counts(spark, sf_dir):
    place = session.scratch_path(spark, "csv")
    line = F.concat_ws(",", F.date_format("time", "yyyy-MM-dd'T'HH:mm"), "location", F.col("count").cast("string"))
    output.write_lines(traffic.counts(spark, sf_dir).withColumn("value", line), place)
    return files.car_counts(spark, place, "part-*").select(
        "location", epoch_ms(F.col("time")).alias("time_ms"), F.col("count").alias("cars"))


@query("io_lines", """
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(*) AS copies FROM lines GROUP BY 1""")
def io_lines(spark, sf_dir):
    place = session.scratch_path(spark, "lines")
    output.write_lines(texts(spark, sf_dir), place, "text")
    return files.lines(spark, place).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("copies"))


@query("io_race_events", """
WITH firsts AS (
  SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey
                             ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) = 1)
SELECT 'event ' || l_orderkey AS event, l_partkey AS winner, 'horse ' || l_partkey AS winner_name
FROM firsts WHERE l_returnflag = 'R'
UNION ALL
SELECT 'event ' || l_orderkey, -9223372036854775807 - 1, 'DEATH' FROM firsts WHERE l_returnflag <> 'R'""")
def io_race_events(spark, sf_dir):
    """Events as JSON lines, with the race's winner if its line was returned."""
    place = session.scratch_path(spark, "events")
    first = F.min_by(F.struct("l_partkey", "l_returnflag"),
                     F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(first.alias("r"))
    horse = F.struct(F.concat(F.lit("horse "), F.col("r.l_partkey").cast("string")).alias("name"),
                     F.col("r.l_partkey").alias("id"))
    run_flag = F.col("r.l_returnflag") == "R"
    race = F.struct(F.lit(1).alias("id"), run_flag.alias("hasRun"), F.when(run_flag, horse).alias("winner"))
    event = F.struct(F.col("l_orderkey").alias("id"),
                     F.concat(F.lit("event "), F.col("l_orderkey").cast("string")).alias("name"),
                     F.array(race).alias("races"))
    output.write_lines(lines.select(F.to_json(event).alias("value")), place)
    return betting.event_winners(files.events(spark, place))


@query("io_word_index", r"""
WITH words AS (SELECT unnest(string_split_regex(text, '\W+')) AS word FROM documents)
SELECT word, count(*) + 3 AS code FROM words WHERE word <> '' GROUP BY 1""")
def io_word_index(spark, sf_dir):
    """A JSON dictionary per line, each with one word, read back with its code moved up."""
    place = session.scratch_path(spark, "dictionary")
    counts = (
        texts(spark, sf_dir).select(F.explode(words(F.col("text"))).alias("word"))
        .where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("n")))
    output.write_lines(counts.select(F.to_json(F.create_map("word", "n")).alias("value")), place)
    return files.word_index(spark, place, whole_files=False)


@query("io_topic_records", """
SELECT event_id AS key, event_type AS kind, value AS price FROM events""")
def io_topic_records(spark, sf_dir):
    """Records of a topic's shape (binary key and value, partition, offset), as a stream."""
    place = session.scratch_path(spark, "topic")
    value = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("value").alias("price")))
    load(spark, sf_dir, "events").select(
        F.to_json(F.struct(F.col("event_id").alias("id"))).cast("binary").alias("key"), value.cast("binary").alias("value"),
        F.lit(0).alias("partition"), F.col("event_id").alias("offset")).write.parquet(f"{place}/topic")
    records = kafka.json_records(files.table_stream(spark, f"{place}/topic", "*.parquet"),
                                 "struct<id:bigint>", "struct<kind:string,price:double>")
    run.run_through(records, keyed.append_batch(f"{place}/out"), f"{place}/checkpoint")
    return keyed.read_batches(spark, f"{place}/out").select(F.col("key.id").alias("key"), "value.kind", "value.price")


@query("io_posts", """
SELECT text FROM documents
WHERE """ + " OR ".join(
    f"contains(lower(text), '{m.lower()}')" for markers in schemas.COIN_MARKERS.values() for m in markers))
def io_posts(spark, sf_dir):
    """Posts arrive as JSON lines in new files; those that mention a tracked topic are kept."""
    place = session.scratch_path(spark, "posts")
    posts = texts(spark, sf_dir)
    for i in range(3):
        lines = posts.where(F.col("doc_id") % 3 == i).select(F.to_json(F.struct("text")).alias("value"))
        output.write_lines(lines, f"{place}/in", mode="append")
        tracked = files.tracked_posts(files.line_stream(spark, f"{place}/in"))
        run.run_through(tracked, keyed.append_batch(f"{place}/out"), f"{place}/checkpoint")
    return keyed.read_batches(spark, f"{place}/out").select("text")


@query("io_stamped", "SELECT event_id, event_id % 3 + 1 AS batch FROM events")
def io_stamped(spark, sf_dir):
    """Events in three slices get the instant they come in; the instants, in order, number the batches."""
    place = session.scratch_path(spark, "stamped")
    events = load(spark, sf_dir, "events").select("event_id")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).write.mode("append").parquet(f"{place}/in")
        stream = stream_windows.stamped_now(files.table_stream(spark, f"{place}/in", "*.parquet"))
        run.run_through(stream, keyed.append_batch(f"{place}/out"), f"{place}/checkpoint")
    kept = keyed.read_batches(spark, f"{place}/out").drop("batch")
    instants = kept.select("ingested").distinct()
    numbered = instants.withColumn("batch", F.row_number().over(Window.orderBy("ingested")).cast("long"))  # a row per batch
    return kept.join(numbered, "ingested").select("event_id", "batch")


@query("io_attached", "SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def io_attached(spark, sf_dir):
    """A dictionary file is shipped with the job and loaded once per worker."""
    place = session.scratch_path(spark, "dictionary")
    load(spark, sf_dir, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value")).coalesce(1).write.text(place)
    attached = scoring.attach(spark, spark.read.text(place).inputFiles()[0])

    def load_names():
        with open(SparkFiles.get(attached)) as shipped:
            return {r["n_nationkey"]: r["n_name"] for r in map(json.loads, shipped)}

    def apply(known, batch):
        return pd.DataFrame({"c_custkey": batch["c_custkey"], "nation": batch["c_nationkey"].map(known)})

    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return scoring.map_with_service(customers, attached, load_names, apply, "c_custkey long, nation string").where(
        "nation IS NOT NULL")


@query("io_published", "SELECT count(*) AS lines, sum(length(text))::BIGINT AS chars FROM documents")
def io_published(spark, sf_dir):
    """Texts go out through a client of each task; the stand-in topic counts what it gets."""
    topic = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def send(client, line):
        client[0].add(1)
        client[1].add(len(line))

    output.publish(texts(spark, sf_dir), lambda: topic, send, "text")
    return spark.createDataFrame([tuple(t.value for t in topic)], "lines long, chars long")
