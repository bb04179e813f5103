"""Topics and bounded journals: tables arrive in slices, one batch each."""

from pyspark.sql import functions as F

from millrace import session
from millrace.plans import query
from millrace.sinks import journal, keyed, output, topic
from millrace.sources import files
from millrace.sources.tables import load, texts
from millrace.streaming import run

SLICES = 4


@query("stream_topic", f"""
SELECT doc_id, doc_id % {SLICES} AS batch, text FROM documents""")
def stream_topic(spark, sf_dir):
    """Documents go to a topic as JSON lines, slice by slice from one checkpoint, and are read back."""
    place = session.scratch_path(spark, "topic")
    documents = texts(spark, sf_dir)
    for i in range(SLICES):
        lines = documents.where(F.col("doc_id") % SLICES == i).select(F.to_json(F.struct("doc_id", "text")).alias("value"))
        output.write_lines(lines, f"{place}/in", mode="append")
        sent = files.line_stream(spark, f"{place}/in")
        topic.write_topic(sent, f"{place}/out", f"{place}/checkpoint", "documents").awaitTermination()
    record = F.from_json("value", "doc_id long, text string")
    return topic.read_topic(spark, f"{place}/out").select(record.alias("r"), "batch").select("r.doc_id", "batch", "r.text")


#: Changes that the journal of ``stream_journal_kept`` holds at least.
CAPACITY = 3_000


@query("stream_journal_kept", f"""
WITH slices AS (SELECT event_id % {SLICES} AS batch, count(*) AS n FROM events GROUP BY 1),
newer AS (
  SELECT batch, coalesce(sum(n) OVER (ORDER BY batch DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n
  FROM slices)
SELECT event_id, event_type, value FROM events JOIN newer ON event_id % {SLICES} = batch WHERE n < {CAPACITY}""")
def stream_journal_kept(spark, sf_dir):
    """Events in a journal of bounded size: the newest segments are left."""
    place = session.scratch_path(spark, "journal")
    events = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for i in range(SLICES):
        events.where(F.col("event_id") % SLICES == i).write.mode("append").parquet(f"{place}/in")
        changes = files.table_stream(spark, f"{place}/in", "*.parquet")
        run.run_through(changes, journal.bounded_journal(f"{place}/out", CAPACITY), f"{place}/checkpoint")
    return journal.follow(spark, f"{place}/out", CAPACITY).changes.drop("batch")


@query("stream_keyed_lookup", """
WITH latest AS (
  SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id),
asked AS (SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT user_id, event_id, value FROM latest JOIN asked USING (user_id)""")
def stream_keyed_lookup(spark, sf_dir):
    """The last event of some users out of a keyed table, by the buckets of its base that can hold them."""
    place = session.scratch_path(spark, "lookup")
    keys, order = ["user_id"], ["event_id"]
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    for i in range(SLICES):
        events.where(F.col("event_id") % SLICES == i).write.mode("append").parquet(f"{place}/in")
        changes = files.table_stream(spark, f"{place}/in", "*.parquet")
        run.run_through(changes, keyed.upsert(f"{place}/table", keys, order), f"{place}/checkpoint")
        if i == SLICES // 2:
            keyed.compact(spark, f"{place}/table", keys, order)
    asked = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return keyed.read_keys(spark, f"{place}/table", keys, order, asked)
