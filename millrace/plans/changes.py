"""Change events made by Spark from ``orders``: the key is the customer, the log
position the order key, the operation the order status."""

from pyspark.sql import functions as F

from millrace.operators import changes
from millrace.plans import query
from millrace.sources.tables import load

# Order status -> operation.
OPERATIONS = {"F": "c", "O": "u", "P": "d"}
ROW = "struct<id:bigint,order_id:bigint,priority:string>"

_OP = "CASE o_orderstatus " + " ".join(f"WHEN '{s}' THEN '{o}'" for s, o in OPERATIONS.items()) + " END"
_ROW = "'{\"id\":' || o_custkey || ',\"order_id\":' || o_orderkey || ',\"priority\":\"' || o_orderpriority || '\"}'"
ENVELOPES = f"""
envelopes AS (
  SELECT o_custkey, o_orderkey, o_orderpriority, {_OP} AS op,
    '{{"payload":{{"id":' || o_custkey || '}}}}' AS key,
    '{{"payload":{{' || CASE WHEN o_orderstatus = 'P' THEN '"before":' ELSE '"after":' END || {_ROW}
      || ',"source":{{"table":"orders","file":"bin.' || lpad((o_orderkey // 1000)::VARCHAR, 9, '0')
      || '","pos":' || o_orderkey || ',"row":0}},"op":"' || {_OP} || '"}}}}' AS value
  FROM orders)
"""
CURRENT_SQL = f"""WITH {ENVELOPES}
SELECT o_custkey AS id, arg_max(o_orderkey, o_orderkey) AS order_id, arg_max(o_orderpriority, o_orderkey) AS priority
FROM envelopes GROUP BY 1 HAVING arg_max(op, o_orderkey) <> 'd'"""


def envelopes(spark, sf_dir):
    """(key, value, pos): JSON envelopes wrapped in ``payload``, as a topic holds them."""
    op = F.lit(None).cast("string")
    for status, name in OPERATIONS.items():
        op = F.when(F.col("o_orderstatus") == status, F.lit(name)).otherwise(op)
    row = F.struct(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("order_id"),
                   F.col("o_orderpriority").alias("priority"))
    file = F.concat(F.lit("bin."), F.lpad(F.floor(F.col("o_orderkey") / 1000).cast("string"), 9, "0"))
    event = F.struct(
        F.when(op == "d", row).alias("before"), F.when(op != "d", row).alias("after"),
        F.struct(F.lit("orders").alias("table"), file.alias("file"), F.col("o_orderkey").alias("pos"),
                 F.lit(0).alias("row")).alias("source"),
        op.alias("op"),
    )
    key = F.struct(F.struct(F.col("o_custkey").alias("id")).alias("payload"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return orders.select(
        F.to_json(key).alias("key"), F.to_json(F.struct(event.alias("payload"))).alias("value"),
        F.col("o_orderkey").alias("pos"))


@query("cdc_current", CURRENT_SQL)
def cdc_current(spark, sf_dir):
    return changes.current_rows(changes.parse_changes(envelopes(spark, sf_dir), ROW)).drop("key")


@query("cdc_raw_latest", f"WITH {ENVELOPES} SELECT key, arg_max(value, o_orderkey) AS value FROM envelopes GROUP BY 1")
def cdc_raw_latest(spark, sf_dir):
    return changes.raw_latest(envelopes(spark, sf_dir), ["pos"])


@query("cdc_log", f"WITH {ENVELOPES} SELECT o_orderkey AS pos, '(' || key || ',' || value || ')' AS line FROM envelopes")
def cdc_log(spark, sf_dir):
    return changes.log_lines(envelopes(spark, sf_dir)).select("pos", "line")
