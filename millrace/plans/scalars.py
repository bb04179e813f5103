"""Column functions over ``part``, ``orders``, ``events`` and ``lineitem``."""

from pyspark.sql import functions as F

from millrace.functions import numbers, records, text, times
from millrace.plans import query
from millrace.sources.tables import load


@query("scalar_text", r"""
SELECT p_partkey AS part, lower(p_brand) AS lowered, contains(p_name, 'bolt') AS has_bolt,
  starts_with(lower(p_name), 's') AS s_name, string_split(p_name, ' ')[1] AS first_word,
  p_brand || '==' || p_type AS pair, printf('%.2f', p_retailprice) AS price,
  printf('%-25s', p_name) || '|' AS padded, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS capital,
  trim(replace('" ' || p_type || '"', '"', '')) AS unquoted
FROM part""")
def scalar_text(spark, sf_dir):
    name = F.col("p_name")
    quoted = F.concat(F.lit('" '), F.col("p_type"), F.lit('"'))
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), F.lower("p_brand").alias("lowered"),
        F.contains(name, F.lit("bolt")).alias("has_bolt"),
        text.starts_with_ignoring_case(name, "S").alias("s_name"),
        F.split(name, " ")[0].alias("first_word"),
        text.key_value_line(F.col("p_brand"), F.col("p_type")).alias("pair"),
        F.format_string("%.2f", "p_retailprice").alias("price"),
        F.concat(text.left_aligned(name, 25), F.lit("|")).alias("padded"),
        text.capitalise_first(name).alias("capital"), text.unquoted(quoted).alias("unquoted"))


@query("scalar_numbers", """
SELECT l_orderkey AS bet, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,
  CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) AS parsed, CAST(l_orderkey::VARCHAR AS BIGINT) AS parsed_long,
  CAST(floor(l_quantity / 2 - 12 + 0.5) AS BIGINT) AS rounded,
  l_discount > 0 AS finite, round(l_quantity / 0.5, 6) AS per_minute
FROM lineitem""")
def scalar_numbers(spark, sf_dir):
    quantity = F.col("l_quantity")
    ratio = F.when(F.col("l_discount") > 0, quantity).otherwise(F.lit(float("inf")))
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("bet"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        quantity.cast("string").cast("double").alias("parsed"),
        F.col("l_orderkey").cast("string").cast("long").alias("parsed_long"),
        numbers.round_half_up(quantity / 2 - 12).alias("rounded"),
        numbers.is_finite(ratio).alias("finite"),
        F.round(numbers.per_minute(quantity, F.lit(30_000)), 6).alias("per_minute"))


@query("scalar_times", """
SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS ms, epoch_us(o_orderdate) // 1000 AS iso_ms,
  strftime(o_orderdate, '%Y-%m-%d') AS day, epoch_us(o_orderdate) // 1000 + 750000 AS minute_ms,
  strftime(make_timestamp((o_orderkey * 250 + 1704067200000) * 1000), '%H:%M:%S') AS clock,
  1704067200000 + o_orderkey * 250 AS replay_ms
FROM orders""")
def scalar_times(spark, sf_dir):
    date = F.col("o_orderdate")
    parts = F.struct(F.year(date).alias("year"), F.month(date).alias("monthValue"),
                     F.dayofmonth(date).alias("dayOfMonth"), F.lit(0).alias("hour"), F.lit(12).alias("minute"))
    iso = F.date_format(date, "yyyy-MM-dd'T'HH:mm")
    replayed = times.replay_ms(F.col("o_orderkey"), 1_704_067_200_000)
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), times.epoch_ms(date).alias("ms"),
        times.epoch_ms(times.from_iso(iso)).alias("iso_ms"),
        times.date_from_parts(parts).cast("string").alias("day"),
        (times.epoch_ms(times.time_from_parts(parts)) + 30_000).alias("minute_ms"),
        times.clock_text(replayed).alias("clock"), replayed.alias("replay_ms"))


@query("scalar_records", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text,
  '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS compact,
  user_id AS map_key, 2 AS items, event_type AS second
FROM events""")
def scalar_records(spark, sf_dir):
    record = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"),
                      F.lit(None).cast("double").alias("stake"))
    odds = records.long_keys(F.create_map(F.col("user_id").cast("string"), F.col("value")))
    items = F.array(F.lit("first"), F.col("event_type"))
    return load(spark, sf_dir, "events").select(
        "event_id", records.parse(F.col("props"), "struct<k:bigint>")["k"].alias("k"),
        records.json_text_field(F.col("props"), "k").alias("k_text"),
        records.to_compact_json(record).alias("compact"), F.map_keys(odds)[0].alias("map_key"),
        F.size(items).alias("items"), F.element_at(items, 2).alias("second"))


@query("scalar_labels", """
SELECT doc_id, CASE WHEN quality = 1 THEN 'BENIGN' WHEN toxic = 1 THEN 'MALIGNENT' END AS tumour
FROM labels""")
def scalar_labels(spark, sf_dir):
    letter = F.when(F.col("quality") == 1, "b").when(F.col("toxic") == 1, "M").otherwise("x")
    return load(spark, sf_dir, "labels").select("doc_id", text.tumour_type(letter).alias("tumour"))


@query("table_scan", """
SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def table_scan(spark, sf_dir):
    """Predicate and projection reach the file scan."""
    wanted = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100_000)
    return load(spark, sf_dir, "orders").where(wanted).select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
