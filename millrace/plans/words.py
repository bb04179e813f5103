"""Word transitions and walks over ``documents``."""

from pyspark.sql import functions as F

from millrace.operators import wordchain
from millrace.plans import query
from millrace.sources.tables import load, texts

# The pattern of a pair, within a line. Fixed value.
PAIRS_SQL = r"""
lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
hits AS (
  SELECT unnest(regexp_extract_all(lower(line), '(\.|\w+)\s(\.|\w+)', 1)) AS word,
         unnest(regexp_extract_all(lower(line), '(\.|\w+)\s(\.|\w+)', 2)) AS next_word
  FROM lines),
pairs AS (SELECT word, next_word, count(*) AS n FROM hits GROUP BY 1, 2)
"""

TRANSITIONS_SQL = PAIRS_SQL + """,
run AS (
  SELECT word, next_word, n,
    sum(n) OVER (PARTITION BY word ORDER BY n DESC, next_word
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS upto,
    sum(n) OVER (PARTITION BY word)::DOUBLE AS total
  FROM pairs),
transitions AS (
  SELECT word, next_word, n, (upto - n) / total AS low_p, upto / total AS cum_p FROM run)
"""

WALK_STEPS = 12


def _draw(step):
    return (f"(('0x' || substr(md5('walk|' || doc_id || '|{step}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)")


def _capital(word):
    return f"upper(substr({word}, 1, 1)) || substr({word}, 2)"


def _walk_sql(steps):
    pick = "{u} <= t.cum_p AND ({u} > t.low_p OR (t.low_p = 0 AND {u} = 0))"
    ctes = [f"""w0 AS (
  SELECT doc_id, t.next_word AS word, {_capital('t.next_word')} AS text
  FROM (SELECT doc_id, {_draw(0)} AS u FROM documents) d JOIN transitions t
    ON t.word = '.' AND {pick.format(u='d.u')})"""]
    for step in range(1, steps + 1):
        ctes.append(f"""w{step} AS (
  SELECT doc_id, t.next_word AS word,
    CASE WHEN d.dead THEN d.text || '. ' || {_capital('t.next_word')}
         WHEN t.next_word = '.' THEN d.text || '.'
         ELSE d.text || ' ' || t.next_word END AS text
  FROM (SELECT doc_id, text, {_draw(step)} AS u, s.word IS NULL AS dead,
               coalesce(s.word, '.') AS state
        FROM w{step - 1} w LEFT JOIN starts s ON s.word = w.word) d
  JOIN transitions t ON t.word = d.state AND {pick.format(u='d.u')})""")
    return (f"WITH {TRANSITIONS_SQL}, starts AS (SELECT DISTINCT word FROM transitions), "
            + ",\n".join(ctes) + f" SELECT doc_id, text AS walk_text FROM w{steps}")


def _transitions(spark, sf_dir):
    return wordchain.transitions(wordchain.pair_counts(texts(spark, sf_dir)))


@query("markov_pairs", f"WITH {PAIRS_SQL} SELECT word, next_word, n AS pair_count FROM pairs")
def markov_pairs(spark, sf_dir):
    pairs = wordchain.pair_counts(texts(spark, sf_dir))
    return pairs.withColumnRenamed("count", "pair_count")


@query("markov_transitions", f"""WITH {TRANSITIONS_SQL}
SELECT word, next_word, n AS pair_count, round(cum_p, 9) AS cum_p FROM transitions""")
def markov_transitions(spark, sf_dir):
    return _transitions(spark, sf_dir).select(
        "word", "next_word", F.col("count").alias("pair_count"), F.round("cum_p", 9).alias("cum_p"))


@query("markov_top", f"""WITH {TRANSITIONS_SQL},
firsts AS (SELECT DISTINCT word FROM transitions ORDER BY word LIMIT 10)
SELECT word, printf('|  %.4f     | %-12s|', round(cum_p, 4), next_word) AS line
FROM transitions JOIN firsts USING (word)""")
def markov_top(spark, sf_dir):
    return wordchain.transition_lines(_transitions(spark, sf_dir))


@query("markov_walk", _walk_sql(WALK_STEPS))
def markov_walk(spark, sf_dir):
    walks = load(spark, sf_dir, "documents").select("doc_id")
    return wordchain.random_walks(_transitions(spark, sf_dir), walks, "doc_id", WALK_STEPS).select(
        "doc_id", F.col("text").alias("walk_text"))
