"""Line dedup: repeated runs of lines over all documents, later copies deleted.

Lines with a word are numbered through all documents, with a gap after each one. The
suffixes of these line sequences are sorted by prefix doubling: rank 0 of a suffix
is the class of its first line, and the ranks for 2h lines are the classes of the
pairs (rank for h lines here, rank for h lines h further on). A class is named by its
first member, which is exact and needs no global sort: suffixes with a common prefix
of 2^k lines are those with the same rank k, and they are the LCP interval of that
depth in the suffix array. Suffixes alone in their class have no common prefix of
that length and leave; only the repeated rest is doubled again.

The interval of any depth t between two powers is the pair of the ranks for the
first and the last 2^k of the t lines. A run is taken to be a copy if it holds
``min_words`` words or more and occurs earlier, by document and line. A line lies in
such a run exactly if it lies in one that is shortest from its first or from its
last line: of any repeated run, cut down to what still holds the words and the line,
such a run is left. So two intervals per line decide about all maximal runs.

All steps are joins, aggregations and windows within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.registry import keep

#: Words that a repeated run must hold.
MIN_WORDS = 50

WORD = r"[^\x20\x09-\x0D]+"


def _told_apart(docs: DataFrame, key: str) -> DataFrame:
    """The rows with ``__row``: a number for each row without a key, null for the others.

    Only the rows without a key are written, so that their numbers hold.
    """
    keyless = docs.filter(F.col(key).isNull()).withColumn("__row", F.monotonically_increasing_id())
    keyed = docs.filter(F.col(key).isNotNull()).withColumn("__row", F.lit(None).cast("long"))
    return keyed.union(keep(keyless, "rows-without-key"))


def _identity(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``_told_apart`` with k1 and k2: a document is its key and its text, or a row without a key, which comes last."""
    return docs.withColumns({
        "__k1": F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)), "__k2": F.coalesce("__row", F.xxhash64(text))})


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, k1, k2, at, line, h1, h2, words): lines with a word, and after each document a gap without h1."""
    numbered = _identity(docs, key, text).select(
        F.monotonically_increasing_id().alias("doc"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"),
        F.col(text).alias("whole"))
    rows = numbered.select(
        "doc", "k1", "k2",
        F.posexplode(F.array_append(F.split("whole", "\n"), F.lit(None).cast("string"))).alias("at", "content"))
    lines = rows.withColumn("words", F.regexp_count("content", F.lit(WORD))).filter("words > 0 OR content IS NULL")
    digests = [F.when(F.col("content").isNotNull(), F.xxhash64(*x)) for x in (["content"], [F.lit("line"), "content"])]
    return lines.select(
        "doc", "k1", "k2", "at", F.monotonically_increasing_id().alias("line"), digests[0].alias("h1"),
        digests[1].alias("h2"), "words")


def _named(rows: DataFrame, parts: list[str]) -> DataFrame:
    """(parts, rank): the classes with two members or more, named by the first."""
    return rows.groupBy(*parts).agg(F.min("line").alias("rank"), F.count("*").alias("n")).filter("n > 1").drop("n")


def _doubled(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks for 2 x step lines from the ranks for step lines."""
    ahead = ranks.select((F.col("line") - step).alias("line"), F.col("rank").alias("next"))
    pairs = ranks.withColumnRenamed("rank", "here").join(ahead, "line")
    return pairs.join(_named(pairs, ["here", "next"]), ["here", "next"]).select("line", "rank")


def _runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, k1, line, t): for each repeated line the shortest runs of enough words from it and up to it."""
    stretch = F.col("line") - F.row_number().over(Window.partitionBy("doc").orderBy("line"))
    whole = Window.partitionBy("doc", "stretch")
    upto = F.sum("words").over(whole.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    counted = lines.withColumn("stretch", stretch).withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    ahead = whole.orderBy("before").rangeBetween(0, min_words - 1)
    behind = whole.orderBy("upto").rangeBetween(1 - min_words, 0)
    sized = counted.select(
        "doc", "k1", "line", "before", "upto",
        F.count("*").over(ahead).alias("t1"), F.max("upto").over(ahead).alias("end"),
        F.count("*").over(behind).alias("t2"), F.min("before").over(behind).alias("start"))
    forth = sized.filter(F.col("end") - F.col("before") >= min_words).select("doc", "k1", "line", F.col("t1").alias("t"))
    back = sized.filter(F.col("upto") - F.col("start") >= min_words).select(
        "doc", "k1", (F.col("line") - F.col("t2") + 1).alias("line"), F.col("t2").alias("t"))
    return forth.union(back).distinct()


def removed_stretches(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, stretches): line numbers (first, last) to delete, in order, of the documents of ``_told_apart`` that lose any."""
    lines = keep(numbered_lines(docs, key, text), "lines")
    seen = lines.filter(F.col("h1").isNotNull())
    # As a table of its own it is shuffled apart from the lines, and a very common line can be split.
    classes = keep(_named(seen, ["h1", "h2"]), "classes")
    repeated = keep(seen.join(classes, ["h1", "h2"]).select("doc", "k1", "k2", "at", "line", "words", "rank"), "repeated-lines")

    levels = [repeated.select("line", "rank")]
    while 2 ** len(levels) <= min_words:
        levels.append(keep(_doubled(levels[-1], 2 ** (len(levels) - 1)), "ranks"))
    ranks = levels[0].withColumn("level", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        ranks = ranks.union(level.withColumn("level", F.lit(k)))

    # The interval of each run: the ranks of its first and of its last 2^level lines.
    runs = _runs(repeated, min_words).withColumn("level", (F.length(F.bin("t")) - 1).cast("int"))
    last = F.col("line") + F.col("t") - F.expr("shiftleft(1, level)")
    heads = ranks.withColumnRenamed("rank", "head")
    tails = ranks.select("level", F.col("line").alias("last"), F.col("rank").alias("tail"))
    intervals = keep(
        runs.withColumn("last", last).join(heads, ["level", "line"]).join(tails, ["level", "last"])
        .select("t", "head", "tail", "k1", "line"), "intervals")
    first = intervals.groupBy("t", "head", "tail").agg(F.min(F.struct("k1", "line")).alias("first"), F.count("*").alias("n"))
    copies = intervals.join(first.filter("n > 1").drop("n"), ["t", "head", "tail"]).filter(
        F.struct("k1", "line") > F.col("first"))
    gone = copies.select(F.explode(F.sequence("line", F.col("line") + F.col("t") - 1)).alias("line")).distinct()

    # Rows that repeat a document are that document: what its first row loses counts.
    rows = lines.filter(F.col("h1").isNull()).groupBy("k1", "k2").agg(F.min("doc").alias("doc"))
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc").orderBy("line"))
    return (
        repeated.join(gone, "line").join(rows, ["k1", "k2", "doc"], "left_semi").withColumn("island", island)
        .groupBy("k1", "k2", "island").agg(F.min("at").alias("a"), F.max("at").alias("b"))
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("stretches")))


def _kept_lines(lines: Column, stretches: Column) -> Column:
    """The lines between the stretches, in one pass over the lines."""
    def between(all_lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(stretches, lambda s: s["b"] + 1))
        ends = F.concat(F.transform(stretches, lambda s: s["a"]), F.array(F.size(all_lines)))
        gaps = F.arrays_zip(starts.alias("s"), ends.alias("e"))
        return F.flatten(F.transform(gaps, lambda g: F.slice(all_lines, g["s"] + 1, g["e"] - g["s"])))

    # As the variable of a lambda the split text is made once, not once for each gap.
    return F.transform(F.array(lines), between)[0]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with later copies of repeated runs cut from ``text``, and ``lines_removed`` added.

    Earlier means: smaller key (null last), then table order, then line. Every run keeps
    its first copy. Empty lines neither make nor break a run; those inside a stretch that
    is cut go with it. A text that is a copy as a whole becomes empty. Null text stays
    null. Rows equal in key and text are one document: they keep what it keeps. Each row
    without a key is a document of its own, so of equal texts among them the first stays.
    """
    docs, columns = _told_apart(docs, key), docs.columns
    stretches = removed_stretches(docs, key, text, min_words).withColumnsRenamed({"k1": "__k1", "k2": "__k2", "stretches": "__cut"})
    rows = _identity(docs, key, text).join(stretches, ["__k1", "__k2"], "left")
    left = F.array_join(_kept_lines(F.split(text, "\n"), F.col("__cut")), "\n")
    count = F.aggregate("__cut", F.lit(0), lambda n, s: n + s["b"] - s["a"] + 1)
    kept = [F.when(F.col("__cut").isNull(), F.col(c)).otherwise(left).alias(c) if c == text else F.col(c) for c in columns]
    return rows.select(*kept, F.coalesce(count, F.lit(0)).cast("long").alias("lines_removed"))
