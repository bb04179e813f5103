"""Near copies by the Jaccard similarity of their sets of five-word shingles, exactly.

Two sets with a similarity of 4/5 or more share at least 4/5 of the larger one. So in
any one order of all shingles their first fifths (the prefixes, and one shingle more)
have a member in common: sets that share none are never compared, and none is missed.
The order decides the cost only. Shingles that are common in a sample of the documents
come last, so that few sets share a prefix shingle; all others go by their hash.

A pair has no more in common than either set has members from their first common shingle
on, so sets only meet where both have enough left. And of the two prefixes that which ends
first in the order holds all its members that the other set has so far: so a pair shares
at most what the prefixes share and the rest of one of the sets. Pairs that cannot reach
the similarity are left out, the others are counted in full. Sets that are equal are one set.

What is asked for are groups, not pairs, so a large group of near copies is not compared
in pairs. First come the links of fingerprints (``simhash``: anchors of a covering code, 3
bits of 64) made of the same shingles: few of the pairs asked for lie that near, but those
that do are found without a prefix. A link of fingerprints counts only if the sets reach the
similarity. Then every set is compared with one hub of each of its prefix shingles, which
makes no more pairs than there are prefix members: the set whose prefix the others share
most, as an original is among its copies. The links make groups. Only pairs of different groups are left to be compared then, and a
shingle all of whose sets are in one group is done. No link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.arrow import arrow_schema
from millrace.llm.components import components
from millrace.llm.registry import keep, keep_only

# Fixed values of the rule: words of a shingle; the similarity is 4/5.
SHINGLE = 5

#: Documents whose shingles are counted, and how many of the common ones are put last.
SAMPLE_ROWS, COMMON = 20_000, 200_000


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than a shingle are one, no words none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


def _sets(docs: DataFrame, key: str, text: str, common: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(key, id, n, fp, shingles): the set of each row; with the common shingles and their counts only its prefix."""
    ddl = f"{key} {docs.schema[key].dataType.simpleString()}, id long, n long, fp long, shingles array<long>"
    schema = arrow_schema(ddl)

    def chosen(found: np.ndarray) -> np.ndarray:
        if common is None:
            return found
        hashes, counts = common
        weight = np.zeros(len(found), np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            weight = np.where(hashes[at] == found, counts[at], 0)
        n = len(found)
        return found[np.lexsort((found, weight))[: n - (4 * n + 4) // 5 + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # a batch of sets is as large as its texts
                part = batch.slice(at, 1000)
                sets = [shingle_set(t.as_py() or b"") for t in part.column(1).cast(pa.binary())]
                ids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).cast(schema[0].type), pa.array(ids), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([simhash.majority(s.view(np.uint64)) for s in sets], np.uint64).view(np.int64)),
                    pa.array([chosen(s) for s in sets], schema[4].type)], schema=schema)

    return docs.select(key, text).mapInArrow(run, ddl)


def _common(docs: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and counts of the shingles that several documents of a bounded sample share."""
    step = -(-docs.count() // SAMPLE_ROWS) or 1
    sample = _sets(docs.filter(F.pmod(F.xxhash64(key), F.lit(step)) == 0), key, text, None)
    counts = sample.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c")).filter("c > 4")
    rows = counts.orderBy(F.col("c").desc(), "s").limit(COMMON).toPandas().sort_values("s")
    return rows["s"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)


def _shared(marked: DataFrame, sets: DataFrame) -> DataFrame:
    """(shingle, id, n, rest, weight): the prefix shingles that several sets have.

    rest: members of the set from there on. weight: in how many other prefixes a set's
    shingles are found, counted with repeats.
    """
    once = marked.join(sets.select("row"), "row", "left_semi")
    placed = once.select("id", "n", F.posexplode("shingles").alias("at", "shingle"))
    # Kept, so that the counting's shuffle files are gone when the rows are shuffled.
    often = keep(placed.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1"), "often")
    shared = keep(placed.join(often, "shingle").select("shingle", "id", "n", (F.col("n") - F.col("at")).alias("rest"), "c"), "counted")
    weights = shared.groupBy("id").agg((F.sum("c") - F.count("*")).alias("weight"))
    return shared.drop("c").join(weights, "id").select("shingle", "id", "n", "rest", "weight")


def _mixed(shared: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The rows with their ``root``, and (shingle, hub) of the shingles whose sets have several roots."""
    rooted = shared.withColumn("root", F.col("id"))
    if roots is not None:
        rooted = shared.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    chosen = F.max(F.struct("weight", "id", "n", "root"))
    several = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), chosen.alias("hub"))
    return rooted, several.filter("low <> high").select("shingle", "hub")


def _fingerprinted(sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(a, b, an, bn): each set with the first of its fingerprint, and the first ones of linked fingerprints. Sets without members are one set."""
    known = sets.filter("n > 0")
    hubs = keep(known.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("hub")), "fingerprints")
    same = known.join(hubs, "fp").filter("id <> hub.id").select(F.struct("id", "n").alias("a"), F.col("hub").alias("b"))
    a, b = (hubs.select(F.col("fp").alias(v), F.col("hub").alias(f"{v}_hub")) for v in ("a", "b"))
    near = keep(simhash.links(hubs), "fingerprint-links").join(a, "a").join(b, "b").select("a_hub", "b_hub")
    met = same.union(near).filter("9 * least(a.n, b.n) >= 4 * (a.n + b.n)")
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("an"), F.col("b.n").alias("bn"))


def _spokes(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(a, b, an, bn): each set with the hub of its shingles, unless they are linked already. No more than the rows."""
    rooted, hubs = _mixed(shared, roots)
    met = rooted.join(hubs, "shingle").filter("root <> hub.root AND 9 * least(n, hub.n) >= 4 * (n + hub.n)")
    return met.select(F.col("id").alias("a"), F.col("hub.id").alias("b"), F.col("n").alias("an"), F.col("hub.n").alias("bn")).distinct()


def _rest(shared: DataFrame, prefixes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(a, b, an, bn): the pairs of sets not linked yet that may reach the similarity.

    A pair is met at its first common shingle, where both must have as many members left as
    the similarity asks for. Rows that have too few left for any partner go before sets meet.
    """
    rooted, _ = _mixed(shared, roots)
    enough = "9 * rest >= 4 * (n + greatest(least_n, (4 * n + 4) div 5))"
    for round_ in ("first", "again"):  # what goes leaves shingles with one group, or larger sets
        about = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least_n"))
        rooted = keep(rooted.join(about.filter("low <> high").drop("low", "high"), "shingle").filter(enough).drop("least_n"), f"mixed-{round_}")
    x, y = (
        rooted.select("shingle", F.col("id").alias(v), F.col("n").alias(f"{v}n"), F.col("rest").alias(f"{v}r"), F.col("root").alias(f"{v}c"))
        for v in ("a", "b"))
    met = keep(
        x.join(y, "shingle").filter("a < b AND ac <> bc AND 9 * least(ar, br) >= 4 * (an + bn)").select("a", "b", "an", "bn").distinct(), "met")
    named = [prefixes.select(F.col("id").alias(v), F.col("shingles").alias(f"{v}s")) for v in ("a", "b")]
    c = F.size(F.array_intersect("as", "bs"))
    # Behind its prefix a set has no more members than this, and the pair no more in common.
    behind = F.greatest(F.col("an") - F.size("as"), F.col("bn") - F.size("bs"))
    return met.join(named[0], "a").join(named[1], "b").filter(9 * (c + behind) >= 4 * (F.col("an") + F.col("bn"))).select("a", "b", "an", "bn")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text of a, text of b) the (a, b) whose whole sets reach the similarity. Rows of one b mostly come together."""
    last, second = None, np.zeros(0, np.int64)
    for batch in batches:
        reached = []
        texts = (batch.column(i).cast(pa.binary()) for i in (2, 3))
        for b, one, other in zip(batch.column(1).to_pylist(), *texts, strict=True):
            if b != last:
                last, second = b, shingle_set(other.as_py())
            first = shingle_set(one.as_py())
            common = len(np.intersect1d(first, second, assume_unique=True))
            reached.append(9 * common >= 4 * (len(first) + len(second)))
        yield batch.select([0, 1]).filter(pa.array(reached, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b): the pairs whose whole sets reach the similarity. Texts are moved to meet, as they take less room than their sets."""
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # A table of its own, whose size is known: where it is small the texts are not shuffled.
    names = keep(sets.join(asked, "id", "left_semi").select("id", F.col("least").alias("__least")), "names")
    named = docs.select(key, F.col(text).alias("__text")).join(names, F.col(key) == F.col("__least"))
    texts = keep(named.dropDuplicates([key]).select("id", "__text"), "texts")
    a, b = (texts.select(F.col("id").alias(v), F.col("__text").alias(f"{v}_text")) for v in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text").mapInArrow(_similar, "a long, b long")


def near_groups(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, component_id): the smallest key that pairs with a similarity of 4/5 or more lead to, itself included.

    Rows without a word are copies of each other. Repeated rows give repeated results.
    ``docs`` is read several times: pass a table; no key may be null or have two texts.
    """
    prefixes = _sets(docs, key, text, _common(docs, key, text))
    marked = keep(prefixes.withColumn("row", F.monotonically_increasing_id()), "prefixes")
    first = marked.groupBy("id").agg(F.min(F.struct(key, "row", "n", "fp")).alias("first"))
    sets = keep(first.select("id", F.col("first")[key].alias("least"), "first.row", "first.n", "first.fp"), "sets")
    shared = keep_only(partial(_shared, marked, sets), "shared")
    links, roots = [], None
    prefixes = marked.join(sets.select("row"), "row", "left_semi").select("id", "shingles")
    for compared in (partial(_fingerprinted, sets), partial(_spokes, shared), partial(_rest, shared, prefixes)):
        pairs = keep_only(partial(compared, roots), "pairs")
        if not pairs.isEmpty():
            links.append(keep_only(partial(_verified, pairs, sets, docs, key, text), "links"))
            roots = keep_only(partial(components, reduce(DataFrame.union, links)), "roots")
    sets = sets.select("id", "least")
    rooted = sets.withColumn("root", F.col("id"))
    if roots is not None:
        rooted = sets.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select(key, "id").join(rooted.join(least, "root").select("id", "component_id"), "id").select(key, "component_id")
