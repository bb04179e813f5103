"""A hash tree over a dataset whose parents keep copied hash states, so that a leaf is re-folded cheaply.

The digest of a parent is the hash of its children's digests, one after another. While a
parent is hashed, the state is copied before each child slot. To fold a replaced child, the
state of its slot is copied once more and goes on with the replacement and the children to
the right; the ones to the left are never read again.

Rows are numbered in their group without sorting a group in one task. Blocks of 3^6 = 729
consecutive nodes are reduced in one task by up to six levels, their roots are the nodes of
the next round, and so on: one round up to 729 nodes in a group, two up to half a million,
four up to 2.8e11. The way down goes the same blocks: a block gets what lies beside its way
to the root, one row for all its nodes, and copies the states of that way for each of them.
Every round is a written table. The driver sees the size of the largest group only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import arrow_schema
from millrace.llm.registry import keep
from millrace.operators import ordered

FAN_OUT, BLOCK_LEVELS = 3, 6

NODES = "tree string, pos long, n long, digest string"
WAYS = "tree string, pos long, lefts array<string>, rights array<string>, subroot string, root string"


class Parent:
    """A parent of a run of children, with a copied hash state before each child slot."""

    def __init__(self, children: list[bytes]):
        state, self.children, self.before = sha256(), children, []
        for child in children:
            self.before.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child in ``slot``: its state goes on with that and the right siblings."""
        state = self.before[slot].copy()
        state.update(replacement)
        for sibling in self.children[slot + 1 :]:
            state.update(sibling)
        return state.hexdigest().encode()

    def beside(self, slot: int) -> tuple[bytes, bytes]:
        """The left and the right siblings of a slot, each in one."""
        return b"".join(self.children[:slot]), b"".join(self.children[slot + 1 :])


def levels(digests: list[bytes], height: int, more: bool) -> list[list[Parent]]:
    """The parents of each level of a block; ``more``: the tree has other blocks, so all ``height`` levels are gone up."""
    out = []
    while len(out) < height and (more or len(digests) > 1):
        out.append([Parent(digests[i : i + FAN_OUT]) for i in range(0, len(digests), FAN_OUT)])
        digests = [p.digest for p in out[-1]]
    return out


@dataclass
class Way:
    """What lies beside the way from a block to the root: a copied state and the right siblings per level."""

    levels: list[tuple[bytes, object, bytes]]

    @classmethod
    def of(cls, lefts: list[str], rights: list[str]) -> Way:
        return cls([(x.encode(), sha256(x.encode()), y.encode()) for x, y in zip(lefts, rights, strict=True)])

    def fold(self, digest: bytes) -> bytes:
        for _, state, right in self.levels:
            state = state.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


def climb(block: list[list[Parent]], place: int) -> Iterable[tuple[Parent, int]]:
    """Parent and slot of a node of the block, level by level."""
    for parents in block:
        yield parents[place // FAN_OUT], place % FAN_OUT
        place //= FAN_OUT


def _block(nodes: pa.Table, height: int) -> tuple[pa.Table, list[bytes], list[list[Parent]]]:
    """A block's nodes by place, their digests, and the parents above them."""
    nodes = nodes.sort_by("pos")
    digests = [x.encode() for x in nodes.column("digest").to_pylist()]
    return nodes, digests, levels(digests, height, nodes.column("n")[0].as_py() > FAN_OUT**height)


def _up(nodes: DataFrame, height: int) -> DataFrame:
    """The roots of the blocks, as the nodes of the next round."""
    schema, size = arrow_schema(NODES), FAN_OUT**height

    def reduce(block: pa.Table) -> pa.Table:
        block, digests, above = _block(block, height)
        root = (above[-1][0].digest if above else digests[0]).decode()
        tree, pos, n = (block.column(c)[0].as_py() for c in ("tree", "pos", "n"))
        return pa.Table.from_pylist([{"tree": tree, "pos": pos // size, "n": -(-n // size), "digest": root}], schema=schema)

    return nodes.select("tree", "pos", "n", "digest").groupBy("tree", F.expr(f"pos div {size}").alias("block")).applyInArrow(reduce, NODES)


def rise(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes of each round, from the given ones to one per tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(keep(_up(rounds[-1], height), "nodes"))
    return rounds


def _meet(nodes: DataFrame, ways: DataFrame, height: int, give, ddl: str) -> DataFrame:
    """``give(nodes, way)`` for each block and the way of its root."""
    block = F.expr(f"pos div {FAN_OUT**height}").alias("block")
    return nodes.groupBy("tree", block).cogroup(ways.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(give, ddl)


def _down(nodes: DataFrame, ways: DataFrame, height: int) -> DataFrame:
    """The way of every node, from those of its block's root."""
    schema = arrow_schema(WAYS)

    def give(block: pa.Table, way: pa.Table) -> pa.Table:
        block, _, above = _block(block, height)
        top, rows = way.to_pylist()[0], []
        for place, pos in enumerate(block.column("pos").to_pylist()):
            beside = [parent.beside(slot) for parent, slot in climb(above, place)]
            rows.append({
                **top, "pos": pos, "lefts": [x.decode() for x, _ in beside] + top["lefts"],
                "rights": [y.decode() for _, y in beside] + top["rights"]})
        return pa.Table.from_pylist(rows, schema=schema)

    return _meet(nodes, ways, height, give, WAYS)


def descend(rounds: list[DataFrame], ways: DataFrame, height: int) -> DataFrame:
    """The ways of the blocks of the first round, from those of the trees' roots in the last one."""
    for nodes in reversed(rounds[1:-1]):
        ways = keep(_down(nodes, ways, height), "ways")
    return ways


def written(column: F.Column) -> F.Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[F.Column]) -> F.Column:
    return F.sha2(F.concat(*map(written, columns)), 256)


def manifest(
    rows: DataFrame, key: str, group: str, columns: list[F.Column], replaced: list[F.Column] | None = None,
    height: int = BLOCK_LEVELS,
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A row's leaf is the hash of ``columns``. Per group the leaves ascend by key; the roots of
    the groups, ordered by the group's text (null first, by bytes), make the root.
    proof_sha256: the hash of all siblings on the way to the root. folded_root: the root as it
    comes out when the row's leaf is made of ``replaced`` and everything beside its way stays;
    verified: that it is the root. ``height``: the levels that one task goes up.

    A null key comes first in its group, equal keys go by leaf; repeated rows are leaves of
    their own. A null group is a group. Nulls in other columns are hashed as such. One row in
    all is its own subroot and root, with the hash of nothing as proof. An empty table gives
    no rows. Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    key_type = rows.schema[key].dataType.simpleString()
    tree = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("tree")
    hashed = keep(rows.select(
        F.col(key).alias("key"), tree, leaf(columns).alias("digest"), leaf(replaced or columns).alias("other"),
        F.monotonically_increasing_id().alias("row"), F.lit(1).cast("long").alias("one")), "leaves")
    placed = ordered.running_total(hashed, ["tree"], ["key", "digest", "row"], "one")
    leaves = keep(placed.select(
        "key", "tree", "digest", "other", (F.col("running") - 1).cast("long").alias("pos"), F.col("members").cast("long").alias("n")), "placed")

    rounds = rise(leaves, height)
    subroots = rounds[-1].select("tree", "digest")
    numbered = keep(ordered.number_rows(subroots, ["tree"], "number"), "subroots")
    trees = numbered.count()
    top = rise(numbered.select(
        F.lit("").alias("tree"), (F.col("number") - 1).alias("pos"), F.lit(trees).cast("long").alias("n"), "digest"), height)
    ddl = f"{key} {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not trees:
        return spark.createDataFrame([], ddl)
    empty = F.array().cast("array<string>")
    start = top[-1].select(
        "tree", "pos", empty.alias("lefts"), empty.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    high = descend([top[0], *top], start, height)  # the first round once more: down to the subroots themselves
    ways = keep(high.join(numbered.select(F.col("tree").alias("name"), (F.col("number") - 1).alias("pos"), "digest"), "pos").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("digest").alias("subroot"), "root"), "ways")

    schema = arrow_schema(ddl)

    def fold(block: pa.Table, way: pa.Table) -> pa.Table:
        block, digests, above = _block(block, height)
        top = way.to_pylist()[0]
        up, columns = Way.of(top["lefts"], top["rights"]), [[] for _ in schema]
        for place, (name, digest, other) in enumerate(zip(
                block.column("key").to_pylist(), digests, block.column("other").to_pylist(), strict=True)):
            proof, folded = sha256(), other.encode()
            for parent, slot in climb(above, place):
                folded = parent.fold(slot, folded)
                for part in parent.beside(slot):
                    proof.update(part)
            for left, _, right in up.levels:
                proof.update(left + right)
            folded = up.fold(folded).decode()
            row = (name, digest.decode(), top["subroot"], top["root"], proof.hexdigest(), folded, folded == top["root"])
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return _meet(leaves, descend(rounds, ways, height), height, fold, ddl)
