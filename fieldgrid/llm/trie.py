"""Conversation prefix trie: nodes are distinct beginnings of conversations, each owned by its smallest member.

If a conversation is the smallest member of a node, it is that of all deeper nodes on its path, so it owns a suffix of its
path. A window over each node, of which every task keeps one row before the shuffle, marks the owner. What a subtree holds
is then a sum over its members: the tokens of their occurrences in it minus those of nodes that they own, and a flag for
each whose end is a leaf that it owns. One group-by of occurrences by node, combined before the shuffle, gives all numbers.

A node's key is its depth and two 64-bit lanes: the exclusive or of its turns' digests (SHA-256 of place, role and text), so a
window along the conversation finds the keys of all its beginnings. Texts are digested where they are read and don't travel.
Ids that end at a node are hashed as a stream: sorted by ranges of (node, id), joined to pieces of bounded size in each
range, and the pieces of a node, in order, fed to one SHA-256; no group of ids is ever whole in memory.

Defined cases: turns are ordered by turn, nulls first, then role, then the text's digest; a null role or text is an empty one;
rows that repeat a turn are turns of their own; rows without conv_id take no part; a text is read whole; the turns of one
conversation meet in one task, sorted on disk rather than gathered; an empty table gives no nodes, not even a root; extra
columns are left out. The remainder of a negative id is that of SQL (of the sign of the id).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_unique

#: Conversations of one base share its first turns; a beginning is shorter than this.
BASE, LONGEST = 100, 6
#: Characters of a piece of joined ids.
_PIECE = 1 << 16

NODE = ("depth", "lane1", "lane2")


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % LONGEST).cast("int")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, n_turns, said, tokens) of each turn; said: the digest of role and text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), said.alias("said"), F.char_length(text).cast("long").alias("tokens")
    )
    own = Window.partitionBy("conv_id")
    return turns.select("conv_id", F.row_number().over(own.orderBy(F.asc_nulls_first("turn"), "role", "said")).alias("place"), F.count("*").over(own).alias("n_turns"), "said", "tokens")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, said, tokens): each conversation begins with turns of its base, and a row of depth 0 besides.

    A base serves ``BASE`` conversations on either side of zero and gives five turns at most, so the joins have no hot key.
    """
    each = turns.where("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"), head_turns(F.col("conv_id")).alias("head"))
    heads = turns.where((F.col("conv_id") % BASE == 0) & (F.col("place") < LONGEST)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "n_turns", "said", "tokens")
    sizes = heads.where("depth = 1").select("base", F.col("n_turns").alias("base_turns"))
    each = each.join(sizes, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_turns", F.lit(0))))
    first = each.join(heads, "base").where("depth <= head").select("conv_id", "depth", "said", "tokens")
    rest = turns.join(each.select("conv_id", "head", "taken"), "conv_id").where("place > head")
    rest = rest.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).cast("int").alias("depth"), "said", "tokens")
    root = each.select("conv_id", F.lit(0).alias("depth"), F.lit("").alias("said"), F.lit(0).cast("long").alias("tokens"))
    return root.unionByName(first).unionByName(rest)


def occurrences(turns: DataFrame) -> DataFrame:
    """Each conversation at each node of its path: (conv_id, node, parent's lanes, n: its turns, tokens: those from here to its end)."""
    placed = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "said"), 256)
    lane = lambda k: F.when(F.col("depth") > 0, F.conv(F.substring(placed, 16 * k + 1, 16), 16, -10).cast("long")).otherwise(F.lit(0).cast("long"))
    along = Window.partitionBy("conv_id").orderBy("depth")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("conv_id", "depth", "tokens", lane(0).alias("a"), lane(1).alias("b"))
    rows = rows.select("*", F.bit_xor("a").over(so_far).alias("lane1"), F.bit_xor("b").over(so_far).alias("lane2"), F.max("depth").over(Window.partitionBy("conv_id")).alias("n"), F.sum("tokens").over(back).alias("rest"))
    above = [F.when(F.col("depth") > 0, F.col(lane).bitwiseXOR(F.col(own))).alias(f"parent_{lane}") for lane, own in (("lane1", "a"), ("lane2", "b"))]
    return rows.select("conv_id", *NODE, *above, "n", F.col("rest").alias("tokens"))


def owners(met: DataFrame) -> DataFrame:
    """The occurrence of each node's smallest member."""
    least = F.row_number().over(Window.partitionBy(*NODE).orderBy("conv_id"))
    return met.withColumn("rank", least).where("rank = 1").drop("rank")


def marks(owned: DataFrame) -> DataFrame:
    """Of each conversation that owns nodes: (conv_id, from: its first own node's depth, own_tokens from there on, leaf, above: that node's parent's owner)."""
    first = owned.groupBy("conv_id").agg(F.min_by(F.struct("depth", "parent_lane1", "parent_lane2", "tokens"), "depth").alias("f"))
    first = first.select("conv_id", F.col("f.depth").alias("from"), F.col("f.tokens").alias("own_tokens"), (F.col("f.depth") - 1).alias("d"), F.col("f.parent_lane1").alias("p1"), F.col("f.parent_lane2").alias("p2"))
    node = F.struct(F.col("depth").alias("d"), F.col("lane1").alias("p1"), F.col("lane2").alias("p2"))
    below = first.where("d >= 0").select(F.struct("d", "p1", "p2").alias("node"), "conv_id")
    # An own end has children only if other conversations own them, so such a child is the first own node of its owner.
    parents = below.select("node").distinct()
    leaves = owned.where("depth = n").select("conv_id", node.alias("node")).join(parents, "node", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    above = join_unique(cut(below), owned.select(node.alias("node"), F.col("conv_id").alias("above")), "node").select("conv_id", "above")
    return first.select("conv_id", "from", "own_tokens").join(leaves, "conv_id", "left").join(above, "conv_id", "left")


def ends(met: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end: the digest of their ids, ascending, joined by commas."""
    sorted_ = met.where("depth = n").select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = sorted_.mapInArrow(_pieces, "depth int, lane1 long, lane2 long, first long, piece string")
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(_digests, "depth int, lane1 long, lane2 long, ends_sha256 string")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _sent(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last column has some ``most`` characters in all."""
    schema, held, size = pa.schema(list(zip(names, types, strict=True))), [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def joined() -> Iterator[tuple]:
        node, ids, size = None, [], 0
        for *here, conv_id in _rows(batches):
            if ids and (here != node or size >= _PIECE):
                yield (*node, ids[0], ",".join(map(str, ids)))
                ids, size = [], 0
            node = here
            ids.append(conv_id)
            size += 20
        if ids:
            yield (*node, ids[0], ",".join(map(str, ids)))

    yield from _sent(joined(), [*NODE, "first", "piece"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def hashed() -> Iterator[tuple]:
        node, sha = None, None
        for *here, _, piece in _rows(batches):
            if here != node:
                if sha:
                    yield (*node, sha.hexdigest())
                node, sha = here, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.encode())
        if sha:
            yield (*node, sha.hexdigest())

    yield from _sent(hashed(), [*NODE, "ends_sha256"], [pa.int32(), pa.int64(), pa.int64(), pa.string()])


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text. Tokens are code points; a node saves its last turn's for each member but one.
    """
    met = cut(occurrences(rebuilt(cut(numbered(conversations)))))
    marked = met.join(marks(cut(owners(met))), "conv_id", "left")
    owns = lambda depth: F.coalesce((F.col("from") <= depth) & (depth <= F.col("n")), F.lit(False)).cast("long")
    own_tokens = F.when(F.col("from") <= F.col("depth"), F.col("tokens")).otherwise(F.coalesce("own_tokens", F.lit(0)))
    parent = F.when(F.col("depth") > F.col("from"), F.col("conv_id")).when(F.col("depth") == F.col("from"), F.col("above"))
    nodes = marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min(parent).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum(owns(F.col("depth") + 1)).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"), F.sum(F.col("tokens") - own_tokens).alias("saved_tokens"),
    )
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends(met), list(NODE), "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
