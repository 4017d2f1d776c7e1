"""SimHash near-duplicates at a similarity: texts whose sets of word shingles have a Jaccard similarity of ``least`` or more.

Sets of similarity 0.8 differ in 15 of 100 SimHash bits (64 bits: 9.7, give or take 2.9), so fingerprints are four words
long here and the BK-trees' radius is RADIUS of 256 bits: at similarity 0.8, fingerprints of sets of any size from SMALL on
differ in 41 bits or fewer on average (deviation 6), so a pair is beyond it less than once in a million. Bits of smaller
sets are decided by few votes, so these are compared whatever their fingerprints. Runs of bits of which one must agree would be too short for that radius to deal shards by. Shards are dealt by bands of MinHash
places of the same shingles instead: two sets of similarity s share a shard of a band with a chance of
1 - (1 - s ** PLACES) ** BANDS, 0.99995 at 0.8. Pairs from shards are only tried: a link is made where the similarity of
the whole sets, counted exactly, suffices.

Equal sets are one node. Each node is first compared with the least of its shards, and what that joins is one part. In
shards that hold several parts, BK-trees then find the members that are within the radius of one of another part; only
these get their sets, and the trees are searched again, a link being made where whole sets suffice and nothing has
joined the two yet. A task gives fewer links than it has members. Shards of more than ``near`` members are dealt to
tasks by pairs of blocks, so none holds more than two blocks. A pair that meets in several shards is tried in the first.

Defined cases: null, empty and white-space-only texts have one set, that of no words; texts of fewer words than a
shingle have one shingle, the whole sequence; long texts are read whole; equal rows and equal texts share a component;
a null id keeps its row and never becomes a component id unless its group has no other; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_unique
from .neardup import BKTree, components

SHINGLE = 5
LEAST = 0.8
BANDS, PLACES = 25, 5
#: Bits of a fingerprint, and those in which near-duplicates may differ.
BITS, RADIUS = 256, 70
#: Sets of fewer shingles are compared whatever their fingerprints.
SMALL = 8
#: Members, and shingles of all members, of a block of a shard.
NEAR, NEAR_SHINGLES = 1024, 2_000_000
#: Rows that a Python worker turns into shingles at a time.
SLICE = 256
SEED = 42

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = BITS // 64


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a whole text's word shingles in order; words as in ``neardup.fingerprint``."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return np.array([digest(join(words), SEED)], dtype=np.uint64)
    runs = zip(*(words[i:] for i in range(shingle)), strict=False)
    return np.unique(np.array([digest(s, SEED) for s in map(join, runs)], dtype=np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A shard for each band: the hash of its number and of its MinHash places."""
    low = np.full(len(_ODD), (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, (_ODD[:, None] * hashes[None, at : at + 1024]).min(axis=1), out=low)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, PLACES))]


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set, in 64-bit words: of the hashes themselves, then of what mixing makes of them."""
    words = []
    for k in range(_WORDS):
        x = hashes
        if k:
            x = (x ^ (x >> np.uint64(29 + k))) * _ODD[k]
            x = (x ^ (x >> np.uint64(32))) * _ODD[k + _WORDS]
            x ^= x >> np.uint64(31)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 8192):
            ones += np.unpackbits(x[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words.append(np.packbits(ones * 2 > len(x), bitorder="little").view("<u8")[0])
    return np.array(words, dtype=np.uint64)


def with_shards(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, node, size, print, shards) of each row; node stands for the set of its shingles."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part, rows = batch.iloc[at : at + SLICE], []
                for t in part["text"]:
                    h = shingles(t, shingle)
                    rows.append((xxhash.xxh64_intdigest(h.tobytes(), SEED), len(h), fingerprint(h).view(np.int64), np.array(bands(h), dtype=np.uint64).view(np.int64)))
                node = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"id": part["id"].array, "text_hash": part["text_hash"].array, "node": node, "size": [r[1] for r in rows], "print": [r[2] for r in rows], "shards": [r[3] for r in rows]})

    # The id travels as text: a null among longs would make them doubles.
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    made = rows.mapInPandas(make, "id string, text_hash long, node long, size int, print array<long>, shards array<long>")
    return made.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text_hash", "node", "size", "print", "shards")


def with_sets(docs: DataFrame, picked: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the rows of ``docs`` that ``picked(node, doc_id, text_hash)`` names, one for each node."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                yield pd.DataFrame({"node": part["node"], "hashes": [shingles(t, shingle).view(np.int64) for t in part["text"]]})

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    met = rows.join(picked, rows["doc_id"].eqNullSafe(picked["doc_id"]) & (rows["text_hash"] == picked["text_hash"])).select("node", "text")
    return met.mapInPandas(sets, "node long, hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _near(a: str, b: str, radius: int) -> Column:
    """Whether two fingerprints are within the radius."""
    bits = sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(_WORDS)), F.lit(0))
    return bits <= radius


def _fits(a: Column, b: Column, least: float) -> Column:
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar, counted over the whole sets."""
    a, b = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sum"))
    return cut(both.where(F.col("common") >= least * (F.col("sum") - F.col("common")) - 1e-9).select("a", "b"))


def _in_blocks(rows: DataFrame, near: int) -> DataFrame:
    """``rows`` with the pairs of blocks (lo, hi) of their shard in which they are compared, and their own block."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("sum"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
    blocks = F.greatest(F.ceil(F.col("n") / near), F.ceil(F.col("sum") / NEAR_SHINGLES)).cast("int")
    sized = rows.join(sizes.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "part", "size", "print", "shards")


class _Block:
    """A BK-tree over members of two blocks of a shard, searched for members of other parts."""

    def __init__(self, key: tuple[int, int, int], radius: int, least: float) -> None:
        self.key, self.radius, self.least, self.tree = key, radius, least, BKTree()
        self.held: list[tuple[int, int, int, np.ndarray]] = []

    def add(self, own: int, part: int, size: int, words: np.ndarray, shards: np.ndarray) -> Iterator[int]:
        """Numbers of the members before it within the radius that it is to be compared with here."""
        value = int.from_bytes(np.asarray(words, dtype="<i8").tobytes(), "little")
        key, lo, hi = self.key
        for i in self.tree.within(value, self.radius if size * self.least >= SMALL else BITS):
            o, p, s, other = self.held[i]
            if p != part and (lo == hi or o != own) and min(s, size) >= self.least * max(s, size) - 1e-9 and shards[np.argmax(shards == other)] == key:
                yield i
        self.tree.add(value)
        self.held.append((own, part, size, shards))


def _by_block(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int, int], tuple]]:
    """Rows one by one with their (key, lo, hi)."""
    for b in batches:
        yield from zip(zip(b["key"].tolist(), b["lo"].tolist(), b["hi"].tolist(), strict=True), b.itertuples(index=False), strict=True)


def _close(blocks: DataFrame, radius: int, least: float) -> DataFrame:
    """The rows of ``blocks`` that have a member of another part within the radius, in the block pair where both are compared."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, rows, near = None, [], set()
        for key, row in _by_block(batches):
            if block is None or key != block.key:
                if near:
                    yield pd.DataFrame([rows[i] for i in sorted(near)])
                block, rows, near = _Block(key, radius, least), [], set()
            found = list(block.add(row.own, row.part, row.size, row.print, row.shards))
            if found:
                near.update(found, [len(rows)])
            rows.append(row)
        if near:
            yield pd.DataFrame([rows[i] for i in sorted(near)])

    return blocks.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInPandas(search, blocks.schema)


def _tree_links(close: DataFrame, radius: int, least: float) -> DataFrame:
    """Links (a, b) between members of different parts whose sets are similar, enough to connect all that are."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, top, out = None, [], {}, []

        def root(p: int) -> int:
            while (up := top.setdefault(p, p)) != p:
                top[p] = p = top[up]
            return p

        for key, row in _by_block(batches):
            if block is None or key != block.key:
                block, held, top = _Block(key, radius, least), [], {}
            own = np.asarray(row.hashes).view(np.uint64)
            for i in block.add(row.own, row.part, row.size, row.print, row.shards):
                node, part, other = held[i]
                if (a := root(part)) != (b := root(row.part)) and _similarity(own, other) >= least - 1e-12:
                    top[max(a, b)] = min(a, b)
                    out.append((min(node, row.node), max(node, row.node)))
            held.append((row.node, row.part, own))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])

    return close.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInPandas(link, "a long, b long").distinct()


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common / (len(x) + len(y) - common)


def similar(docs: DataFrame, *, shingle: int = SHINGLE, least: float = LEAST, radius: int = RADIUS, near: int = NEAR) -> DataFrame:
    """(doc_id, text_hash, label, component_id) for each row of ``docs(doc_id, text)``.

    label names the component; component_id is the smallest id in it.
    """
    docs = docs.select("doc_id", "text")
    made = cut(with_shards(docs, shingle))
    one = F.struct("doc_id", "text_hash")
    nodes = cut(made.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("print").alias("print"), F.first("shards").alias("shards"), F.first(one).alias("one")))
    entries = nodes.select("node", "size", "print", F.explode("shards").alias("key"))
    shards = entries.groupBy("key").agg(F.min(F.struct("node", "size", "print")).alias("first"), F.max("node").alias("last")).where(F.col("first.node") != F.col("last"))
    met = cut(entries.join(shards, "key").select("key", "node", "size", "print", "first"))
    picked = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "one.doc_id", "one.text_hash")
    sets = cut(with_sets(docs, picked, shingle))
    apart = (F.col("node") != F.col("first.node")) & _fits(F.col("size"), F.col("first.size"), least) & ((F.least("size", "first.size") < SMALL) | _near("print", "first.print", radius))
    links = _alike(met.where(apart).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), sets, least)
    parts = components(links).select("node", F.col("label").alias("part"))
    rows = met.select("key", "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")).join(nodes.select("node", "size", "print", "shards"), "node")
    close = cut(_close(_in_blocks(cut(rows), near), radius, least))
    links = links.unionByName(cut(_tree_links(close.join(sets, "node"), radius, least)))
    named = cut(nodes.select("node", "least").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = cut(named.join(ids, "label").select("node", "label", "component_id"))
    return join_unique(made.select("doc_id", "text_hash", "node"), named, "node").select("doc_id", "text_hash", "label", "component_id")
