"""SimHash near-duplicates: fingerprints within a Hamming radius, found with BK-trees, joined to components.

Fingerprints that differ in ``radius`` bits or fewer agree in one of ``radius + 1`` runs of bits, whatever the bits
are. Each distinct fingerprint therefore goes to ``radius + 1`` shards, keyed by run and its value, and each linked
pair meets in a shard. A shard's BK-tree (children keyed by integer distance to the parent) is built in the task that
holds the shard, and a search follows only the edges within the radius. A shard with more than ``SHARD_MOST``
fingerprints is dealt anew by runs of its remaining bits, again and again, so no task holds a shard without bound.
Trees of all fingerprints are never collected or broadcast: they grow with the corpus.

Defined cases: null, empty and white-space-only texts have fingerprint zero, linked like any other; texts of one or
two words have one shingle, the whole sequence; texts of any length are read whole; equal rows and equal texts share a
component, and an id that repeats with other texts has a row in each of theirs; a null id keeps its row and never
becomes a component id unless its group has no other; an empty table gives an empty one; extra columns are left out
here and stay in what ``keep_one_each`` returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_unique, small

RADIUS = 3
#: Fingerprints that one BK-tree holds at most; larger shards are dealt anew by further bits.
SHARD_MOST = 2048
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text over word shingles, repeats included.

    ``bytes.lower`` lower-cases A-Z only and ``bytes.split`` parts at 20 and 09 to 0D only.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return digest(join(words), SEED)
    runs = zip(*(words[i:] for i in range(shingle)), strict=False)
    hashes = np.array([digest(s, SEED) for s in map(join, runs)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, column: str = "fp") -> DataFrame:
    """``docs`` and the fingerprint of each whole text as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(column, simhash(F.col("text")))


class BKTree:
    """A BK-tree over distinct integers; each node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        at, new = 0, len(self.values)
        if new:
            while True:
                d = (self.values[at] ^ value).bit_count()
                down = self.children[at].get(d)
                if down is None:
                    self.children[at][d] = new
                    break
                at = down
        self.values.append(value)
        self.children.append({})
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the nodes at ``radius`` or less; a child is visited only if its edge is within the radius of the distance here."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if kids := self.children[at]:
                todo.extend([child for edge, child in kids.items() if d - radius <= edge <= d + radius])
        return found


def _shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what is within the radius in one shard: fewer than there are fingerprints, never all pairs."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            if (a := top(i)) != (b := top(j)):
                root[max(a, b)] = min(a, b)
                yield v, values[j]
        tree.add(v)


def _runs(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` cut into ``parts`` runs of about equal length."""
    return [bits[i * len(bits) // parts : (i + 1) * len(bits) // parts] for i in range(parts)]


def _links(fps: DataFrame, radius: int, most: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are within the radius."""
    spark = fps.sparkSession

    def parted(rows: DataFrame, spaces: dict[str, tuple[list[int], list[int]]]) -> tuple[DataFrame, dict[str, tuple[list[int], list[int]]]]:
        """Each row in ``radius + 1`` shards: a shard's run names the bits that agree in it, key has their values.

        The table of masks has a row for each way in which bits were cut so far, and travels to the rows.
        """
        finer = {f"{name}{i}": (fixed + run, [b for b in free if b not in run]) for name, (fixed, free) in spaces.items() for i, run in enumerate(_runs(free, radius + 1))}
        masks = [(name[:-1], name, (m := sum(1 << b for b in fixed)) - (m >> 63 << 64)) for name, (fixed, _) in finer.items()]
        if len(spaces) == 1:
            each = F.explode(F.array(*[F.struct(F.lit(child).alias("run"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for _, child, mask in masks])).alias("s")
            return rows.select("fp", each).select("fp", "s.*"), finer
        table = spark.createDataFrame(masks, "run string, child string, mask long")
        return rows.join(F.broadcast(table), "run").select("fp", F.col("child").alias("run"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")), finer

    rows, spaces = parted(fps.select("fp"), {"": ([], list(range(64)))})
    levels = []
    while True:
        large = cut(rows.groupBy("run", "key").count().where(F.col("count") > most).select("run", "key"))
        names = {r["run"] for r in large.select("run").distinct().collect()}  # ways to cut bits, not shards
        spaces = {name: space for name, space in spaces.items() if name in names and len(space[1]) > radius}
        if not spaces:
            levels.append(rows)
            break
        large = large.join(F.broadcast(spark.createDataFrame([(n,) for n in spaces], "run string")), "run")
        levels.append(rows.join(large, ["run", "key"], "left_anti"))
        rows, spaces = parted(cut(rows.join(large, ["run", "key"], "left_semi")), spaces)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[int] = []
        now = None
        for b in batches:
            out: list[tuple[int, int]] = []
            for run, key, fp in zip(b["run"].tolist(), b["key"].tolist(), b["fp"].tolist(), strict=True):
                if (run, key) != now:
                    if len(held) > 1:
                        out.extend(_shard_links(held, radius))
                    held, now = [], (run, key)
                held.append(fp & (1 << 64) - 1)
            yield _signed(out)
        if len(held) > 1:
            yield _signed(list(_shard_links(held, radius)))

    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    return every.repartition("run", "key").sortWithinPartitions("run", "key", "fp").mapInPandas(search, "a long, b long")


def _signed(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    x = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1]})


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): the smallest node reachable.

    Large-star and small-star steps in turn, each a shuffle with a pre-aggregated minimum, until nothing changes.
    The number of links never grows; a written table after each round cuts the lineage.
    """
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.*").where(F.col("u") != F.col("v")).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, shard_most: int = SHARD_MOST) -> DataFrame:
    """(doc_id, fp, text_hash, label, component_id) for each row of ``docs(doc_id, text)``.

    label, a fingerprint, names the component; component_id is the smallest id reachable.
    """
    prints = cut(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp", F.xxhash64("text").alias("text_hash")))
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(_links(fps.select("fp"), radius, shard_most)).withColumnRenamed("node", "fp")
    grouped = cut(fps.join(linked, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    ids = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    named = cut(grouped.join(ids, "label").select("fp", "label", "component_id"))
    return join_unique(prints, named, "fp").select("doc_id", "fp", "text_hash", "label", "component_id")


def keep_one_each(docs: DataFrame, find: Callable[..., DataFrame] = near_duplicates, **options: float) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id, and of the smallest hash of its text if the id repeats.

    Rows are told apart by id and text: an id that repeats with other texts loses none of them but to copies. Rows
    without an id stay. Only ids and hashes travel until the last join. ``find`` gives the component of each row.
    """
    found = cut(find(docs, **options).where(F.col("doc_id").isNotNull()).select("doc_id", "text_hash", "label"))
    each = cut(found.groupBy("label", "doc_id", "text_hash").count())
    first = cut(each.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")))
    rows = cut(join_unique(each, first, "label").withColumn("stays", F.struct("doc_id", "text_hash") == F.col("first")))
    gone = small(cut(rows.where(~F.col("stays")).select("doc_id", "text_hash")))
    again = small(cut(rows.where(F.col("stays") & (F.col("count") > 1)).select("doc_id", "text_hash")))
    own, hashed = docs.columns, fresh(docs, "text_hash")
    left = docs.withColumn(hashed, F.xxhash64("text"))
    match = lambda ids: (left["doc_id"] == ids["doc_id"]) & (left[hashed] == ids["text_hash"])
    left = left.join(gone, match(gone), "left_anti")
    if again.isEmpty():
        return left.select(*own)
    once = left.join(again, match(again), "left_semi").dropDuplicates(["doc_id", hashed])
    return left.join(again, match(again), "left_anti").unionByName(once).select(*own)
