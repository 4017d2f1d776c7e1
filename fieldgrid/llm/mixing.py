"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, are cut into blocks of ``block_chars`` characters. A source of weight w owes
its k-th block (from 0) a slot in a window: released at floor(k / w), due at ceil((k + 1) / w). In each slot the
released block with the earliest deadline is placed, so after t slots a source has had within one block of w * t.

Weights are whole shares, so the schedule repeats after as many slots as there are shares; one such period is
scheduled with a heap, and any block's slot follows by arithmetic. When a source has no more blocks, the others go on
with their shares in a new phase. Documents are never sent to the driver. Sources, phases and periods are planned there
and broadcast: with S sources that run out one by one, S * S / 2 rows, so this is for hundreds of sources; MOST_SOURCES
is checked. Group more of them first (web domains, say, by a hash or a topic).

Defined cases: a null source is a source of its own; a null text has no characters; sources without a weight get
weight 0 and come after all others, one after another; repeated rows are rows of their own; a text longer than a
block has the slot of its first block and uses up those of all; extra columns are left out here, and stay in what
``in_mixed_order`` returns; empty tables give empty results; a source may hold any share of the rows: its running totals are made in buckets.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh

BLOCK_CHARS = 65_536
#: Buckets of a source by hash of the id, for running totals; each is ordered by one task at a time.
BUCKETS = 4096
#: Shares that all sources have together, about, when weights come from their sizes.
SHARES = 1000
SEED = 17
#: Sources that a plan may have.
MOST_SOURCES = 1000


@dataclass(frozen=True)
class Phase:
    """Slots from ``start`` on, in which the sources of ``slots`` take turns; ``first``: their first block in it."""

    start: int
    end: int
    period: int
    first: Mapping[str, int]
    slots: Mapping[str, list[int]]


def period_of(shares: Mapping[str, int]) -> tuple[int, dict[str, list[int]]]:
    """Slots of each source in one period: released blocks, earliest deadline first; ties by name."""
    by = math.gcd(*shares.values())
    shares = {s: k // by for s, k in shares.items()}
    period, slots = sum(shares.values()), {s: [] for s in shares}
    waiting = [(0, s, 0) for s in sorted(shares)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // shares[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(t)
        if k + 1 < shares[s]:
            heapq.heappush(waiting, ((k + 1) * period // shares[s], s, k + 1))
    return period, slots


def phases_of(blocks: Mapping[str, int], shares: Mapping[str, int]) -> list[Phase]:
    """Phases until all ``blocks`` of each source have a slot; sources without shares follow one after another."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        active = {s: shares[s] for s in left if shares.get(s, 0) > 0} or {min(left): 1}
        period, slots = period_of(active)
        length = min((left[s] - 1) // len(at) * period + at[(left[s] - 1) % len(at)] + 1 for s, at in slots.items())
        out.append(Phase(start, start + length, period, {s: done[s] for s in active}, slots))
        for s, at in slots.items():
            had = length // period * len(at) + sum(t < length % period for t in at)
            done[s] += had
            left[s] -= had
            if not left[s]:
                del left[s]
        start += length
    return out


def _source() -> Column:
    """A name for each source; null has one that no other has."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def with_blocks(docs: DataFrame, block_chars: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Rows of (doc_id, source, key, hash, chars, block, within), and totals by key; texts are read for their length only."""
    slim = docs.select(
        "doc_id", "source", _source().alias("key"), F.xxhash64("doc_id", F.lit(SEED)).alias("hash"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
    ).withColumn("bucket", F.pmod(F.shiftrightunsigned("hash", 16), F.lit(buckets)))
    slim = cut(slim)
    sums = slim.groupBy("key", "bucket").agg(F.sum("chars").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("before", before)  # at most ``buckets`` rows for each source
    order = Window.partitionBy("key", "bucket").orderBy("hash", "doc_id", "chars").rowsBetween(Window.unboundedPreceding, 0)
    run = slim.withColumn("own", F.sum("chars").over(order) - F.col("chars")).join(offsets.select("key", "bucket", "before"), ["key", "bucket"])
    placed = run.withColumn("at", F.col("before") + F.col("own")).withColumn("block", F.floor(F.col("at") / block_chars))
    totals = slim.groupBy("key").agg(F.sum("chars").alias("chars"))
    return placed.select("doc_id", "source", "key", "bucket", "hash", "chars", "block", (F.col("at") - F.col("block") * block_chars).alias("within")), totals


def shares_by_size(chars: Mapping[str, int], shares: int, power: float) -> dict[str, int]:
    """Shares in proportion to a power of each source's size, one at least."""
    sized = {s: max(1, n) ** power for s, n in chars.items()}
    total = sum(sized.values())
    return {s: max(1, round(shares * x / total)) for s, x in sized.items()}


def mixed(docs: DataFrame, weights: Mapping[str | None, int] | None = None, *, block_chars: int = BLOCK_CHARS, buckets: int = BUCKETS, shares: int = SHARES, power: float = 0.5) -> DataFrame:
    """A row for each of ``docs(doc_id, text, source)``: source, block, slot, released, due, within (its place in the block).

    ``weights``: whole shares by source; without them shares follow ``power`` of the sources' sizes. released and due
    are slots. A document has the slot of its first block; the other blocks of a long one have slots without a row.
    """
    placed, totals = with_blocks(docs, block_chars, buckets)
    placed = cut(placed)
    # Blocks in which no document starts (a long one goes over them) use up slots of their source like any other.
    used = placed.groupBy("key").agg((F.max("block") + 1).alias("used")).join(totals, "key")
    n = F.greatest("used", F.ceil(F.col("chars") / block_chars))
    sized = {r["key"]: (r["n"], r["chars"]) for r in used.select("key", n.alias("n"), "chars").limit(MOST_SOURCES + 1).collect()}  # a row for each source
    numbered = placed.select("key", "block", F.col("block").alias("k")).distinct()
    if len(sized) > MOST_SOURCES:
        raise ValueError(f"{len(sized)} sources, over {MOST_SOURCES}: group them first")
    own = {"null" if s is None else f"={s}": int(k) for s, k in weights.items()} if weights is not None else shares_by_size({s: c for s, (_, c) in sized.items()}, shares, power)
    phases = phases_of({s: n for s, (n, _) in sized.items()}, own)
    spark = docs.sparkSession
    spans = [(s, p.first[s], p.first[s] + (p.end - p.start) // p.period * len(at) + sum(t < (p.end - p.start) % p.period for t in at), p.start, p.period, at) for p in phases for s, at in p.slots.items()]
    spans = spark.createDataFrame(spans, "key string, lo long, hi long, start long, period long, slots array<int>")
    met = numbered.join(F.broadcast(spans), (numbered["key"] == spans["key"]) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi"))).drop(spans["key"])
    i, n = F.col("k") - F.col("lo"), F.size("slots")
    met = met.select(
        "key", "block", "k", (F.col("start") + F.floor(i / n) * F.col("period") + F.element_at("slots", (i % n + 1).cast("int"))).alias("slot"),
        (F.col("start") + F.floor(i * F.col("period") / n)).alias("released"), (F.col("start") + F.ceil((i + 1) * F.col("period") / n)).alias("due"),
    )
    return placed.join(met, ["key", "block"]).select("doc_id", "source", F.col("k").alias("block"), "slot", "released", "due", "within", "hash", "chars")


def with_place(docs: DataFrame, column: str, weights: Mapping[str | None, int] | None = None, **options: float) -> DataFrame:
    """The rows of ``docs``, all of them, and a struct of (slot, within, hash).

    Rows that repeat an id, source and length have one place, that of the first of them, so no row is lost or doubled.
    """
    order = mixed(docs, weights, **options).groupBy("doc_id", "source", "chars").agg(F.min(F.struct("slot", "within", "hash")).alias("place"))
    on = docs["doc_id"].eqNullSafe(order["doc_id"]) & docs["source"].eqNullSafe(order["source"]) & (F.coalesce(F.length(docs["text"]), F.lit(0)) == order["chars"])
    return docs.join(order, on).select(*[docs[c] for c in docs.columns], order["place"].alias(column))


def in_mixed_order(docs: DataFrame, weights: Mapping[str | None, int] | None = None, **options: float) -> DataFrame:
    """The rows of ``docs``, all of them, sorted by slot and place in the block: files follow the schedule."""
    place = fresh(docs, "place")
    return with_place(docs, place, weights, **options).orderBy(place, "doc_id").select(*docs.columns)
