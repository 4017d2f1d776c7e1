"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, beam-searched by every query.

Vectors are dealt to shards by the size of their largest component, in bands of NORM_BAND powers of two, and in a band
by steps of their norm, then by a hash of their id: so vectors of one shard have norms of one size and single precision keeps them apart. There are
SHARDS shards of a band at most until each has SHARD_MOST vectors, so a query's work grows with the logarithm of the
table up to SHARDS * SHARD_MOST vectors, and beyond that with the number of shards. In a shard, vectors are inserted in batches: a greedy beam search
from the entry points proposes neighbours, robust pruning keeps an edge only if no kept neighbour is nearer to the
candidate by more than the relaxation, and kept edges are added in reverse and pruned again. A second pass refines the
graph. A shard has a graph for each step of norm. Each query searches each graph that can still better its results
with a beam, wider for larger graphs; the shards' results are merged by exact score.

Nearness is the inner product. Indexed vectors, scaled to the graph's largest norm, get one more component,
sqrt(1 - norm^2), so that all lie on a sphere and the graph's distances order as inner products do; queries, which have
0 there, are ranked by inner product alone. Scores are computed on the original vectors in double precision.

Rows reach a shard's task sorted, vectors first, queries after them in blocks: the task holds one shard and one block.
Equal vectors in a shard are one node, with the ids that can be among the nearest.

Defined cases: null, empty and zero vectors, vectors with a null or non-finite component, and rows without id take no
part; a table with vectors of several lengths is searched within each length; with k candidates or fewer all of them
are found, as the entry points then cover the shard; ties go to the smaller id; a repeated id is found once, with its
best score, and asks once, with its least vector; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

K = 20
#: Vectors of a shard, about, while a band has up to SHARDS shards; most vectors of a shard. A task holds one shard.
SHARD_ROWS, SHARDS, SHARD_MOST = 4096, 16, 262_144
NORM_BAND = 4
#: Steps of norm in a power of two: the shards of a band differ by norm, as far as norms do.
NORM_STEPS = 16
DEGREE, BEAM, SEARCH_BEAM, RELAX, ENTRIES = 32, 48, 128, 1.2, 128
#: Vectors that share a graph however their norms differ: all of them are entry points.
FEW = ENTRIES
#: Nodes of a beam that are expanded in one step.
EXPANDED = 4
#: Insertions and queries that are searched in step.
BATCH = 256


class Graph:
    """A directed graph over the rows of ``x``; edges are numbers of rows, -1 where there are fewer."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> None:
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        n = len(x)
        self.degree, self.beam, self.relax = degree, beam, relax
        self.edges = np.full((n, degree), -1, np.int32)
        centre = int(np.argmin(self.norms - 2 * self.x @ self.x.mean(axis=0)))
        spread = np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64)
        self.entries = np.unique(np.append(spread, centre))
        order = np.random.default_rng(0).permutation(n)
        for at in range(2):
            done = 0
            while done < n:
                # The first batches are small: their vectors can't find each other.
                take = min(BATCH, n - done, max(8, done // 4)) if not at else min(BATCH, n - done)
                self._insert(order[done : done + take], 1.0 if not at else relax)
                done += take

    def search(self, queries: np.ndarray, beam: int, *, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Rows and squared distances (less the query's norm) of each query's beam, nearest first; -1 and inf fill it up.

        ``inner``: rank by inner product, as if all rows had one norm.
        """
        q, n, b = np.ascontiguousarray(queries, dtype=np.float32), len(self.x), len(queries)
        norms = np.zeros_like(self.norms) if inner else self.norms
        ids = np.broadcast_to(self.entries, (b, len(self.entries)))
        dist = norms[ids] - 2 * q @ self.x[self.entries].T
        seen = np.zeros((b, n + 1), bool)
        seen[:, self.entries] = True
        seen[:, n] = True
        width = max(beam, len(self.entries))
        ids = np.concatenate([ids, np.full((b, width - ids.shape[1]), -1)], axis=1)
        dist = np.concatenate([dist, np.full((b, width - dist.shape[1]), np.inf, np.float32)], axis=1)
        order = np.argsort(dist, axis=1)
        ids, dist = np.take_along_axis(ids, order, 1)[:, :beam], np.take_along_axis(dist, order, 1)[:, :beam]
        open_ = np.isfinite(dist)
        live = np.arange(b)
        while True:
            has = open_[live].any(axis=1)
            live = live[has]
            if not len(live):
                return ids, dist
            at = np.argsort(~open_[live], axis=1, kind="stable")[:, :EXPANDED]  # the nearest that aren't expanded
            one = live[:, None]
            near = np.where(open_[one, at][:, :, None], self.edges[ids[one, at]], -1).reshape(len(live), -1)
            open_[one, at] = False
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = ~seen[one, near]
            seen[one, near] = True
            near = np.where(fresh, near, -1)
            d = norms[near] - 2 * np.matmul(self.x[near], q[live][:, :, None])[:, :, 0]
            d = np.where(fresh, d, np.inf).astype(np.float32)
            all_ids, all_d = np.concatenate([ids[live], near], axis=1), np.concatenate([dist[live], d], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            keep = np.argsort(all_d, axis=1)[:, :beam]
            ids[live], dist[live] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_d, keep, 1)
            open_[live] = np.take_along_axis(all_open, keep, 1)

    def _insert(self, rows: np.ndarray, relax: float) -> None:
        found, _ = self.search(self.x[rows], self.beam)
        proposed = np.concatenate([found, self.edges[rows]], axis=1)
        self.edges[rows] = self._prune(rows, proposed, relax)
        # The reverse edges: each target takes its new sources, pruned if there are too many.
        to, by = self.edges[rows].ravel(), np.repeat(rows, self.degree)
        by, to = by[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        targets, first, many = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(targets), self.degree + int(many.max(initial=0))), -1, np.int64)
        wide[:, : self.degree] = self.edges[targets]
        wide[np.repeat(np.arange(len(targets)), many), self.degree + np.arange(len(to)) - np.repeat(first, many)] = by
        for at in range(0, len(targets), BATCH):
            self.edges[targets[at : at + BATCH]] = self._prune(targets[at : at + BATCH], wide[at : at + BATCH], relax)

    def _prune(self, rows: np.ndarray, proposed: np.ndarray, relax: float) -> np.ndarray:
        """Robust pruning of each row's proposals: the nearest stays and rules out what is much nearer to it than to the row."""
        p = np.sort(np.where(proposed == rows[:, None], -1, proposed), axis=1)
        p[:, 1:][p[:, 1:] == p[:, :-1]] = -1
        p = p[:, (p >= 0).any(axis=0)]
        out = np.full((len(rows), self.degree), -1, np.int32)
        if not p.shape[1]:
            return out
        own = self.norms[rows][:, None] + self.norms[p] - 2 * np.matmul(self.x[p], self.x[rows][:, :, None])[:, :, 0]
        own = np.where(p >= 0, np.maximum(own, 0), np.inf)
        order = np.argsort(own, axis=1, kind="stable")[:, : 4 * self.degree]
        p, own = np.take_along_axis(p, order, 1), np.take_along_axis(own, order, 1)
        left, r = np.isfinite(own), np.arange(len(rows))
        vectors = self.x[p]
        for j in range(self.degree):
            some = left.any(axis=1)
            if not some.any():
                break
            r = r[some[r]] if len(r) == len(some) else np.flatnonzero(some)
            at = left[r].argmax(axis=1)
            out[r, j] = p[r, at]
            star = vectors[r, at]
            d = self.norms[p[r]] + self.norms[p[r, at]][:, None] - 2 * np.matmul(vectors[r], star[:, :, None])[:, :, 0]
            left[r] &= relax * relax * np.maximum(d, 0) > own[r]
            left[r, at] = False
        return out


class Shard:
    """The graphs of a shard's distinct vectors, one for each run of like norms, and the ids of each vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, node = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        by_node = np.argsort(node, kind="stable")
        self.members = [np.unique(m)[: k + 1] for m in np.split(ids[by_node], np.cumsum(np.bincount(node))[:-1])]  # the smaller ids win ties
        largest = np.abs(self.vectors).max()
        near_one = self.vectors / largest
        norms = np.sqrt(np.einsum("ij,ij->i", near_one, near_one))
        #: (rows, largest norm, graph), by falling norm.
        self.graphs: list[tuple[np.ndarray, float, Graph]] = []
        for rows in like_norms(norms):
            top = norms[rows[0]]
            lift = np.sqrt(np.maximum(1 - (norms[rows] / top) ** 2, 0))
            self.graphs.append((rows, float(top) * float(largest), Graph(np.concatenate([near_one[rows] / top, lift[:, None]], axis=1))))

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query, vector, inner product) of the k best that beam searches find for each query.

        Graphs are searched by falling norm; one is left out only if the product of its largest norm and the query's,
        which no member can exceed, is under the k-th score found.
        """
        near_one = np.concatenate([queries / np.abs(queries).max(axis=1, keepdims=True), np.zeros((len(queries), 1))], axis=1)
        lengths = np.linalg.norm(queries, axis=1)
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        kth = np.full(len(ids), -np.inf)
        for rows, top, graph in self.graphs:
            live = np.flatnonzero(kth <= lengths * top * (1 + 1e-9))
            if not len(live):
                continue
            found, _ = graph.search(near_one[live], max(int(beam * max(1.0, np.sqrt(len(rows) / SHARD_ROWS))), k + 1), inner=True)
            for j, nodes in zip(live.tolist(), found, strict=True):
                best[j] = self._better(best[j], rows[nodes[nodes >= 0]], int(ids[j]), queries[j], k)
                if len(best[j]) == k:
                    kth[j] = best[j][-1][0]
        for q, own in zip(ids.tolist(), best, strict=True):
            for s, m in own:
                yield q, m, s

    def _better(self, had: list[tuple[float, int]], nodes: np.ndarray, query: int, v: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best of ``had`` and the members of ``nodes``, each id once, ties to the smaller id."""
        scores = self.vectors[nodes] @ v
        out: list[tuple[float, int]] = []
        for i in np.argsort(-scores, kind="stable"):
            if len(out) > k and scores[i] < out[k][0]:
                break
            out += [(float(scores[i]), int(m)) for m in self.members[nodes[i]] if m != query]
        best: dict[int, float] = {}
        for s, m in sorted(had + out, key=lambda x: (-x[0], x[1])):
            best.setdefault(m, s)
        return [(s, m) for m, s in list(best.items())[:k]]


def like_norms(norms: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of rows by falling norm: within a step of norms, or FEW rows, all of which are entry points."""
    order = np.argsort(-norms, kind="stable")
    falling, at = -norms[order], 0
    while at < len(order):
        to = max(at + FEW, int(np.searchsorted(falling, falling[at] * 2 ** (-1 / NORM_STEPS), side="right")))
        yield order[at:to]
        at = to


def usable(vector: str) -> Column:
    """Whether a vector takes part: finite components, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = F.col(vector)
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = K, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found among ``vectors(vec_id, embedding)`` for each query, itself excluded.

    Two shuffles: vectors, and queries once for each shard, by shard; k rows for each query and shard by query.
    """
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    largest = F.array_max(F.transform("v", F.abs))
    band = F.concat_ws("/", F.size("v"), F.floor(F.log2(largest) / NORM_BAND)).alias("band")
    # The largest component is carried along: in the lambda itself it would be sought again for each component.
    square = lambda t, x: F.struct(t["by"].alias("by"), (t["sum"] + (x / t["by"]) * (x / t["by"])).alias("sum"))
    norm2 = F.aggregate("v", F.struct(largest.alias("by"), F.lit(0.0).alias("sum")), square, lambda t: t["sum"])
    length = F.log2(largest) + F.log2(norm2) / 2
    step = F.floor(length * NORM_STEPS + 0.5).alias("step")
    rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", as_double(F.col("embedding")).alias("v"))
    counts = rows.select(F.size("v").alias("dim"), band, step).groupBy("dim", "band", "step").agg(F.count("*").alias("n")).orderBy("dim", "band", "step").collect()  # a row for each length and step of norms
    sizes: dict[str, dict] = {}
    for r in counts:
        sizes.setdefault(r["band"], {"dim": r["dim"], "band": r["band"], "n": 0})["n"] += r["n"]
    sizes = list(sizes.values())
    first, many, total = {}, {}, 0
    for r in sizes:
        first[r["band"]], many[r["band"]] = total, max(min(SHARDS, -(-r["n"] // shard_rows)), -(-r["n"] // SHARD_MOST))
        total += many[r["band"]]
    # Shards of a band are runs of steps; a step that several shards share is dealt to them by hash.
    n_of, low, wide, before = {r["band"]: r["n"] for r in sizes}, [], [], {}
    for r in counts:
        b, name = r["band"], F.lit(f"{r['band']}/{r['step']}")
        low += [name, F.lit(before.get(b, 0) * many[b] / n_of[b])]
        wide += [name, F.lit(r["n"] * many[b] / n_of[b])]
        before[b] = before.get(b, 0) + r["n"]
    entries = [F.lit(x) for b in first for x in (b, first[b])] or [F.lit(""), F.lit(0)]
    start, number = F.create_map(*entries), F.create_map(*[F.lit(x) for b in many for x in (b, many[b])] or [F.lit(""), F.lit(1)])
    at, share = F.create_map(*low or [F.lit(""), F.lit(0.0)]), F.create_map(*wide or [F.lit(""), F.lit(1.0)])
    name, part = F.concat_ws("/", "band", "step"), F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / (1 << 20)
    own = F.least(F.floor(at[name] + share[name] * part), number[F.col("band")] - 1)
    dealt = rows.select("*", band, step).select((start[F.col("band")] + own).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    of_dim: dict[int, list[int]] = {}
    for r in sizes:
        of_dim.setdefault(r["dim"], []).extend(range(first[r["band"]], first[r["band"]] + many[r["band"]]))
    shards_of = F.create_map(*[x for d, own in of_dim.items() for x in (F.lit(d), F.array(*map(F.lit, own)))] or [F.lit(0), F.array(F.lit(0))])
    asked = queries.where(usable("embedding") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(as_double(F.col("embedding"))).alias("v"))
    asked = asked.select(F.explode(shards_of[F.size("v")]).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, now = None, None
        held: list[pd.DataFrame] = []
        for b in batches:
            for number, part in b.groupby("shard", sort=True):
                if number != now:
                    shard, now, held = None, number, []
                asks = part["asks"].to_numpy()
                if (~asks).any():
                    held.append(part[~asks])
                if not asks.any():
                    continue
                if shard is None and held:
                    whole = pd.concat(held)
                    x = np.stack(whole["v"].to_numpy())
                    shard, held = Shard(whole["vec_id"].to_numpy(), x, k), []
                if shard is None:
                    continue
                q = part[asks]
                for at in range(0, len(q), BATCH):
                    some = q.iloc[at : at + BATCH]
                    yield pd.DataFrame(list(shard.nearest(some["vec_id"].to_numpy(), np.stack(some["v"].to_numpy()), k, beam)), columns=["query_id", "vec_id", "score"])

    sorted_rows = dealt.unionByName(asked).repartitionById(max(1, total), F.col("shard")).sortWithinPartitions("shard", "asks", "vec_id")
    found = cut(sorted_rows.mapInPandas(work, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
