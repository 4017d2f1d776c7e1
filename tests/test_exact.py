"""Operators that have no SQL, or more than a query shows, against plain versions of themselves."""

import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldgrid.operators import blocks, forests, learning, neighbours, regions, spectra, stacks
from fieldgrid.session import STATE_STORE
from fieldgrid.streaming import observations as O


def vectors(spark, n, seed, d=5):
    x = np.random.default_rng(seed).normal(size=(n, d)).round(2)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("block", [7, 1024])
def test_two_nearest_of_blocks(spark, block):
    (x, a), (y, b) = vectors(spark, 60, 1), vectors(spark, 45, 2)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)).round(9)
    got = {(r.side, r.id, r.rank): (r.other, r.d) for r in blocks.two_nearest(a, b, "id", "v", block).collect()}
    for side, m in (("l", d), ("r", d.T)):
        for i, row in enumerate(m):
            order = np.lexsort((np.arange(len(row)), row))[:2]
            assert [got[side, i, k + 1] for k in range(2)] == [(j, row[j]) for j in order]
    assert blocks.two_nearest(a.limit(0), b, "id", "v").count() == 0


def test_medoids_are_exact(spark):
    x, df = vectors(spark, 150, 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    medoids = [0, 1, 2]
    while True:
        own = np.array([min(medoids, key=lambda m, i=i: (round(d[i, m], 9), m)) for i in range(len(x))])
        new = sorted(min(np.flatnonzero(own == m), key=lambda c, m=m: (round(d[c, own == m].sum(), 9), c)) for m in medoids)
        if new == sorted(medoids):
            break
        medoids = [int(m) for m in new]
    got = {r.id: r.medoid for r in learning.pam(df, "id", "v", 3).collect()}
    assert got == {i: int(m) for i, m in enumerate(own)}
    sums = blocks.distance_sums(df.withColumn("g", F.col("id") % 2), "g", "id", "v", 16).collect()
    assert all(r.cost == pytest.approx(d[r.id, r.g :: 2].sum()) for r in sums) and len(sums) == 150


def test_nearest_on_a_line(spark):
    rng = random.Random(4)
    cells = [(i, rng.choice([0.0, rng.gauss(0, 50), 1e6])) for i in range(300)]
    stations = [(i, rng.choice([0.0, rng.gauss(0, 3), rng.gauss(100, 40)])) for i in range(80)]
    a, b = spark.createDataFrame(cells, "c long, x double"), spark.createDataFrame(stations, "s long, y double")
    for n in (80, 2, 1):
        got = neighbours.nearest(a, b.where(f"s < {n}"), ["c"], [F.col("x")], [F.col("y")], F.abs(F.col("x") - F.col("y")), "s", 3)
        found = {(r.c, r.r): r.s for r in got.collect()}
        want = {(c, k + 1): s for c, x in cells for k, (_, s) in enumerate(sorted((round(abs(x - y), 6), s) for s, y in stations[:n])[:3])}
        assert found == want
    assert neighbours.nearest(a, b.limit(0), ["c"], [F.col("x")], [F.col("y")], F.lit(0.0), "s", 3).count() == 0


def test_sieve_follows_chains(spark):
    line = [9] * 6 + [1, 1, 1] + [2, 2] + [3] + [4]  # 4 leads to 3, 3 to 2, 2 to 1, 1 to 9
    df = spark.createDataFrame([(0, c, v) for c, v in enumerate(line)], "row long, col long, v int")
    assert [r.v for r in regions.sieve(df, "v", 5).orderBy("col").collect()] == [9] * 13
    assert [r.v for r in regions.sieve(df, "v", 3).orderBy("col").collect()] == [9] * 6 + [1] * 7
    assert [r.v for r in regions.sieve(df.where("col > 8"), "v", 9).orderBy("col").collect()] == [2, 2, 3, 4]


def plain_tree(x, y, w=None, features=None, depth=None):
    """Nested (feature, threshold, left, right) or a label, by exact fractions."""
    w, features = np.ones(len(y), int) if w is None else w, range(x.shape[1]) if features is None else features
    votes = {int(k): int(w[y == k].sum()) for k in sorted(set(y[w > 0].tolist()))}
    top, n, squares = max(votes, key=lambda k: (votes[k], -k)), sum(votes.values()), sum(v * v for v in votes.values())
    best = None
    if len(votes) > 1 and n > 1 and depth != 0:
        for f in features:
            for t in sorted(set(x[w > 0, f].tolist()))[1:]:
                right = x[:, f] >= t
                sides = [[int(w[s & (y == k)].sum()) for k in votes] for s in (right, ~right)]
                score = sum(Fraction(sum(v * v for v in side), sum(side)) for side in sides)
                if score > Fraction(squares, n) and (best is None or score > best[0]):
                    best = score, f, t, right
    if best is None:
        return top
    _, f, t, right = best
    below = None if depth is None else depth - 1
    return f, t, plain_tree(x[~right], y[~right], w[~right], features, below), plain_tree(x[right], y[right], w[right], features, below)


def nested(nodes, features, at=0):
    n = {n[0]: n for n in nodes}[at]
    return n[5] if n[1] is None else (features.index(n[1]), n[2], nested(nodes, features, n[3]), nested(nodes, features, n[4]))


def noisy(spark, n=300):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(n, 3))
    y = (x[:, 0] > 5) + 2 * (x[:, 1] + x[:, 2] > 11) + (rng.random(n) < 0.1)
    return x, y, spark.createDataFrame([(i, *map(int, r), int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "id long, a int, b int, c int, y int")


@pytest.mark.parametrize("small,depth", [(4096, None), (60, None), (60, 3), (4096, 3)])
def test_tree_of_exhaustive_splits(spark, small, depth):
    """In one task, and level by level with tasks for small nodes at the end: without a limit of depth, and with one."""
    x, y, df = noisy(spark)
    (nodes,) = forests.grow(df, ["a", "b", "c"], "y", depth=depth, small=small)
    assert nested(nodes, ["a", "b", "c"]) == plain_tree(x, y, depth=depth)
    got = {r.id: r.p for r in forests.predict(df, [nodes], "p").collect()}

    def walk(t, row):
        while isinstance(t, tuple):
            t = t[3] if row[t[0]] >= t[1] else t[2]
        return t

    assert got == {i: walk(plain_tree(x, y, depth=depth), row) for i, row in enumerate(x)}


@pytest.mark.parametrize("small", [4096, 50])
def test_forest_equals_plain_trees(spark, small):
    x, y, df = noisy(spark, 200)
    trees = forests.grow(df, ["a", "b", "c"], "y", 4, bootstrap=True, subset=2, small=small)
    weights = df.select("id", F.array(*(forests._weight(F.xxhash64(*df.columns), k, 42) for k in range(4))).alias("w")).orderBy("id").collect()
    w = np.array([r.w for r in weights])
    assert 0.8 < w.mean() < 1.2 and 0.2 < (w == 0).mean() < 0.55
    import random as R

    for k, nodes in enumerate(trees):
        chosen = sorted(R.Random(42 + k).sample(range(3), 2))
        assert nested(nodes, ["a", "b", "c"]) == plain_tree(x, y, w[:, k], chosen)
    votes = forests.predict(df, [*trees, [(0, None, None, None, None, 99)]], "p").collect()
    assert all(r.p != 99 for r in votes) and np.mean([r.p == r.y for r in votes]) > 0.8
    by_nested_when = [{r.id: r.p for r in df.select("id", learning.tree_predict(df, t).alias("p")).collect()} for t in trees]
    for r in votes:
        said = [b[r.id] for b in by_nested_when] + [99]
        assert r.p == min(set(said), key=lambda v: (-said.count(v), v))


def test_trees_of_odd_samples(spark):
    rows = [(0, 1.0, 2, "b"), (1, None, 2, "a"), (2, 3.0, 2, None), (3, 1.0, 2, "a")]
    df = spark.createDataFrame(rows, "id long, a double, b int, y string")
    assert forests.grow(df, ["a", "b"], "y") == [[(0, None, None, None, None, "a")]]  # a tie; no split
    assert forests.predict(df, [[(0, None, None, None, None, "a")]], "p").select("p").distinct().collect()[0].p == "a"
    assert forests.grow(df.limit(0), ["a", "b"], "y") == [[]]


def test_quadratic_spline_passes_through_samples_and_keeps_parabolas(spark):
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.uniform(0.5, 3, 40))
    at = np.linspace(x[0], x[-1], 500)
    assert np.allclose(spectra.quadratic(x, 3 - 2 * x + 0.5 * x * x, at), 3 - 2 * at + 0.5 * at * at)
    y = rng.normal(size=40)
    assert np.allclose(spectra.quadratic(x, y, x), y)
    fine = spectra.quadratic(x, y, at)
    slope = np.diff(fine) / np.diff(at)  # one slope from piece to piece: no jumps
    assert np.abs(np.diff(slope)).max() < 0.2 * np.abs(slope).max()
    odd = spark.createDataFrame([(1, 400.0, 0.5), (1, 400.0, 1.5), (2, None, 1.0), (3, 400.0, None)], "band int, wavelength double, response double")
    assert {(r.band, r.wavelength, r.response) for r in spectra.at_even_steps(odd, "band", 400.0, 402.0).collect() if r.response is not None} == {(1, 400.0, 1.0)}


def test_least_squares_of_three_variables(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 3))
    y = 1.5 - 2 * x[:, 0] + 0.25 * x[:, 1] + 3 * x[:, 2] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(k)) for r, k in zip(x, y, strict=True)], "a double, b double, c double, y double")
    got = [r.coefficient for r in stacks.normal_equations(df, ["a", "b", "c"], "y").collect()]
    assert np.allclose(got, np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0])
    assert stacks.normal_equations(df.limit(0), ["a"], "y").count() == 0


def test_upsert_stream_over_three_batches(spark, tmp_path):
    source, out, check = (str(tmp_path / k) for k in ("in", "out", "check"))
    want = {}
    for k in range(3):
        rows = [(u, 100 * k + u, float(k)) for u in range(k * 5, 40, k + 1)]
        want |= {u: (t, v) for u, t, v in rows}
        spark.createDataFrame(rows, "user_id long, t long, value double").select("user_id", F.timestamp_seconds("t").alias("ts"), "value").write.mode("append").parquet(source)
        s = O.observations(spark, source, "user_id long, ts timestamp, value double")
        O.upsert_into(s, out, ["user_id"], "ts", check).awaitTermination()
        got = O.latest(spark, out).select("user_id", F.unix_timestamp("ts").alias("t"), "value").collect()
        assert sorted((r.user_id, r.t, r.value) for r in got) == sorted((u, *x) for u, x in want.items())


def test_upsert_streams_of_two_checkpoints_lose_nothing(spark, tmp_path):
    """Twenty keys of one checkpoint, twenty of another, then both again: forty keys, each by its latest version."""
    out, want = str(tmp_path / "out"), {}
    schema = "user_id long, ts timestamp, value double"

    def send(name, rows):
        source = str(tmp_path / name)
        nonlocal want
        for u, t, v in rows:
            want[u] = max(want.get(u, (0, 0.0)), (t, v))
        spark.createDataFrame(rows, "user_id long, t long, value double").select("user_id", F.timestamp_seconds("t").alias("ts"), "value").write.mode("append").parquet(source)
        O.upsert_into(O.observations(spark, source, schema), out, ["user_id"], "ts", str(tmp_path / f"check-{name}")).awaitTermination()
        got = O.latest(spark, out).select("user_id", F.unix_timestamp("ts").alias("t"), "value").collect()
        assert sorted((r.user_id, r.t, r.value) for r in got) == sorted((u, *x) for u, x in want.items())

    send("a", [(u, 100, 1.0) for u in range(20)])
    send("b", [(u, 100, 2.0) for u in range(20, 40)])
    assert len(want) == 40
    send("a", [(u, 200 + u, 3.0) for u in range(10, 30)])
    send("b", [(u, 150, 4.0) for u in range(0, 40, 3)] + [(5, 150, 1.0), (5, 150, 9.0)])  # equal versions: the larger
    kept = [f for f in (tmp_path / "out").glob("bucket=*/generation=*")]
    assert max(sum(f.parent == b for f in kept) for b in {f.parent for f in kept}) <= 2


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(u, 10 * k + u, float(k)) for u in range(k, 20)], "user_id long, t long, value double").select("user_id", F.timestamp_seconds("t").alias("ts"), "value").write.mode("append").parquet(source)
        O.upsert_into(O.observations(spark, source, "user_id long, ts timestamp, value double"), out, ["user_id"], "ts", str(tmp_path / "check")).awaitTermination()
    before = sorted(map(tuple, O.latest(spark, out).collect()))
    (tmp_path / "check" / "commits" / "1").unlink()  # the last batch is not known to have ended
    next(iter((tmp_path / "check" / "commits").glob(".1*"))).unlink()
    O.upsert_into(O.observations(spark, source, "user_id long, ts timestamp, value double"), out, ["user_id"], "ts", str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, O.latest(spark, out).collect())) == before and len(list((tmp_path / "out" / "_generations").iterdir())) == 2


def test_state_runs_in_event_time(spark, tmp_path):
    """Three batches with a late row, rows out of order, a run that only the watermark closes, and one that a gap ends."""
    source, out, check = (str(tmp_path / k) for k in ("in", "out", "check"))
    spark.conf.set(*STATE_STORE)
    h = 3600
    batches = [
        [(1, 10, 7, "a"), (2, 30, 7, "b"), (3, 20, 7, "a"), (4, 5, 8, "x")],
        [(5, 10 * h, 7, "b"), (6, 10 * h - 50, 7, "c"), (None, 10 * h - 50, 7, "c")],  # the watermark passes the first batch only after this one
        [(7, 15, 7, "z"), (8, 10 * h + 5, 7, "b"), (9, 40 * h, 9, "q")],  # 15 is late
        [(10, 80 * h, 9, "q")],
    ]
    for rows in batches:
        spark.createDataFrame([(i, u, s, t) for i, t, u, s in rows], "event_id long, user_id long, event_type string, t long").select("event_id", "user_id", "event_type", F.timestamp_seconds("t").alias("ts")).write.mode("append").parquet(source)
        O.run_available(O.state_runs(O.observations(spark, source, "event_id long, user_id long, event_type string, ts timestamp"), idle=6 * h), out, check)
    got = sorted((r.user_id, r.state, r.start, r.last, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(7, "a", 10, 20, 2), (7, "b", 30, 30, 1), (7, "b", 10 * h, 10 * h + 5, 2), (7, "c", 10 * h - 50, 10 * h - 50, 2), (8, "x", 5, 5, 1), (9, "q", 40 * h, 40 * h, 1)]


def test_state_runs_set_one_timer_a_key():
    """Rows in and out of order: a key has a timer at its earliest row, and none for each row."""
    import pandas as pd

    class State:
        value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value
        clear = lambda self: self.update(None)
        put = lambda self, v: self.update(v)
        appendList = lambda self, v: self.update([*(self.value or []), *v])  # noqa: E731, N815

        def update(self, value):
            self.value = value

    class Handle:
        timers: list = []

        getValueState = getListState = lambda self, *_: State()  # noqa: E731, N815
        registerTimer = lambda self, ms: self.timers.append(ms)  # noqa: E731, N815

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    runs, rows = O.StateRuns(10.0), pd.DataFrame({"ms": range(1000, 2000), "event_id": range(1000), "event_type": ["a"] * 500 + ["b"] * 500})
    runs.init(Handle())
    list(runs.handleInputRows((1,), iter([rows[500:], rows[:500]]), At(0)))
    assert runs.handle.timers == [1001]
    out = [tuple(r) for f in runs.handleExpiredTimer((1,), At(1900), None) for r in f.itertuples(index=False)]
    assert out == [(1, "a", 1, 1, 500)] and runs.handle.timers == [1001, 1901]
    out = [tuple(r) for f in runs.handleExpiredTimer((1,), At(20_000), None) for r in f.itertuples(index=False)]
    assert out == [(1, "b", 1, 1, 500)] and runs.handle.timers == [1001, 1901] and not runs.due.exists()


def test_a_tree_that_peels_off_few_rows_takes_few_rounds(spark, monkeypatch):
    """Labels without pattern: alike rows count as one, and a node of few different ones is finished at once."""
    df = spark.range(6000).select(F.col("id"), (F.col("id") * 37 % 1500).alias("a"), (F.col("id") * 53 % 900).alias("b"), (F.xxhash64("id") % 2).cast("int").alias("y"))
    many, rounds = df.union(df).union(df), []
    monkeypatch.setattr(forests, "written", lambda d, old=forests.written: rounds.append(1) or old(d))
    (tree,), (same,) = forests.grow(many, ["a", "b"], "y"), forests.grow(df, ["a", "b"], "y")
    assert len(rounds) == 4 and tree == same
    known = {(r.a, r.b): set(r.y) for r in df.groupBy("a", "b").agg(F.collect_set("y").alias("y")).collect()}
    assert all(len(known[r.a, r.b]) > 1 or r.p in known[r.a, r.b] for r in forests.predict(df, [tree], "p").collect())


def test_two_nearest_measure_few_pairs():
    """Copies, near copies and odd values against plain distances; far from all pairs' differences are held at once."""
    import tracemalloc

    rng = np.random.default_rng(3)
    for x, y in ((rng.integers(0, 3, (300, 4)) + 0.0, rng.integers(0, 3, (200, 4)) + 0.0), (1e4 + 1e-6 * rng.random((90, 8)), 1e4 + 1e-6 * rng.random((70, 8))), (np.array([[1.0, np.nan], [np.inf, 0], [0, 0]]), np.array([[0.0, 1], [np.inf, 0], [2, 2]])), (np.zeros((2, 3)), np.ones((1, 3)))):
        with np.errstate(invalid="ignore"):
            d = np.sqrt(((x[:, None] - y) ** 2).sum(2)).round(9)
        want = np.argsort(d, axis=1, kind="stable")[:, :2]
        i, j, found = blocks._two_of(x, y)
        assert i.tolist() == np.repeat(np.arange(len(x)), want.shape[1]).tolist() and j.tolist() == want.ravel().tolist()
        assert np.array_equal(found, d[i, j], equal_nan=True)
    x, y = rng.random((2048, 64)), rng.random((4096, 64))
    tracemalloc.start()
    blocks._two_of(x, y)
    assert tracemalloc.get_traced_memory()[1] < 8 * len(x) * len(y)
    tracemalloc.stop()


def test_distance_sums_deal_vectors_once(spark):
    """Sums over several blocks equal plain ones, and the plan neither joins by equality nor copies vectors to each block."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(120, 5))
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], v[i].tolist()) for i in range(120)], "id long, g string, v array<double>")
    found = blocks.distance_sums(df, "g", "id", "v", 16)
    for r in found.collect():
        same = v[[j for j in range(120) if (j % 3 == 0) == (r.id % 3 == 0)]]
        assert abs(r.cost - np.sqrt(((same - v[r.id]) ** 2).sum(1)).sum()) < 1e-9
    assert found.count() == 120 and "explode" not in found._jdf.queryExecution().toString().lower()
