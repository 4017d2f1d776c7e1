"""Vector codes against plain rounds with whole scans, and defined cases."""

import hashlib
import math

import numpy as np
import pytest

from fieldgrid.llm import codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int, ints int, code string"


def plain(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """rows: (vec_id, label, integers). (vec_id, code, error, label_error) of each, and the digest."""
    x = np.array([v for _, _, v in rows], object).reshape(len(rows), parts, -1)
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2])):
        if rows[i][0] is not None or not first:
            first.setdefault(rows[i][0], i)
    at = list(first.values())[:entries]
    books = [[list(x[i, p]) for i in at] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for turn in range(rounds + 1):
        found = [[near(v, books[p]) for p, v in enumerate(own)] for own in x]
        if turn < rounds:
            for p in range(parts):
                for k in range(len(at)):
                    own = [x[i, p] for i in range(len(rows)) if found[i][p][1] == k]
                    if own:
                        books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, label, _), e in zip(rows, error, strict=True):
        by[label] = by.get(label, 0) + e
    out = [(r[0], "".join(f"{k:02x}" for _, k in f), e, by[r[1]]) for r, f, e in zip(rows, found, error, strict=True)]
    return sorted(out, key=repr), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def coded(df, **options):
    out, book = codes.codes(df, **options)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.with_label_error(out).collect()), key=repr), book and book.digest()


@pytest.mark.parametrize("seed,spread", [(1, 0.2), (2, 0.01), (3, 100.0)])
def test_codes_equal_plain_rounds(spark, seed, spread):
    """A small spread has many ties and equal entries."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(300, 32)) * spread, 3).astype(np.float32)
    x[200:260] = x[:60]
    rows = [(int(i) * 3, v.tolist(), int(i) % 4 or None, 0, "c") for i, v in enumerate(x)]
    want = plain([(i, label, [math.floor(256 * c) for c in v]) for i, v, label, *_ in rows])
    assert coded(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want


def test_bounds_spare_scans_and_change_nothing(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(64, 64))
    x = np.concatenate([centres, centres[rng.integers(0, 64, 2000)] + rng.normal(size=(2000, 64)) * 0.05]).astype(np.float32)
    df = spark.createDataFrame([(int(i), v.tolist(), 1, 0, "c") for i, v in enumerate(x)], SCHEMA)
    out, book = codes.codes(df)
    got = out.collect()
    assert 0 < sum(r.scanned for r in got) < 0.1 * 16 * len(x)
    ints = {i: np.floor(v.astype(float) * 256).astype(np.int64).reshape(16, 4) for i, v in enumerate(x)}
    for r in got:
        d = ((ints[r.vec_id][:, None] - book.entries) ** 2).sum(2)
        assert bytes.fromhex(r.code) == bytes(d.argmin(1).tolist()) and r.error == d.min(1).sum()


def test_rounded_bounds_hold(spark):
    rng = np.random.default_rng(8)
    for _ in range(20):
        x, a, b = (rng.integers(-1000, 1000, (64, 1, 3)) for _ in range(3))
        d = lambda p, q: ((p - q) ** 2).sum(2)
        assert (codes._out(d(x, a), 1).astype(float) ** 2 >= d(x, a)).all() and (codes._out(d(x, a), -1).astype(float) ** 2 <= d(x, a)).all()
        assert (codes._out(d(x, a), 1) + codes._out(d(a, b), 1) >= np.sqrt(d(x, b))).all()


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5] * 16
    rows = [(5, v, 1), (5, v, 1), (5, [0.25] * 16, 1), (7, [1.0] * 16, None), (None, [-0.001] * 16, None), (8, None, 1), (9, [], 1), (10, [nan] + v[1:], 1), (11, [inf] + v[1:], 1), (12, [None] + v[1:], 1), (13, [1.0] * 15, 1), (14, [1.0] * 32, 1), (15, [3e38] * 16, 2)]
    df = spark.createDataFrame([(i, x, label, 0, "c") for i, x, label in rows], SCHEMA)
    kept = [(i, label, [min(max(math.floor(256 * c), -codes.MOST), codes.MOST) for c in x]) for i, x, label in rows if x and len(x) == 16 and all(c is not None and math.isfinite(c) for c in x)]
    assert len(kept) == 6 and coded(df) == plain(kept)
    assert coded(df.limit(0)) == ([], None) and coded(df.where("embedding is null")) == ([], None)
    only = df.where("vec_id is null")
    assert [r[1:3] for r in coded(only)[0]] == [("00" * 16, 0)]
    text = df.withColumn("label", df.label.cast("string"))
    assert coded(text)[1] == coded(df)[1]


def test_query(spark):
    rows = queries.op12_vector_codes(spark, "/root/testdata/sf0.001").collect()
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    want, digest = plain([(r.vec_id, r.label, [math.floor(256 * c) for c in r.embedding]) for r in source][:500])
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in rows), key=repr) == want and {r.codebooks_sha256 for r in rows} == {digest}
