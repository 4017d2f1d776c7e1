"""Near-duplicates by Jaccard similarity against brute force."""

import random

import numpy as np

import corpus_pipeline as C
from fieldgrid.llm import neardup, similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def planted(seed):
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for n, changes in [(100, 1), (300, 3), (300, 6), (1000, 20), (40, 1), (60, 2), (200, 9)] * 6:
        base = [word() for _ in range(n)]
        rows.append((len(rows), " ".join(base)))
        near = list(base)
        for at in rng.sample(range(n), changes):
            near[at] = word()
        rows.append((len(rows), " ".join(near)))
    passage = [word() for _ in range(60)]
    rows += [(len(rows) + k, " ".join(passage + [word() for _ in range(40)])) for k in range(60)]
    start = len(rows)
    chain = [word() for _ in range(100)]
    for k in range(120):  # each a near copy of the one before, not of the first
        chain[k * 7 % 100] = word()
        rows.append((start + k, " ".join(chain)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \n", "a b", "A  b", "a b c d e", "a b c d f", "x y z " * 5000])]
    return rows


def test_similar_equals_brute_force(spark):
    rows = planted(5)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    want = plain_kept(rows)
    for near in (16, 3):
        kept = sorted(r.doc_id for r in neardup.keep_one_each(docs, similar.similar, near=near).collect())
        assert kept == want, near


def test_stage_drops_near_copies(spark):
    rows = planted(6)[:84]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = sorted(r.doc_id for r in C.near_dedup_stage(spark, docs, "").collect())
    assert kept == plain_kept(rows) and len(kept) < len(neardup.keep_one_each(docs).collect())
    assert C.near_dedup_stage(spark, docs.limit(0), "").count() == 0


def short_texts(seed):
    """Pairs at exactly 0.8 or just above, of 4 to 20 shingles, one longer than the other by a word or changed at an end."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for n in [8, 9, 10, 13, 14, 16, 19, 24] * 60:
        base = [word() for _ in range(n)]
        shingles = n - 4
        rows.append((len(rows), " ".join(base)))
        longer = base + [word() for _ in range(shingles // 4)]
        rows.append((len(rows), " ".join(longer)))
    return rows


def test_short_texts_lose_no_link(spark):
    rows = short_texts(3)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    want = plain_kept(rows)
    assert len(want) == len(rows) // 2
    assert sorted(r.doc_id for r in neardup.keep_one_each(docs, similar.similar).collect()) == want


def test_radius_holds_for_sets_of_every_size():
    rng = np.random.default_rng(1)
    for n in (8, 10, 12, 16, 20, 33, 64, 200):
        for _ in range(300):
            x = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
            cut = int(rng.integers(0, n // 4 + 1))
            a, b = x[: n + cut], np.concatenate([x[:n], x[n + cut :]])
            apart = int(np.unpackbits((similar.fingerprint(a) ^ similar.fingerprint(b)).view(np.uint8)).sum())
            assert apart <= similar.RADIUS, (n, cut, apart)
