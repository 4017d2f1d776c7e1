"""The conversation prefix trie against a plain one, and defined cases."""

import hashlib
import random
import zlib

import pytest

from fieldgrid.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string"


def plain(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(base, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    below = {p: [] for p in members}
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    kids = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in members}
    tokens = lambda p: len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in below[p]), sum((len(members[q]) - 1) * tokens(q) for q in below[p]), hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in trie.trie(df).collect()))


def given(spark, rows):
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain(spark, seed):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-250, 600), 220):
        rows += [(c, k, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é\n", "", None])) for k in range(rng.choice([1, 2, 3, 6, 7, 9]))]
    assert found(given(spark, rows)) == plain(rows)


def test_hot_conversation_and_ties(spark):
    rows = [(c, k, "user", f"turn {k}") for c in range(0, 900, 3) for k in range(4)]  # one path for all
    rows += [(50, None, None, None), (50, None, None, None), (50, None, "user", "x"), (50, 0, "b", "same"), (50, 0, "a", "same"), (50, 0, "a", "z" * 100_000)]
    rows += [(100, k, "user", "long " * (k % 3)) for k in range(400)]
    rows += [(None, 0, "user", "lost"), (701, 0, "user", "alone")]
    assert found(given(spark, rows)) == plain(rows)


def test_pieces_join_to_one_digest(spark, monkeypatch):
    """Ids of a node meet by pieces: of so many conversations, one piece holds a third at most."""
    rows = [(c * 100, 0, "user", "same") for c in range(12_000)]
    got = found(given(spark, rows))
    assert got == plain(rows) and len(got) == 2


def test_small_inputs(spark):
    assert found(given(spark, [])) == []
    assert found(given(spark, [(None, 0, "a", "b")])) == []
    for c in range(1, 8):  # some are turnless: no base, and fewer turns than they give up
        assert found(given(spark, [(c, 0, "a", "b")])) == plain([(c, 0, "a", "b")])


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    got = queries.op13_prefix_trie(spark, "/root/testdata/sf0.01")
    assert sorted(tuple(r[n] for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in got.collect()) == plain(rows)
