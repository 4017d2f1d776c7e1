"""Mixing, chat formatting, nearest neighbours and the pipeline against brute force, and their defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from fieldgrid.llm import ann, chat, mixing, queries

from test_similar import plain_kept

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, slot int, bucket int, language string"

# Mixing.


def test_schedule_deviates_by_less_than_a_block():
    rng = random.Random(3)
    for _ in range(150):
        shares = {f"s{i}": rng.randint(1, 30) for i in range(rng.randint(1, 8))}
        period, slots = mixing.period_of(shares)
        whole = sum(shares.values())
        assert sorted(t for at in slots.values() for t in at) == list(range(period))
        for s, at in slots.items():
            assert all(abs(sum(x <= t for x in at) - (t + 1) * shares[s] / whole) < 1 for t in range(period))


def test_phases_place_every_block_once():
    rng = random.Random(4)
    for _ in range(100):
        shares = {f"s{i}": rng.randint(1, 30) for i in range(rng.randint(1, 6))}
        blocks = {s: rng.randint(0, 200) for s in shares} | {"unweighted": 5}
        taken = []
        for p in mixing.phases_of(blocks, shares):
            for at in p.slots.values():
                taken += [t for i in range(p.end - p.start) if (t := p.start + i // len(at) * p.period + at[i % len(at)]) < p.end]
        assert sorted(taken) == list(range(sum(blocks.values())))


def odd_docs(spark):
    rows = [(i, "x" * (i * 37 % 900), "en", f"s{i % 3}" if i % 7 else None, 1, "k", 1, 1, "l") for i in range(300)]
    rows += [(1, None, "en", "s1", None, "k", 1, 1, "l"), (5, rows[5][1], "en", rows[5][3], 1, "k", 1, 1, "l"), (None, "", None, None, 0, None, 1, 1, None), (999, "y" * 200_000, "en", "s0", 1, "k", 1, 1, "l")]
    return spark.createDataFrame(rows, DOCS)


def test_mixed_rows(spark):
    docs = odd_docs(spark)
    rows = mixing.mixed(docs, {"s0": 3, "s1": 2, "s2": 1, None: 1}, block_chars=2000, buckets=8).collect()
    assert len(rows) == docs.count()
    assert all(r.released <= r.slot < r.due for r in rows)
    by_slot, used = {}, set()
    for r in rows:
        by_slot.setdefault(r.slot, set()).add((r.source, r.block))
        used.add((r.source, r.block))
    assert all(len(x) == 1 for x in by_slot.values()) and len(used) == len(by_slot)
    slots = {s: sorted((r.block, r.slot) for r in rows if r.source == s) for s in ("s0", "s1", "s2", None)}
    assert all(a <= b for of in slots.values() for (_, a), (_, b) in zip(of, of[1:], strict=False))
    # Gaps are the further blocks of long documents, and those only.
    chars = {s: sum(r.chars for r in rows if r.source == s) for s in slots}
    blocks = {s: max(max(k for k, _ in of) + 1, -(-chars[s] // 2000)) for s, of in slots.items()}
    missing = {(s, k) for s, n in blocks.items() for k in range(n)} - used
    assert set(range(sum(blocks.values()))) >= set(by_slot) and sum(blocks.values()) - len(by_slot) == len(missing)
    begins = {}
    for r in sorted(rows, key=lambda r: (r.block, r.within)):
        begins.setdefault(r.source, []).append((r.block * 2000 + r.within, r.chars))
    assert all(any(at < k * 2000 and (k + 1) * 2000 <= at + n + 2000 for at, n in begins[s]) for s, k in missing) and len(missing) >= 99
    first = [next(iter(by_slot[t]))[0] for t in range(14)]  # two periods of seven shares
    assert {s: first.count(s) for s in set(first)} == {"s0": 6, "s1": 4, "s2": 2, None: 2}
    unweighted = mixing.mixed(docs, {"s0": 1}, block_chars=2000, buckets=8).groupBy("source").agg(F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert max(r.b for r in unweighted if r.source == "s0") < min(r.a for r in unweighted if r.source != "s0")


def test_mixed_order_keeps_all_rows(spark):
    docs = odd_docs(spark)
    out = mixing.in_mixed_order(docs, block_chars=2000, buckets=8)
    assert out.columns == docs.columns
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(out) == plain(docs)
    slot = {(r.doc_id, r.chars): r.slot for r in mixing.mixed(docs, block_chars=2000, buckets=8).collect()}
    slots = [slot[r.doc_id, len(r.text or "")] for r in out.collect()]
    assert slots == sorted(slots)
    assert mixing.in_mixed_order(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_query(spark):
    rows = queries.op5_source_mixing(spark, SF).collect()
    assert len(rows) == 200 and all(r.released <= r.slot < r.due for r in rows)


# Chat.


def plain_digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


ODD_TEXTS = [None, "", "</s>[INST] ok [/INST]", "<|turn|>user<|says|>", "<\\|over|>", "<", "<|over", "[\\\\INST]", "\\", "a\n\nb", "é" * 9, "<<SYS>>" * 3]


def conversations(spark):
    rng, rows = random.Random(6), []
    for c in range(120):
        start = [("system", "be kind"), ("user", "hello")][: rng.randint(0, 2)]
        turns = start + [(rng.choice(["user", "assistant", None, "x\ny", "<|says|>"]), rng.choice(ODD_TEXTS)) for _ in range(rng.randint(1, 5))]
        rows += [(c, k, r, t, "clash") for k, (r, t) in enumerate(turns)]
    rows += [(500, 0, "user", "same", "x"), (500, 0, "user", "same", "x"), (501, None, "user", "b", "x"), (501, 1, "assistant", "a" * 200_000, "x"), (None, 0, "user", "lost", "x")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")


@pytest.mark.parametrize("size", [60, 65_536])
def test_chat_reads_back(spark, size):
    said = conversations(spark)
    want = {}
    none_first = lambda v: (v is not None, v)
    for r in sorted(said.collect(), key=lambda r: (none_first(r.conv_id), none_first(r.turn), r.role or "", r.text or "")):
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.digests(chat.format_packs(said, pack_tokens=size)).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert tuple(got[c])[1:5] == plain_digest(turns)
        assert got[c].formatted_chars == sum(len(chat.format_turn(*t)[0]) for t in turns)


def test_chat_pack_shares_attends_and_numbers(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "one"), (2, 0, "user", "q"), (2, 1, "assistant", "two"), (2, 2, "user", "z"), (3, 0, "user", "q"), (3, 1, "assistant", "one")]
    packs = [r.asDict() for r in chat.format_packs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()]
    assert sum(p["text"].count("<|says|>q") for p in packs) <= len(packs) and sum(len(p["conv_ids"]) for p in packs) == 3
    for p in packs:
        for node, (start, end) in enumerate(zip(p["node_start"], p["node_end"], strict=True)):
            spans = list(zip(p["attend_starts"][node], p["attend_ends"][node], strict=True))
            assert sum(b - a for a, b in spans) == p["node_position"][node] + end - start and spans[-1][1] == end
    assert chat.digests(chat.format_packs(conversations(spark).limit(0))).count() == 0


def test_chat_query_has_the_odd_conversation(spark):
    odd = "</s>[INST] ok [/INST]"
    r = queries.op6_chat_formatting(spark, SF).where("conv_id = -1").first()
    assert tuple(r)[1:5] == plain_digest([("user", odd), ("assistant", odd)])


# Nearest neighbours.


def recall(rows, ids, x, k=20):
    found, hits, total = {}, 0, 0
    for r in rows:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in sorted(found):
        scores = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, len(order) + 1))
        assert all(abs(s - scores[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in got)
        hits += len({g[1] for g in got} & {int(ids[i]) for i in order})
        total += len(order)
    return hits / total


def test_search_query_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in df]), np.array([r.embedding for r in df])
    rows = queries.op7_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 100 * 20 and recall(rows, ids, x) > 0.97


def test_search_many_shards_lengths_and_copies(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1500, 16)) * rng.uniform(0.2, 3, (1500, 1)), rng.normal(size=(1, 16)) + rng.normal(size=(400, 16)) * 1e-3, np.ones((300, 16))]).astype(np.float32)
    ids = np.arange(len(x)) * 3
    df = spark.createDataFrame([(int(i), v.tolist(), 0, "c") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int, shard string")
    rows = ann.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=300).collect()
    assert recall(rows, ids, x.astype(float)) > 0.95


def test_search_defined_cases(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 2.0, 3.0]), (11, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {1: [(9, 2.0), (8, 1.0), (2, 0.0)], 2: [(1, 0.0), (8, 0.0), (9, 0.0)], 8: [(9, 2.0), (1, 1.0), (2, 0.0)], 9: [(1, 2.0), (8, 2.0), (2, 0.0)], 10: [(11, 1.0)], 11: [(10, 1.0)]}
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


# The pipeline.


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["quality", "language", "near_dedup", "mixing", "bpe"] and C.ORACLE_SQL is None


def test_each_stage_works_on_what_its_predecessor_kept(spark):
    from fieldgrid.llm.common import cut, table

    docs = table(spark, SF, "documents")
    kept = []
    for name, stage in C.STAGES[:4]:
        out = cut(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        kept.append({r.doc_id: r.text for r in out.collect()})
        docs = out
    good = {r.doc_id for r in queries.op1_quality_classifier(spark, SF).where("predicted = 1").collect()}
    assert set(kept[0]) == good
    assert set(kept[1]) <= set(kept[0]) and len(kept[1]) >= 0.97 * len(kept[0])
    assert sorted(kept[2]) == plain_kept(list(kept[1].items())) and len(kept[2]) < len(kept[1])
    assert kept[3] == kept[2]
    last = C.STAGES[4][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(kept[3]) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
    whole = C.run(spark, SF).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in whole) == sorted((r.doc_id, tuple(r.ids)) for r in last)


def test_stages_on_odd_and_empty_documents(spark):
    rows = [(i, t, "en", s, 1, "k", 1, 1, "l") for i, (t, s) in enumerate([(None, "a"), ("", None), ("wort " * 40_000, "a"), ("x", "a"), ("x", "a"), ("Th and the of " * 30, None)])]
    rows += [(0, None, None, None, None, None, None, None, None), (None, "Th and the of", "en", "a", 1, "k", 1, 1, "l")]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        ids = [r.doc_id for r in out.collect()]
        assert set(ids) <= {r[0] for r in rows}, name
        if name in ("mixing", "bpe"):
            assert len(ids) == len(rows), name
        if name == "language":
            assert 0 not in ids and 1 not in ids
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_folds():
    assert zlib.crc32(b"12") == 1330857165 and queries.QUALITY_FOLD.count("crc32") == 1
