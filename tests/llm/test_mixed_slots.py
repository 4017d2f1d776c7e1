"""Slots of the mixed order: of long documents, and of the pipeline's rows after a reread."""

from collections import Counter

import corpus_pipeline as C
from fieldgrid.llm import mixing
from fieldgrid.llm.common import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_of_the_last_stage_have_their_slots(spark):
    rows = [(i, f"w{i} " * 400, "en", f"s{i % 7 % 3}", 1) for i in range(700)]
    docs = cut(mixing.in_mixed_order(spark.createDataFrame(rows, DOCS)))
    want = {r.doc_id: (r.slot, r.within) for r in mixing.mixed(docs).collect()}
    out = cut(C.bpe_stage(spark, docs, "")).collect()
    assert {r.doc_id: (r.slot, r.within) for r in out} == want and len(out) == len(rows)
    chars = {s: sum(len(t) for _, t, _, x, _ in rows if x == s) for s in ("s0", "s1", "s2")}
    shares = mixing.shares_by_size(chars, mixing.SHARES, 0.5)
    slots = {r.slot: r.source for r in out}
    end = min(max(t for t, s in slots.items() if s == x) for x in chars)
    for t in range(end + 1):
        held = Counter(slots[k] for k in range(t + 1))
        assert all(abs(held[s] - (t + 1) * k / sum(shares.values())) < 1 for s, k in shares.items())


def test_long_documents_use_up_their_slots(spark):
    rows = [(i, "x" * 10_000, "en", "long", 1) for i in range(40)] + [(100 + i, "y" * 250, "en", "short", 1) for i in range(1600)]
    got = mixing.mixed(spark.createDataFrame(rows, DOCS), {"long": 1, "short": 1}, block_chars=1000, buckets=8).orderBy("slot", "within", "doc_id").collect()
    assert len(got) == len(rows) and all(r.released <= r.slot < r.due for r in got)
    chars = Counter()
    for r in got:
        assert abs(chars["long"] - r.slot / 2 * 1000) < 11_000 and abs(chars["short"] - r.slot / 2 * 1000) < 2000
        chars[r.source] += r.chars
    assert chars["long"] == chars["short"] == 400_000
