"""Operators on texts against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldgrid.llm import bpe, language, licenses, media, neardup, quality, queries, tokens

SF = "/root/testdata/sf0.001"
LONG = "wort " * 60_000
#: Null, empty, blank, very long, repeated texts; columns whose names clash with the operators' own.
ODD = [(1, None), (2, ""), (3, " \n"), (4, LONG), (5, "x"), (5, "x"), (None, "x"), (6, "中文 \U0001f600 !!"), (7, "e" * 30_000)]
EXTRA = "doc_id long, text string, lang string, source string, fp long, key string, score double, language string, ids int, label int, block int"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", 0.5, "x", 3, 1, 0) for i, t in rows], EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Byte-level BPE.

ENC = bpe.encoder(P.path(queries.RANKS), P.PATTERN)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})
PARTS = ["a", "the", "'", " ", "  ", "\n", "'re", "re", "'s", "ll", "1", "22", "é", "中", "!", "?!", " ", "　", "x" * 60, " " * 9, "tion", "\x1c", "²", "Ⅷ", "_", "\U0001f600", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.integers(4, 40), st.integers(2, 12))
def test_bpe_equals_the_library_whatever_the_leaves(parts, chars, size):
    text, own = "".join(parts), ENC
    own.known.clear()
    old = bpe.LEAF_CHARS, bpe.LEAF_BYTES
    bpe.LEAF_CHARS, bpe.LEAF_BYTES = chars, size
    try:
        ids = own.encode(text)
        assert ids == TIK.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES = old


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_bpe_any_text(text):
    assert ENC.encode(text) == TIK.encode_ordinary(text)


def test_bpe_long_pieces():
    rng = random.Random(5)
    for n in (1000, 20_000):
        for letters in ("etaoinshrdlu", "ab", "x"):
            text = "".join(rng.choice(letters) for _ in range(n))
            ids = ENC.encode(text)
            assert ENC.decode(ids) == text.encode() and ids == ENC.merge_long(text.encode())
            if n == 1000:  # the library takes quadratic time
                assert ids == TIK.encode_ordinary(text)


def test_bpe_query(spark):
    out = {r.doc_id: r for r in queries.op8_byte_bpe(spark, SF).collect()}
    for r in documents(spark).collect():
        ids = TIK.encode_ordinary(r.text)
        assert (out[r.doc_id].n_tokens, out[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert out[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_bpe_defined_cases(spark):
    path, pattern = P.path(queries.RANKS), P.PATTERN
    rows = bpe.with_ids(odd(spark), path, pattern).collect()
    assert [r.ids for r in rows] == [TIK.encode_ordinary(t or "") for _, t in ODD]
    back = bpe.with_text(bpe.with_ids(odd(spark), path, pattern), path, pattern, column="back").select("back").collect()
    assert [r.back for r in back] == [t or "" for _, t in ODD]
    assert bpe.with_digests(empty(spark), path, pattern).count() == 0


# Token counts.


def test_scan_stitches_blocks(spark):
    rng, eod, rows, want = random.Random(1), 9, [], []
    for file in range(3):
        ids = [rng.choice([1, 2, 3, eod, 4, 5]) for _ in range(5000)] + [1] * 3000 + [eod, eod] + ([7] * 5 if file else [])
        raw = np.array(ids, "<u2").tobytes()
        rows += [(file, b, bytearray(raw[b * 2 : b * 2 + 2])) for b in range(1100)] + [(file, 1100 + k, bytearray(raw[2200 + k * 64 : 2264 + k * 64])) for k in range(len(raw[2200:]) // 64 + 1)]
        start = 0
        for no, end in enumerate([i for i, x in enumerate(ids) if x == eod]):
            want.append((file, no, start, end - start, True))
            start = end + 1
        if start < len(ids):
            want.append((file, ids.count(eod), start, len(ids) - start, False))
    blocks = spark.createDataFrame(rows, "file int, block long, tokens binary")
    assert sorted(map(tuple, tokens.scan(blocks, eod).collect())) == want


def test_scan_files_and_defined_cases(spark, tmp_path):
    ids = np.array([1, 2, 9, 9, 3], "<u4")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = tokens.file_blocks(spark, str(tmp_path), width=4, block_tokens=2)
    assert sorted((r.doc_no, r.start, r.n_tokens, r.terminated) for r in tokens.scan(blocks, 9, width=4).collect()) == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]
    none = spark.createDataFrame([(0, 0, None), (0, 1, bytearray())], "file int, block long, tokens binary")
    assert tokens.scan(none, 9).count() == 0 and tokens.scan(none.limit(0), 9).count() == 0
    with pytest.raises(Exception, match="whole tokens"):
        tokens.scan(spark.createDataFrame([(0, 0, bytearray(b"abc"))], "file int, block long, tokens binary"), 9).collect()


def test_token_counts(spark):
    out = {r.doc_id: r.n_tokens for r in queries.op2_token_counts(spark, SF).collect()}
    assert out == {r.doc_id: len(TIK.encode_ordinary(r.text)) for r in documents(spark).collect()}
    blocks = tokens.token_blocks(odd(spark).coalesce(1), P.path(queries.RANKS), P.PATTERN, queries.END_OF_DOCUMENT, block_tokens=50)
    from fieldgrid.llm.common import cut

    got = tokens.scan(cut(blocks), queries.END_OF_DOCUMENT, labels="doc_ids").orderBy("doc_no").collect()
    assert [(r.label, r.n_tokens) for r in got] == [(i, len(TIK.encode_ordinary(t or ""))) for i, t in ODD]


# SimHash near-duplicates.


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=3):
    prints, out = [plain_fingerprint(t) for _, t in rows], {}
    for k in range(len(rows)):
        if k in out:
            continue
        group, todo = {k}, [k]
        while todo:
            a = todo.pop()
            new = [b for b in range(len(rows)) if b not in group and (prints[a] ^ prints[b]).bit_count() <= radius]
            group.update(new)
            todo += new
        least = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
        out.update(dict.fromkeys(group, least))
    return [(rows[k][0], prints[k], out[k]) for k in range(len(rows))]


@pytest.mark.parametrize("most", [2048, 8])
def test_near_duplicates_equal_brute_force(spark, most):
    rng, rows = random.Random(2), list(ODD)
    for g in range(25):
        base = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 14)):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = "zz"
            rows.append((100 + len(rows), " ".join(near)))
    got = neardup.near_duplicates(odd(spark, rows), shard_most=most).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = plain_components(rows)
    assert sorted([(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got], key=key) == sorted(want, key=key)
    kept = [r.doc_id for r in neardup.keep_one_each(odd(spark, rows), shard_most=most).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({c for i, _, c in want if i is not None and i == c})


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0 and neardup.keep_one_each(empty(spark)).count() == 0


def test_bk_tree_and_long_chains(spark):
    rng = random.Random(3)
    values = list({rng.getrandbits(20) for _ in range(600)})
    tree = neardup.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 4)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 4]
    chain = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.label for r in neardup.components(chain).collect()} == {0}


def test_near_dup_query_has_hex_digits(spark):
    rows = queries.op3_simhash_near_dedup(spark, SF).collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows) and len(rows) == 200


# License scans.


def plain_scan(text, threshold=licenses.THRESHOLD, size=licenses.BLOCK_WORDS):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, base, own = [], set(), set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    best = 0.0
    for b in range(0, max(1, len(words)), size // 2):
        block = set(words[b : b + size])
        for label, template in licenses.TEMPLATES:
            t = set(template.split())
            if len(t & block) >= math.ceil(threshold * len(t) - 1e-9):
                own.add(label)
                best = max(best, len(t & block) / len(t))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), max(best, 1.0 if starts else 0.0)


def test_license_scan_equals_brute_force(spark):
    rng, rows = random.Random(4), list(ODD)
    for k in range(120):
        label, template = rng.choice(licenses.TEMPLATES)
        words = template.split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = "other"
        noise = lambda: [rng.choice(["the", "of", "MIT", "License", "CC", "BY-NC", "word", "gnu"]) for _ in range(rng.randint(0, 90))]
        rows.append((100 + k, " ".join(noise() + words + noise())))
    rows += [(r.doc_id + 1000, r.text) for r in documents(spark).collect()]
    got = licenses.with_licenses(odd(spark, rows), column="lic").select("lic.*").collect()
    assert [tuple(r)[:7] for r in got] == [plain_scan(t) for _, t in rows]
    assert licenses.with_licenses(empty(spark)).count() == 0


# Media.


def test_media_round_trip(spark):
    texts = [t for _, t in ODD] + ["a" * 64, "a" * 63 + "é", "GIF89a RIFF PK\x03\x04 BM %PDF-1.4"]
    got = media.with_stored(odd(spark, list(enumerate(texts))), "m").select("m.*").collect()
    for t, r in zip(texts, got, strict=True):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.store(t)
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest() and media.load(stored) == payload
        assert r.feature.startswith("audio/wav;") and r.feature.endswith("embedded=none")
    assert media.with_stored(empty(spark)).count() == 0


def samples():
    import gzip
    import io
    import struct
    import zipfile

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "bcd")
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x04ab\xff\xda\0\x04ab\x01\xff\0\x02\xff\xd9"
    gif = bytes.fromhex("47494638396101000100800000000000ffffff2c00000000010001000002024401003b")
    ogg = b"OggS\0\x04" + bytes(20) + b"\x01\x03abc"
    pdf = b"%PDF-1.4\nx\nstartxref\n9\n%%EOF"
    return {"image/png": png, "application/zip": z.getvalue(), "image/bmp": bmp, "image/jpeg": jpeg, "image/gif": gif, "application/gzip": gzip.compress(b"hello" * 999), "audio/ogg": ogg, "application/pdf": pdf, "audio/wav": media.store("hi")}


@pytest.mark.parametrize("kind", sorted(samples()))
def test_media_types_truncation_and_carving(kind):
    value = samples()[kind]
    assert media.sniff(value)[:2] == (kind, len(value))
    assert media.sniff(value[:-1])[0] == "unknown"
    inside = b"GIF89a text " + value + b" BM more"
    assert media.sniff(inside)[2] == [(12, len(value), kind)]


def test_media_columns(spark):
    s = samples()
    rows = [("a", bytearray(s["image/png"]), "image/jpeg"), ("b", bytearray(b"zz" + s["image/gif"] + b"--" + s["image/png"]), "text/plain"), ("c", None, None), ("d", bytearray(), "image/png"), ("e", bytearray(s["image/gif"]), "image/gif")]
    df = media.with_media_type(spark.createDataFrame(rows, "name string, content binary, declared string"))
    assert [(r.media.type, r.media.declared_right, r.media.length) for r in df.orderBy("name").collect()] == [("image/png", False, 67), ("unknown", False, 0), ("unknown", False, 0), ("unknown", False, 0), ("image/gif", True, 35)]
    cuts = media.carved(df).orderBy("start").collect()
    assert [(r.name, r.type, bytes(r.content)) for r in cuts] == [("b", "image/gif", s["image/gif"]), ("b", "image/png", s["image/png"])]


# Language.


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = [r for r in queries.op10_language_id(spark, sf).collect()]
    held = [r for r in out if r.held_out]
    assert len(out) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    old, language.SEGMENT = language.SEGMENT, 4
    try:
        for _ in range(200):
            sizes = rng.integers(0, 14, 5)
            doc = np.repeat(np.arange(5), sizes)
            x = rng.normal(size=(len(doc), 3)).astype(np.float32) * 3
            path = language.best_path(x, doc, 2.0)
            for d in range(5):
                at = np.flatnonzero(doc == d)
                if len(at):
                    best = x[at[0]].astype(float)
                    for t in at[1:]:
                        best = np.maximum(best, best.max() - 2.0) + x[t]
                    value = x[at, path[at]].sum() - 2.0 * (np.diff(path[at]) != 0).sum()
                    assert value == pytest.approx(best.max(), abs=1e-3)
    finally:
        language.SEGMENT = old


def test_language_spans_scripts_and_defined_cases(spark):
    train = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog sat on the mat with them", "en"), ("der hund und die katze auf der matte mit ihnen", "de"), ("кот и собака на ковре", "ru")] * 5)] + [(99, None, "en"), (98, "x", None), (None, "x", "en")]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), "true")
    assert model.languages == ["de", "en", "ru"]
    langs, scores, spans, starts = model.label([None, "", "123 !!", "the cat and the dog", "the cat sat on the mat with them " * 3 + "der hund und die katze auf der matte " * 3, "кот и", "אב"])
    assert langs[:4] == ["und", "und", "und", "en"] and scores[:3] == [0.0] * 3 and langs[5] == "ru"
    assert spans[4] == ["en", "de"] and starts[4] == [0, 24]
    rows = language.with_language(odd(spark), model, "found").select("found.*").collect()
    assert [r.lang for r in rows[:3]] == ["und"] * 3 and len(rows) == len(ODD)
    none = language.fit(empty(spark), "true")
    assert {r.found.lang for r in language.with_language(odd(spark), none, "found").collect()} == {"und"}
    assert language.with_language(empty(spark), model, "found").count() == 0


# Quality.


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op1_quality_classifier(spark, sf).collect()}
    held = [(out[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if out[r.doc_id].held_out]
    assert np.mean([o.predicted == q for o, q in held]) > 0.95
    assert all(0 <= o.score <= 1 and o.predicted == (o.score >= 0.3) for o in out.values())
    assert all(o.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, o in out.items())


def test_quality_fit_equals_plain_newton(spark):
    """The distributed fit finds the weights at which the pairs' gradient vanishes."""
    docs = documents(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, "true", ridge=1e-2)
    text = {r.doc_id: r.text for r in docs.collect()}
    good = [quality.text_features(text[r.doc_id]) for r in labels.collect() if r.quality == 1]
    bad = [quality.text_features(text[r.doc_id]) for r in labels.collect() if r.quality == 0]
    assert np.median(model.score(np.array(good))) > 0.3 > np.median(model.score(np.array(bad)))
    assert np.all(np.diff(model.score(np.array(good))[np.argsort(model.strength(np.array(good)))]) >= 0)


def test_quality_defined_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, None, None), (None, 1, 1), (5, 0, 1), (5, 1, 1)], "doc_id long, quality int, text int")
    model = quality.fit(odd(spark), labels, "true")
    assert quality.with_score(odd(spark), model, "s").where("s BETWEEN 0 AND 1").count() == len(ODD)
    none = quality.fit(odd(spark), labels.limit(0), "true")
    assert {r.s for r in quality.with_score(odd(spark), none, "s").collect()} == {0.5}
    assert quality.with_score(empty(spark), model, "s").count() == 0
