"""Operators against plain versions of themselves, and inputs that are hard on purpose."""

import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.llm import ann, language, licenses, media, mixing, quality, queries, tokens

SF = "/root/testdata/sf0.001"

# License scans: all windows.


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_windows(text, templates, threshold=licenses.THRESHOLD):
    words, best = plain_words(text), {}
    for label, template in templates:
        t = plain_words(template)
        size, t = max(licenses.MIN_WINDOW, licenses.WINDOW * len(t)), set(t)
        share = max(len(t & set(words[i : i + size])) / len(t) for i in range(max(1, len(words) - size + 1)))
        if share * len(t) >= math.ceil(threshold * len(t) - 1e-9):
            best[label] = max(best.get(label, 0), share)
    return best


def test_license_windows_equal_brute_force(spark):
    rng, rows = random.Random(9), []
    long = ("long", " ".join(f"term{i}" for i in range(90)) + " the of and license")
    templates = licenses.TEMPLATES + licenses.WHOLE + [long]
    for k in range(160):
        _, template = rng.choice(templates)
        words = []
        for w in template.split():  # words put in, left out
            words += ["filler"] * (rng.random() < rng.choice([0, 0.3, 0.9])) + [w] * (rng.random() > 0.05)
        noise = lambda: [rng.choice(["the", "of", "MIT", "software", "use", "word", "gnu", "and"]) for _ in range(rng.randint(0, 70))]
        rows.append((k, " ".join(noise() + words + noise() + (template.split() if k % 9 == 0 else []))))
    rows += [(1000, None), (1001, ""), (1002, "mit license"), (1003, licenses.WHOLE[0][1])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, license_words string")
    got = {r.doc_id: r.license for r in licenses.with_licenses(docs, templates=templates, block_words=None).select("doc_id", "license").collect()}
    for i, text in rows:
        want = plain_windows(text, templates)
        assert set(got[i].block_labels) == set(want), i
        assert got[i].score == pytest.approx(max(list(want.values()) + [1.0 if got[i].n_base else 0.0])), i
    assert "mit" in got[1003].block_labels and got[1003].n_words > 150


# Mixing: one block after another by the rule itself.


def plain_slots(blocks, shares):
    """Pfair with earliest deadline first, slot by slot; when a source runs out, the others start anew."""
    left, done, order = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    while left:
        active = {s: shares[s] for s in left if shares.get(s)} or {min(left): 1}
        whole, had, t = sum(active.values()), dict.fromkeys(active, 0), 0
        while all(left.get(s) for s in active):
            ready = [(math.ceil((had[s] + 1) * whole / w), s) for s, w in active.items() if had[s] * whole // w <= t]
            _, s = min(ready)
            order.append((s, done[s]))
            had[s] += 1
            done[s] += 1
            left[s] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
    return {x: t for t, x in enumerate(order)}


def test_mixing_equals_plain_pfair(spark):
    rng = random.Random(11)
    rows = [(i, "x" * rng.choice([3, 40, 90, 700]), f"s{rng.randrange(4)}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s0": 5, "s1": 3, "s2": 1}  # s3 has none: it comes last
    got = mixing.mixed(docs, weights, block_chars=500, buckets=4).collect()
    chars = Counter()
    for r in got:
        chars[f"={r.source}"] += r.chars
    blocks = {s: max(-(-n // 500), 1 + max(r.block for r in got if f"={r.source}" == s)) for s, n in chars.items()}
    slots = plain_slots(blocks, {f"={s}": w for s, w in weights.items()})
    assert all(r.slot == slots[f"={r.source}", r.block] for r in got) and len(got) == len(rows)
    # Block and place: running characters in the order of bucket and hash.
    at = Counter()
    for r in sorted(got, key=lambda r: ((r.hash & (1 << 64) - 1) >> 16 & 3, r.hash, r.doc_id)):
        assert (r.block, r.within) == divmod(at[r.source], 500)
        at[r.source] += r.chars


# Chat: the SQL beside the query.


def test_chat_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(queries.ORACLES["op6_chat_formatting"]).fetchdf()
    got = queries.op6_chat_formatting(spark, SF).toPandas()[list(want.columns)]
    assert got.sort_values("conv_id").values.tolist() == want.sort_values("conv_id").values.tolist()


# Nearest neighbours: one vector of another size.


@pytest.mark.parametrize("norm", [1e4, 1e30])
def test_search_beside_extreme_norms(spark, norm):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= norm
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = ann.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=1000).collect()
    found, y, hits = {}, x.astype(float), 0
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, ids in found.items():
        scores = y @ y[q]
        scores[q] = -np.inf
        hits += len(ids & set(np.argsort(-scores)[:20].tolist()))
    assert len(found) == 150 and hits / 3000 > 0.95


# Media: values full of signatures.


@pytest.mark.parametrize("unit", [b"PK\x03\x04", b"%PDF-1.4", b"GIF89a1234567!x", b"OggS\0\0" + bytes(21), b"fLaC", b"BM", b"RIFF"])
def test_media_time_in_proportion(unit):
    took = []
    for size in (1 << 20, 10 << 20):
        began = time.perf_counter()
        assert media.sniff(unit * (size // len(unit)))[0] == "unknown"
        took.append(time.perf_counter() - began)
    assert took[1] < 60 and took[1] < 30 * took[0] + 1


def crafted(kind, size):
    """Values whose every signature has a long way before it fails, all the same way."""
    if kind == "png":  # a whole IHDR, then a chunk that claims half the value
        ihdr = b"IHDR" + bytes(13)
        unit = b"\x89PNG\r\n\x1a\n" + bytes([0, 0, 0, 13]) + ihdr + zlib.crc32(ihdr).to_bytes(4, "big") + (size // 2).to_bytes(4, "big") + b"IDAT"
        return unit * (size // len(unit))
    if kind == "wav":  # heads that all jump into one chain of empty chunks
        n = size // 2 // 20
        heads = b"".join(b"RIFF" + struct.pack("<I", size - 20 * k - 9) + b"WAVEjump" + struct.pack("<I", (n - k - 1) * 20) for k in range(n))
        return heads + b"emptabcd"[:4] + bytes(4) + (b"empt" + bytes(4)) * ((size - len(heads)) // 8 - 1)
    if kind == "gif":  # heads before one chain of empty extensions
        return b"GIF89a1234567!x\0" * (size // 32) + b"!x\0" * (size // 6)
    if kind == "jpeg":  # a scan header before data without an end
        return b"\xff\xd8\xff\xc0\0\x02\xff\xda\0\x02" * (size // 20) + b"\xff\x00" * (size // 4)
    return b"fLaC\0\0\0\x22" + bytes(34) + b"fLaC\0\0\0\x22" * (size // 16) + b"\x01\0\0\0" * (size // 8)


@pytest.mark.parametrize("kind", ["png", "wav", "gif", "jpeg", "flac"])
def test_media_time_of_crafted_values(kind):
    took = []
    for size in (1 << 19, 4 << 20):
        value, began = crafted(kind, size), time.perf_counter()
        assert media.sniff(value)[:2] == ("unknown", 0)
        took.append(time.perf_counter() - began)
    assert took[1] < 60 and took[1] < 20 * took[0] + 1  # eight times the size


def plain_media(b):
    """(start, length, type) of every place where a whole file of four formats stands, each walked alone."""

    def wav(at):
        if b[at + 8 : at + 12] != b"WAVE":
            return 0
        end, p, seen = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12, set()
        while p + 8 <= end <= len(b):
            seen.add(b[p : p + 4])
            size = int.from_bytes(b[p + 4 : p + 8], "little")
            p += 8 + size + size % 2
        return end - at if p == end and {b"fmt ", b"data"} <= seen else 0

    def png(at):
        p, first = at + 8, True
        while p + 12 <= len(b):
            size, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
            if p + 12 + size > len(b) or first and (kind != b"IHDR" or size != 13) or zlib.crc32(b[p + 4 : p + 8 + size]) != int.from_bytes(b[p + 8 + size : p + 12 + size], "big"):
                return 0
            p, first = p + 12 + size, False
            if kind == b"IEND":
                return p - at
        return 0

    def gif(at):
        table = lambda flags: 3 * (2 << (flags & 7)) if flags & 0x80 else 0

        def sub(p):
            while p < len(b) and b[p]:
                p += 1 + b[p]
            return p + 1

        p = at + 13 + table(b[at + 10]) if len(b) >= at + 14 else len(b)
        while p < len(b):
            if b[p] == 0x3B:
                return p + 1 - at
            if b[p] == 0x21:
                p = sub(p + 2)
            elif b[p] == 0x2C and p + 10 < len(b):
                p = sub(p + 10 + table(b[p + 9]) + 1)
            else:
                return 0
        return 0

    def jpeg(at):
        p, frame = at + 2, False
        while p + 4 <= len(b) and b[p] == 0xFF:
            kind, size = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
            if kind == 0xFF:
                p += 1
                continue
            if kind < 0xC0 or size < 2:
                return 0
            frame |= kind in (0xC0, 0xC1, 0xC2)
            p += 2 + size
            if kind == 0xDA:
                while p < len(b) - 1 and not (b[p] == 0xFF and b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7):
                    p += 1
                if p >= len(b) - 1:
                    return 0
                if b[p + 1] == 0xD9:
                    return p + 2 - at if frame else 0
        return 0

    walks = {b"RIFF": ("audio/wav", wav), b"\x89PNG\r\n\x1a\n": ("image/png", png), b"GIF89a": ("image/gif", gif), b"\xff\xd8\xff": ("image/jpeg", jpeg)}
    return {(m.start(), size, kind) for magic, (kind, f) in walks.items() for m in re.finditer(re.escape(magic), b) if (size := f(m.start()))}


def test_media_chains_equal_walks_alone():
    rng = random.Random(8)
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    ihdr, iend = chunk(b"IHDR", bytes(13)), chunk(b"IEND", b"")
    big = chunk(b"IDAT", bytes(rng.randrange(256) for _ in range(9000)))
    riff = lambda body: b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body
    fmt, data = b"fmt " + struct.pack("<I", 2) + b"xx", b"data" + struct.pack("<I", 3) + b"abc\0"
    scraps = [
        b"\x89PNG\r\n\x1a\n", ihdr, iend, big, big[:-1] + b"?", riff(fmt + data), riff(fmt + data)[:-4], riff(data), riff(b"jump" + struct.pack("<I", 24) + bytes(24)), fmt, data, fmt + data,
        b"GIF89a" + b"1234\x80xx" + bytes(6), b"!x\x02ab\0", b",12345678\0\x08\x01a\0", b";", b"\xff\xd8\xff\xc0\0\x02", b"\xff\xd8", b"\xff\xda\0\x02ab\xff\0c", b"\xff\xd9", b"\xff\xc4\0\x03z", b"\xff\xff", b"\xff\xd8\xff", b"x",
    ]
    met = 0
    for _ in range(1500):
        b = b"".join(rng.choice(scraps) for _ in range(rng.randint(2, 14)))
        v = media.Value(b)
        want = plain_media(b)
        got = {(m.start(), size, kind) for magic, kind in media.MAGIC if kind in ("audio/wav", "image/png", "image/gif", "image/jpeg") for m in re.finditer(re.escape(magic), b) if (size := media.VALIDATORS[kind](v, m.start()))}
        assert got == want
        met += len(want)
    assert met > 300


def test_part_checksums():
    rng = random.Random(9)
    b = bytes(rng.randrange(256) for _ in range(30_000))
    v = media.Value(b)
    for _ in range(200):
        i, j = sorted(rng.randrange(len(b) + 1) for _ in range(2))
        assert v.crc(i, j) == zlib.crc32(b[i:j])


def plain_crc(data, poly, width):
    crc = 0
    for x in data:
        crc ^= x << width - 8
        for _ in range(8):
            crc = ((crc << 1) ^ (poly if crc >> width - 1 else 0)) & (1 << width) - 1
    return crc


def test_flac_is_whole_or_unknown():
    frame = lambda k: (lambda head: (lambda body: body + plain_crc(body, 0x8005, 16).to_bytes(2, "big"))(head + bytes([plain_crc(head, 7, 8)]) + bytes(range(40))))(bytes([0xFF, 0xF8, 0x69, 0x08, k, 0x3F]))
    flac = b"fLaC\x80\0\0\x22" + bytes(34) + frame(0) + frame(1) + frame(2)
    assert media.sniff(flac)[:2] == ("audio/flac", len(flac))
    assert all(media.sniff(flac[:-k])[0] == "unknown" for k in range(1, 40))


def test_zip_and_pdf_marks_are_shared():
    end = b"PK\x01\x02" + bytes(42)
    whole = b"PK\x03\x04" + bytes(26) + end + b"PK\x05\x06" + bytes(8) + struct.pack("<IIH", len(end), 30, 0)
    value = b"PK\x03\x04 no " + whole + b"%PDF-1.1 a" + whole
    assert media.sniff(value)[2] == [(8, len(whole), "application/zip"), (18 + len(whole), len(whole), "application/zip")]


# Language: many languages, plain counts and scores.


def test_viterbi_with_many_languages():
    rng = np.random.default_rng(3)
    for n in (2, 128, 129, 130, 300):
        x = rng.normal(size=(600, n)).astype(np.float32) * 3
        doc = np.repeat([0, 1, 2], [5, 300, 295])
        path = language.best_path(x, doc, 8.0)
        for d in range(3):
            at = np.flatnonzero(doc == d)
            best = x[at[0]].astype(float)
            for t in at[1:]:
                best = np.maximum(best, best.max() - 8.0) + x[t]
            assert x[at, path[at]].sum() - 8.0 * (np.diff(path[at]) != 0).sum() == pytest.approx(best.max(), rel=1e-5)


def test_language_counts_and_scores_equal_plain_ones(spark):
    train = [(1, "Der Hund, die Katze", "de"), (2, "the dog the cat", "en"), (3, "кот и пёс", "ru"), (4, None, "en"), (5, "left out", None)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), "doc_id < 9")
    assert model.languages == ["de", "en", "ru"]
    m = (1 << 32) - 1

    def places(word):
        codes = [0, *map(ord, word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            two = (a * 0x9E3779B1 + b * 0x85EBCA6B) & m
            three = ((two ^ two >> 15) * 0xC2B2AE35 + c * 0x27D4EB2F) & m
            yield (three >> 7) % language.TRIGRAMS, (two >> 9) % language.BIGRAMS

    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    three, two = {g: Counter() for g in model.languages}, {g: Counter() for g in model.languages}
    for _, t, g in train[:3]:
        for w in words(t):
            for a, b in places(w):
                three[g][a] += 1
                two[g][b] += 1
    seen = lambda c: len(set().union(*c.values()))
    score = lambda c, g, k: 0.5 * math.log((c[g][k] + 0.5) / (sum(c[g].values()) + 0.5 * seen(c)))
    text = "dog katze кот"
    got = model.scores(language.Words.of([text]))
    for k, w in enumerate(words(text)):
        own = ["ru"] if "к" in w else ["de", "en"]  # the script's candidates
        plain = {g: sum(score(three, g, a) + score(two, g, b) for a, b in places(w)) for g in own}
        for j, g in enumerate(model.languages):
            assert got[k, j] == pytest.approx(plain[g] - max(plain.values()) if g in own else -60.0, abs=1e-3)


# Quality: plain Newton on the same pairs.


def test_fit_is_the_plain_minimum(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, "true", ridge=1e-2, steps=30)
    text = {r.doc_id: r.text for r in docs.collect()}
    feats = spark.createDataFrame([(r.doc_id, int(r.quality), quality.text_features(text[r.doc_id])) for r in labels.collect()], "doc_id long, label int, f array<double>")
    x = np.array([r.f for r in feats.collect()])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9] = 1
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    pairs = quality._pairs(feats).collect()
    standard = lambda v: np.clip((np.array(v) - mean) / scale, -6, 6)
    diff = standard([p.better for p in pairs]) - standard([p.worse for p in pairs])
    good, bad = (labels.where(F.col("quality") == k).count() for k in (1, 0))
    assert len(pairs) == quality.PAIRS_EACH * max(good, bad)
    w = np.zeros(diff.shape[1])
    for _ in range(60):  # minimise mean log(1 + exp(-diff w)) + ridge / 2 w w
        p = 1 / (1 + np.exp(diff @ w))
        grad = -(diff.T @ p) / len(diff) + 1e-2 * w
        w = w - np.linalg.solve((diff.T * (p * (1 - p))) @ diff / len(diff) + 1e-2 * np.eye(len(w)), grad)
    assert np.abs(grad).max() < 1e-9 and np.allclose(model.weights, w, atol=1e-3)


# Token files: several files and blocks, one read of each.


def test_token_files_of_many_blocks(spark, tmp_path):
    rng, want = np.random.default_rng(2), []
    for name, n in (("a", 5000), ("b", 1), ("c", 4096)):
        ids = rng.integers(0, 40, n).astype("<u2")
        (tmp_path / f"{name}.bin").write_bytes(ids.tobytes())
        ends = np.flatnonzero(ids == 9)
        starts = np.concatenate([[0], ends + 1])
        want += [(name, int(s), int(e - s)) for s, e in zip(starts, [*ends, n], strict=True) if e < n or s < n]
    got = tokens.scan(tokens.file_blocks(spark, str(tmp_path), block_tokens=64), 9).collect()
    assert sorted((r.file[-5], r.start, r.n_tokens) for r in got) == sorted(want)


# Nearest neighbours: norms that differ within a shard.


@pytest.mark.parametrize("spread", [0.0, 0.1, 1.0])
def test_shard_recall_whatever_the_norms(spread):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32)) + 2 * rng.normal(size=(40, 32))[rng.integers(0, 40, 3000)]
    x *= (np.exp(rng.normal(0, spread, 3000)) / np.linalg.norm(x, axis=1))[:, None]
    shard, hits = ann.Shard(np.arange(3000), x, 20), 0
    asked = np.arange(0, 3000, 20)
    found = {}
    for q, v, s in shard.nearest(asked, x[asked], 20, ann.SEARCH_BEAM):
        assert abs(s - x[q] @ x[v]) < 1e-9
        found.setdefault(q, []).append(v)
    for q in asked.tolist():
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(found[q]) & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (20 * len(asked)) > 0.97


def test_like_norms_hold_all_rows():
    norms = np.random.default_rng(7).exponential(size=5000)
    runs = list(ann.like_norms(norms))
    assert sorted(np.concatenate(runs).tolist()) == list(range(5000))
    assert all(len(r) <= ann.FEW or norms[r[0]] / norms[r[-1]] <= 2 ** (1 / ann.NORM_STEPS) * (1 + 1e-9) for r in runs)
    assert list(ann.like_norms(np.zeros(0))) == []


# Token files: large ones by ranges.


@pytest.mark.parametrize("whole_bytes", [1 << 28, 4000, 1])
def test_files_by_ranges_equal_whole_files(spark, tmp_path, whole_bytes):
    rng = np.random.default_rng(8)
    files = {"long one.bin": rng.integers(0, 40, 7777), "short.bin": rng.integers(0, 40, 90), "even.bin": rng.integers(0, 40, 4096), "none.bin": rng.integers(0, 40, 0)}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
    blocks = tokens.file_blocks(spark, str(tmp_path), block_tokens=4, whole_bytes=whole_bytes)
    held = Counter(r.file.rsplit("/", 1)[1] for r in blocks.collect())
    assert held == {name: -(-len(ids) // 4) for name, ids in files.items() if len(ids)}
    got = {}
    for r in tokens.scan(blocks, 0).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.doc_no, r.start, r.n_tokens, r.terminated))
    for name, ids in files.items():
        ends = np.flatnonzero(ids == 0).tolist()
        want, start = [], 0
        for e in ends:
            want.append((len(want), start, e - start, True))
            start = e + 1
        if start < len(ids):
            want.append((len(want), start, len(ids) - start, False))
        assert sorted(got.get(name, [])) == want
