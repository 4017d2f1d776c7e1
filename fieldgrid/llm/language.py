"""Language ID: script ranges narrow a word's candidates, then Viterbi over per-word scores with a switching penalty.

Learnt from labelled texts: for each language the counts of hashed character trigrams and bigrams of its words, and
the scripts it is written in. A word's score in a language is the sum over its letters of their n-grams' log
probabilities, relative to the word's best language; languages not seen in the word's script are all but ruled out.
The best path through a text's words pays ``penalty`` for each change of language, so it parts mixed texts into spans.
A text's language is the one with most letters in its spans; the score is that share.

Defined cases: ``und`` with score 0 and no spans if the text is null, empty or has no letter, or if nothing was learnt;
ties go to the language first by name; words of an unseen script are no evidence; repeated rows get equal results;
extra columns stay, but for one of the name of the result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About so many labelled rows are learnt from (all if there are fewer), chosen by a hash of their id.
MAX_LEARNT = 20_000
#: Trigrams and bigrams are counted by hash, in so many places each: the bound of the model, times the languages.
TRIGRAMS, BIGRAMS = 1 << 16, 1 << 12
PENALTY = 8.0
#: Words of a text that are decoded in step; characters of texts that are held as arrays at once.
SEGMENT, PORTION = 128, 1_000_000
#: Values of ways through segments that are computed at once.
WAYS = 1 << 23

# First and last code points of scripts.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F)),
    "armenian": ((0x531, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "ethiopic": ((0x1200, 0x139F),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
}
_NAMES = ["other", *SCRIPTS]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and the number of its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for k, name in enumerate(_NAMES[1:], 1):
        for a, b in SCRIPTS[name]:
            script[a : b + 1] = k
    return letter, script


@dataclass
class Words:
    """Letters of several texts one after another, with a zero around each run of letters; words are these runs."""

    letters: np.ndarray  # code points, zero for whatever is not a letter
    first: np.ndarray  # of each word
    size: np.ndarray
    doc: np.ndarray  # number of each word's text

    @classmethod
    def of(cls, texts: list[str | None]) -> Words:
        letter, _ = _tables()
        codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), "<u4") for t in texts]
        flat = np.concatenate([np.zeros(1, "<u4"), *[x for c in codes for x in (c, np.zeros(1, "<u4"))]])
        is_letter = letter[flat]
        edge = np.flatnonzero(np.diff(is_letter.astype(np.int8), prepend=0))
        first, end = edge[::2], edge[1::2]
        starts = np.cumsum([1, *[len(c) + 1 for c in codes]])
        return cls(np.where(is_letter, flat, 0), first, end - first, np.searchsorted(starts, first, side="right") - 1)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each character: places of the trigram around it and of the bigram that it ends."""
        x = self.letters.astype(np.uint32)
        before, after = np.roll(x, 1), np.roll(x, -1)
        two = before * np.uint32(0x9E3779B1) + x * np.uint32(0x85EBCA6B)
        three = (two ^ (two >> np.uint32(15))) * np.uint32(0xC2B2AE35) + after * np.uint32(0x27D4EB2F)
        return (three >> np.uint32(7)) & np.uint32(TRIGRAMS - 1), (two >> np.uint32(9)) & np.uint32(BIGRAMS - 1)

    def scripts(self) -> np.ndarray:
        return _tables()[1][self.letters[self.first]]


@dataclass
class LanguageModel:
    """Log probabilities of hashed n-grams in each language; ``allowed``: candidates by script, no row set: no evidence."""

    languages: list[str]
    three: np.ndarray
    two: np.ndarray
    allowed: np.ndarray
    penalty: float = PENALTY

    def scores(self, words: Words) -> np.ndarray:
        """A row for each word, a column for each language; 0 for the best."""
        if not len(words.first):
            return np.zeros((0, len(self.languages)), np.float32)
        h3, h2 = words.hashes()
        by_letter = self.three[h3] + self.two[h2]
        total = np.add.reduceat(by_letter, np.stack([words.first, words.first + words.size], axis=1).ravel()[:-1], axis=0)[::2]
        allowed = self.allowed[words.scripts()]
        total = np.where(allowed, total - np.where(allowed, total, -np.inf).max(axis=1, initial=-1e30)[:, None], -60.0)
        return np.where(allowed.any(axis=1)[:, None], total, 0.0).astype(np.float32)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[str]], list[list[int]]]:
        """Language, score, and spans (their languages and first words, from 0) of each text."""
        out: tuple[list, list, list, list] = [], [], [], []
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= PORTION:
                _extend(out, self._label(held))
                held, size = [], 0
        _extend(out, self._label(held))
        return out

    def _label(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[str]], list[list[int]]]:
        n = len(self.languages)
        out = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts], [[] for _ in texts]
        if not n or not texts:
            return out
        words = Words.of(texts)
        path = best_path(self.scores(words), words.doc, self.penalty)
        share = np.bincount(words.doc * n + path, weights=words.size, minlength=len(texts) * n).reshape(-1, n)
        opens = np.searchsorted(words.doc, np.arange(len(texts)))
        starts = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(words.doc, prepend=-1) != 0))
        for d, s, k in zip(words.doc[starts].tolist(), starts.tolist(), path[starts].tolist(), strict=True):
            out[2][d].append(self.languages[k])
            out[3][d].append(s - int(opens[d]))
        total = share.sum(axis=1)
        for d in np.flatnonzero(total).tolist():
            k = int(share[d].argmax())
            out[0][d], out[1][d] = self.languages[k], float(share[d, k] / total[d])
        return out


def _extend(out: tuple, more: tuple) -> None:
    for a, b in zip(out, more, strict=True):
        a.extend(b)


def best_path(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi: the state of each word that maximises each text's sum of scores less ``penalty`` for each change.

    Texts are cut into segments, which are decoded in step: first for every state before them, which gives the values
    of n x n ways through each; then the segments of each text are joined, which gives the state before each; then
    once more from that state, with one pointer for each word and state. A long text costs as many steps as a short one.
    """
    w, n = scores.shape
    if not w:
        return np.zeros(0, np.int64)
    penalty = np.float32(penalty)
    place = np.arange(w) - np.searchsorted(doc, doc)  # of the word in its text
    seg_first = np.flatnonzero(place % SEGMENT == 0)
    seg_size = np.diff(np.append(seg_first, w))
    opening = place[seg_first] == 0
    order = np.argsort(-seg_size, kind="stable")  # long segments first: those that still run are a prefix
    enter = np.where(np.eye(n, dtype=bool), np.float32(0), -penalty)
    by_seg = np.empty((len(order), n, n), np.float32)
    step = max(1, WAYS // (n * n))
    for a in range(0, len(order), step):
        segs = order[a : a + step]
        best = np.where(opening[segs][:, None, None], np.float32(0), enter[None]) + scores[seg_first[segs]][:, None, :]
        for t, live in _steps(seg_size[segs]):
            was = best[:live]
            best[:live] = np.maximum(was, was.max(axis=2, keepdims=True) - penalty) + scores[seg_first[segs[:live]] + t][:, None, :]
        by_seg[segs] = best
    # Join the segments of each text: texts in step, by number of segments.
    text_first = np.flatnonzero(opening)
    many = np.diff(np.append(text_first, len(seg_first)))
    texts = np.argsort(-many, kind="stable")
    value, came = np.zeros((len(texts), n), np.float64), np.zeros((len(seg_first), n), np.int64)
    live = np.searchsorted(-many[texts], -np.arange(many.max()), side="left")
    for j, a in enumerate(live.tolist()):
        at = text_first[texts[:a]] + j
        ways = value[:a, :, None] + by_seg[at]
        came[at], value[:a] = ways.argmax(axis=1), ways.max(axis=1)
    state, last, start = value.argmax(axis=1), np.zeros(len(seg_first), np.int64), np.zeros(len(seg_first), np.int64)
    for j in range(len(live) - 1, -1, -1):
        a = int(live[j])
        at = text_first[texts[:a]] + j
        last[at] = state[:a]
        start[at] = state[:a] = came[at, state[:a]]
    # Once more, from the state that is now known to be before each segment.
    best = np.where(opening[order][:, None], np.float32(0), enter[start[order]]) + scores[seg_first[order]]
    back = np.zeros((w, n), np.min_scalar_type(n))
    own = np.arange(n, dtype=back.dtype)
    steps = _steps(seg_size[order])
    for t, a in steps:
        at, was = seg_first[order[:a]] + t, best[:a]
        change = was.max(axis=1, keepdims=True) - penalty
        back[at] = np.where(was >= change, own, was.argmax(axis=1)[:, None])
        best[:a] = np.maximum(was, change) + scores[at]
    path, state = np.zeros(w, np.int64), last[order]
    for t, a in [*reversed(steps), (0, len(order))]:
        at = seg_first[order[:a]] + t
        path[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return path


def _steps(sizes: np.ndarray) -> list[tuple[int, int]]:
    """(t, how many of the segments, longest first, have a word t), from the second word on."""
    live = np.searchsorted(-sizes, -np.arange(sizes.max()), side="left")
    return list(enumerate(live.tolist()))[1:]


def fit(docs: DataFrame, learn: str, *, max_learnt: int = MAX_LEARNT, penalty: float = PENALTY) -> LanguageModel:
    """Learn from ``docs(doc_id, text, lang)`` where the condition ``learn`` on doc_id holds and lang and text are set.

    Counts are made on the executors and summed by place there; the driver gets the sums only.
    """
    rows = docs.where(F.expr(learn) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = max(1, rows.select("doc_id").count())
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_learnt).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                sums = total.setdefault(lang, np.zeros(TRIGRAMS + BIGRAMS + len(_NAMES), np.int64))
                for at in range(0, len(texts), 200):
                    words = Words.of(texts.iloc[at : at + 200].tolist())
                    inside = words.letters > 0
                    h3, h2 = words.hashes()
                    sums[:TRIGRAMS] += np.bincount(h3[inside], minlength=TRIGRAMS)
                    sums[TRIGRAMS : TRIGRAMS + BIGRAMS] += np.bincount(h2[inside], minlength=BIGRAMS)
                    sums[TRIGRAMS + BIGRAMS :] += np.bincount(words.scripts(), minlength=len(_NAMES))
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "place": at, "n": sums[at]})

    sums = sample.mapInPandas(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    if not languages:
        return LanguageModel([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0), bool), penalty)
    counts = np.zeros((TRIGRAMS + BIGRAMS + len(_NAMES), len(languages)))
    counts[sums["place"], sums["lang"].map(languages.index)] = sums["n"]
    three, two, scripts = counts[:TRIGRAMS], counts[TRIGRAMS : TRIGRAMS + BIGRAMS], counts[TRIGRAMS + BIGRAMS :]

    def logs(x: np.ndarray) -> np.ndarray:
        used = max(1, int((x.sum(axis=1) > 0).sum()))
        return (0.5 * np.log((x + 0.5) / (x.sum(axis=0) + 0.5 * used))).astype(np.float32)

    return LanguageModel(languages, logs(three), logs(two), scripts >= np.maximum(1, 0.005 * scripts.sum(axis=0)), penalty)


def with_language(docs: DataFrame, model: LanguageModel, column: str = "language") -> DataFrame:
    """``docs`` and a struct: (lang, score, span_langs, span_starts) of each whole text. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (TRIGRAMS + BIGRAMS) x languages numbers

    @F.pandas_udf("lang string, score double, span_langs array<string>, span_starts array<int>")
    def label(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("lang", "score", "span_langs", "span_starts"), shared.value.label(texts.tolist()), strict=True)))

    return docs.withColumn(column, label(F.col("text")))
