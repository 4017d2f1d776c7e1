"""License scans: an exact set-similarity join of text blocks with license templates.

A block holds a template if at least ``threshold`` of the template's distinct words are in it. With ``block_words=None``
blocks are all windows of a text, at every word, WINDOW times as long as the template (MIN_WINDOW words at least), so a
template of any length is found wherever it stands; with a number of words they are overlapping cuts of that length.
Words are ordered by how many documents have them (over all documents), rarest first, and

- prefix filter: with o common words needed, the first ``len - o + 1`` words of template and block share one;
- length filter: a block with fewer than o template words can't hold it;
- positional filter: the words that follow a common word on both sides bound how many more can be common.

What passes is counted exactly. Templates are a parameter of bounded size, so their prefix index travels to the tasks
and texts never move. Base phrases, whose places are counted word by word, come on top and always stay.

Defined cases: null and empty texts have no words, no places, empty label strings and score 0; texts shorter than a
block are one block; a text of any length is scanned whole, in memory in proportion to it; repeated rows get equal
results; extra columns stay, but for one of the name of the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.9
#: Words of a block that is cut; each begins half a block after the one before.
BLOCK_WORDS = 64
#: Words of a window for each word of its template, and of the shortest window.
WINDOW, MIN_WINDOW = 2, 64

# Phrases and the labels of their places.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Opening words of public licenses, and their labels.
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

# Whole texts of public licenses, and their labels.
WHOLE = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]

_WORD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and what isn't ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().translate(_WORD).split()


class Scanner:
    """Templates indexed by their prefixes under one order of words, and the base phrases."""

    def __init__(self, templates: list[tuple[str, str]], phrases: Mapping[str, str], frequency: Mapping[bytes, int], threshold: float, block_words: int | None) -> None:
        vocabulary = {w for _, t in templates for w in words_of(t)}
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates: list[tuple[str, list[int], frozenset[int], int]] = []
        self.index: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []
        for label, text in templates:
            ranks = sorted({self.rank[w] for w in words_of(text)})
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            for i in range(len(ranks) - need + 1):
                self.index.setdefault(ranks[i], []).append((len(self.templates), i))
            self.templates.append((label, ranks, frozenset(ranks), need))
            self.lengths.append(max(MIN_WINDOW, WINDOW * len(words_of(text))))
        self.rare = frozenset(w for w, r in self.rank.items() if r in self.index)
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]
        self.block_words = block_words

    def places(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Words at which base phrases start, and their labels."""
        line, starts, labels = b" " + b" ".join(words) + b" ", [], set()
        for phrase, label in self.phrases:
            at, word, seen = line.find(phrase), 0, 0
            while at >= 0:
                word += line.count(b" ", seen, at)
                seen = at
                starts.append(word)
                labels.add(label)
                at = line.find(phrase, at + 1)
        return starts, labels

    def blocks(self, words: list[bytes]) -> list[tuple[int, str, float]]:
        """(first word, label, contained share) of each template that a block holds."""
        if self.rare.isdisjoint(words):
            return []
        rank = self.rank
        known = [(i, rank[w]) for i, w in enumerate(words) if w in rank]
        if self.block_words is None:
            return sorted(x for t in self.may_hold(sorted({r for _, r in known})) for x in self.windows(t, known))
        step, found = max(1, self.block_words // 2), []
        by_step: dict[int, set[int]] = {}
        for i, r in known:
            by_step.setdefault(i // step, set()).add(r)
        for b in sorted({k for s in by_step for k in (s - 1, s) if k >= 0}):
            block = sorted(by_step.get(b, set()) | by_step.get(b + 1, set()))
            found += [(b * step, label, share) for label, share in self.held(block)]
        return found

    def may_hold(self, block: list[int]) -> Iterator[int]:
        """Templates that pass the filters for a block, given as its words' ranks in order."""
        tried = set()
        for j, r in enumerate(block):
            for t, i in self.index.get(r, ()):
                _, ranks, _, need = self.templates[t]
                if t in tried or len(block) < need or j > len(block) - need:  # length; the block's prefix
                    continue
                tried.add(t)  # the first common word: what comes before it is not common
                if min(len(ranks) - i, len(block) - j) >= need:  # position
                    yield t

    def held(self, block: list[int]) -> Iterator[tuple[str, float]]:
        """Templates that a block, as its words' ranks in order, holds."""
        for t in self.may_hold(block):
            label, ranks, members, need = self.templates[t]
            common = sum(r in members for r in block)
            if common >= need:
                yield label, common / len(ranks)

    def windows(self, t: int, known: list[tuple[int, int]]) -> Iterator[tuple[int, str, float]]:
        """(first word, label, contained share): of each stretch of windows that hold a template, the best, the first of equals.

        ``known``: places and ranks of a text's known words. Only windows that end at a word of the template are looked at: any
        other holds what one of these holds.
        """
        label, ranks, members, need = self.templates[t]
        length, hits = self.lengths[t], [(i, r) for i, r in known if r in members]
        counts: Counter = Counter()
        common, left, best, until = 0, 0, None, -1
        for i, r in hits:
            counts[r] += 1
            common += counts[r] == 1
            while hits[left][0] <= i - length:
                gone = hits[left][1]
                counts[gone] -= 1
                common -= counts[gone] == 0
                left += 1
            if common >= need:
                if best is not None and hits[left][0] > until:  # no overlap with the stretch so far
                    yield best
                    best = None
                until = i
                if best is None or common / len(ranks) > best[2]:
                    best = hits[left][0], label, common / len(ranks)
        if best is not None:
            yield best

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        starts, base = self.places(words)
        blocks = self.blocks(words)
        score = max([share for *_, share in blocks] + [1.0 if starts else 0.0])
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for _, x, _ in blocks})),
            float(score), [b for b, *_ in blocks], [x for _, x, _ in blocks], [float(s) for *_, s in blocks],
        )


FIELDS = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double",
    "block_words": "array<int>", "block_labels": "array<string>", "block_shares": "array<double>",
}


def word_frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """How many of all documents have each template word: as many numbers as the templates have words."""
    wanted = frozenset(w for _, t in templates for w in words_of(t))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                n.update(wanted.intersection(words_of(t)))
        yield pd.DataFrame({"word": list(n), "n": list(n.values())})

    rows = docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def with_licenses(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD, block_words: int | None = BLOCK_WORDS, column: str = "license") -> DataFrame:
    """``docs`` and a struct: words, base places, labels, score, and the blocks that hold templates. Two passes, no shuffle of texts."""
    scanner = Scanner(templates, phrases, word_frequencies(docs, templates), threshold, block_words)

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in FIELDS.items()))
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scanner.scan(t) for t in texts], columns=list(FIELDS))
        return out.astype({k: "Int64" for k in ("first_word", "last_word")})

    return docs.withColumn(column, scan(F.col("text")))
