"""Byte-level BPE: encoding and decoding as monoid tree reductions.

A text is halved until its parts are short, the parts are encoded, and neighbours are joined up the tree. Two joins:

- Of parts of a text (``join_parts``): pieces of the splitting pattern that end well before the seam can't change,
  as the pattern looks ahead three characters at most beyond a run of white space. What follows them is split anew,
  across the seam, in a window that grows until one of its ends is an end in the right part too: from there on
  splitting goes the same way, so all pieces outside the window are stable.
- Of parts of one piece (``join_ids``): the last ids of the left and the first of the right are decoded and encoded
  anew. A sequence of ids is a BPE encoding exactly if each two neighbours, encoded together, stay as they are; so
  the window grows on a side until its outer neighbour is compatible with it.

Decoding concatenates up the same kind of tree. Ranks are a parameter; tokenizers are never trained here.

Defined cases: a null text is an empty one, with no ids; lone surrogates can't occur in Spark's strings; special
tokens in a text are ordinary text; repeated rows get equal results; an empty table gives an empty one; extra columns stay,
but for one of the name of the result; a text of any length is encoded in one task whose memory is in proportion to it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from bisect import bisect_left
from itertools import accumulate, chain, pairwise

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text, and bytes of a piece, that are encoded without a further halving.
LEAF_CHARS, LEAF_BYTES = 8192, 48
#: Pieces remembered by a Python worker.
REMEMBERED = 400_000
_AHEAD = 3
_NONE = 1 << 62

# The letters, digits and white space below code point 250 (hexadecimal), as the Unicode classes have them.
_LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_LATIN_NUMBERS = "0-9²³¹¼-¾"
_LATIN_SPACE = "\\t\\n\\x0b\\x0c\\r \x85\xa0"
_BEYOND = re.compile("[^\u0000-ɏ]")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class BPE:
    """An encoder for one vocabulary and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.names = list(map(str, range(len(self.bytes_of))))
        self.split = regex.compile(pattern)
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_LATIN_SPACE}{_LATIN_LETTERS}{_LATIN_NUMBERS}]").replace(r"\p{L}", f"[{_LATIN_LETTERS}]").replace(r"\p{N}", f"[{_LATIN_NUMBERS}]").replace(r"\s", f"[{_LATIN_SPACE}]").replace(r"\S", f"[^{_LATIN_SPACE}]")
        self.split_latin = re.compile(narrow)
        self.known: dict[str, tuple[int, ...]] = {}
        self.fits = functools.lru_cache(100_000)(self._fits)

    # Ids of one piece.

    def merge(self, raw: bytes) -> list[int]:
        """Merge neighbours of least rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        parts = [raw[i : i + 1] for i in range(len(raw))]
        found = [ranks.get(a + b, _NONE) for a, b in pairwise(parts)]
        while found:
            least = min(found)
            if least == _NONE:
                break
            at = found.index(least)
            parts[at : at + 2] = [joined := parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = ranks.get(parts[at - 1] + joined, _NONE)
            if at < len(found):
                found[at] = ranks.get(joined + parts[at + 1], _NONE)
        return [ranks[p] for p in parts]

    def merge_long(self, raw: bytes) -> list[int]:
        """The same merges of many bytes: neighbours wait in a heap by rank and place, so the time is n log n."""
        ranks, n = self.ranks, len(raw)
        part = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been merged since
            part[i], part[j] = part[i] + part[j], b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
        return [ranks[p] for p in part if p]

    def piece(self, raw: bytes) -> list[int]:
        """Ids of a piece: of its halves, joined."""
        if len(raw) <= LEAF_BYTES:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join_ids(self.piece(raw[:half]), self.piece(raw[half:]))

    def _fits(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        more_left = more_right = 1
        while True:
            raw = b"".join(map(self.bytes_of.__getitem__, chain(left[i:], right[:j])))
            window = self.merge(raw) if len(raw) <= LEAF_BYTES else self.merge_long(raw)
            if i and not self.fits(left[i - 1], window[0]):
                more_left *= 2  # growth by doubling: a window is encoded a logarithmic number of times
                i = max(0, i - more_left)
            elif j < len(right) and not self.fits(window[-1], right[j]):
                more_right *= 2
                j = min(len(right), j + more_right)
            else:
                return left[:i] + window + right[j:]

    # Pieces of a text.

    def pieces(self, text: str) -> list[str]:
        split = self.split if _BEYOND.search(text) else self.split_latin
        return self._pieces(text, 0, len(text), split)

    def _pieces(self, text: str, start: int, end: int, split: re.Pattern) -> list[str]:
        if end - start <= LEAF_CHARS:
            return split.findall(text, start, end)
        middle = (start + end) // 2
        return self.join_parts(text, start, middle, end, self._pieces(text, start, middle, split), self._pieces(text, middle, end, split), split)

    def join_parts(self, text: str, start: int, seam: int, end: int, left: list[str], right: list[str], split: re.Pattern) -> list[str]:
        at, keep = seam, len(left)
        while keep and at > seam - _AHEAD:  # pieces that end near the seam are open
            keep -= 1
            at -= len(left[keep])
        if keep and not left[keep - 1].strip():  # a run of white space before them may go on
            keep -= 1
            at -= len(left[keep])
        ends = list(accumulate(map(len, right[:64]), initial=seam))
        window: list[str] = []
        while at < end:
            m = split.match(text, at, end)
            window.append(m[0])
            at = m.end()
            if at > ends[-1] and len(ends) <= len(right):
                ends = list(accumulate(map(len, right), initial=seam))
            if at >= seam:
                k = bisect_left(ends, at)
                if k < len(ends) and ends[k] == at:
                    return left[:keep] + window + right[k:]
        return left[:keep] + window

    # Whole texts.

    def ids_of(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of each piece; pieces met before are remembered."""
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for i, x in enumerate(out):
                if x is None:
                    p = pieces[i]
                    if (x := known.get(p)) is None:
                        x = tuple(self.piece(p.encode()))
                        if len(p) <= LEAF_BYTES:
                            known[p] = x
                    out[i] = x
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.ids_of(self.pieces(text or ""))))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: halves, concatenated up the tree."""
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.cache
def encoder(path: str, pattern: str) -> BPE:
    """One encoder for a Python worker; the rank file is there wherever the tokenizers are installed."""
    return BPE(read_ranks(path), pattern)


def with_ids(docs: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """``docs`` and the ids of each whole text, as an array. One pass, no shuffle."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([encoder(path, pattern).encode(t) for t in texts])

    return docs.withColumn(column, ids(F.col("text")))


def with_text(coded: DataFrame, path: str, pattern: str, ids: str = "ids", column: str = "text") -> DataFrame:
    """``coded`` and the text that its ids stand for (bytes that aren't UTF-8 become U+FFFD)."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else encoder(path, pattern).decode(list(v)).decode("utf-8", "replace") for v in values])

    return coded.withColumn(column, text(F.col(ids)))


def with_digests(docs: DataFrame, path: str, pattern: str, column: str = "bpe") -> DataFrame:
    """``docs`` and (n_tokens, ids_sha256, decoded_sha256) of each whole text: encoded, then decoded from the ids."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = encoder(path, pattern), []
        for t in texts:
            ids = bpe.encode(t)
            rows.append((len(ids), hashlib.sha256(" ".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(column, digest(F.col("text")))


def with_coding(docs: DataFrame, path: str, pattern: str, *also: str) -> DataFrame:
    """(doc_id, source, ids, n_tokens, round_trip) of each row, and columns ``also``: the ids of its text, and whether they decode to it."""

    @F.pandas_udf("ids array<int>, n_tokens long, round_trip boolean")
    def code(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = encoder(path, pattern), []
        for t in texts:
            ids = bpe.encode(t)
            rows.append((ids, len(ids), bpe.decode(ids) == (t or "").encode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["ids", "n_tokens", "round_trip"])

    return docs.select("doc_id", "source", *also, code(F.col("text")).alias("coded")).select("doc_id", "source", "coded.*", *also)
