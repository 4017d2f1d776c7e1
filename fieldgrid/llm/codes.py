"""Vector code compression: product codes of integer vectors, whose codebooks Lloyd's rounds refine under Hamerly's bounds.

Each component x becomes the integer floor(256 * x); a vector is cut into equal consecutive parts, each coded by the
nearest entry of its position's codebook. A written table, the state, holds for each part its entry, one upper bound of the
distance to it and one lower bound of the distance to the second nearest. Between rounds the upper bound grows by how far
its entry moved and the lower one falls by the most that any other entry did. A part whose upper bound lies strictly below
its lower bound, or below half the way from its entry to that entry's nearest neighbour, keeps its entry; if the exact distance does not settle
it either, all entries are measured in integers, ties to the lower index. Bounds are rounded outwards, so no part keeps an
entry that a whole scan would not choose.

Tasks take vectors as they lie in files: there is no shuffle of vectors. A task sends one sum and count for each entry that
its parts use; codebooks (parts x entries, a fixed number) are on the driver.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped, and so are those whose length is no
multiple of the number of parts, or not that of the first vector (smallest id, then smallest vector); integers are clamped
to 2^27 either way, so that squares fit; rows that repeat are coded each, but an id that repeats starts one entry only, by
its smallest vector; rows without id start none, unless there is no other; with fewer ids than entries there are as many
entries as ids; equal entries give way to the lowest index; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Integers are clamped to this, so that squared distances fit in 64 bits.
MOST = 1 << 27
#: Squared distances of smaller integers are exact in doubles, up to 512 components a part.
_EXACT = 1 << 20
_ROWS = 2048

_STATE = ("vec_id", "label", "ints", "entry", "upper", "lower", "scanned")
_STATE_SQL = "vec_id long, label {}, ints array<int>, entry binary, upper array<float>, lower array<float>, scanned int"
_CODED = ("vec_id", "label", "code", "error", "scanned")
_CODED_SQL = "vec_id long, label {}, code string, error long, scanned int"


class Book(NamedTuple):
    """Codebooks, (parts, entries, length); with how far entries moved in the last round, or None where all is new."""

    entries: np.ndarray
    moved: np.ndarray | None = None

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, *, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, ints) of the vectors that take part."""
    x, n = F.col(vector), F.size(vector)
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * 256, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    usable = vectors.where(x.isNotNull()).where((n > 0) & (n % parts == 0) & F.coalesce(finite, F.lit(False)))
    return usable.select(F.col(id_).cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("ints"))


def first_book(rows: DataFrame, parts: int, entries: int) -> Book | None:
    """The parts of the smallest ids' vectors, ascending; of an id that repeats, its smallest. No shuffle of vectors."""
    found: dict[int, list[int]] = {}
    by_id = rows.select("vec_id", "ints").where(F.col("vec_id").isNotNull())
    some = by_id.orderBy("vec_id", "ints").limit(1).collect() or rows.select("vec_id", "ints").orderBy("ints").limit(1).collect()
    if not some:
        return None
    of_length = by_id.where(F.size("ints") == len(some[0].ints)).orderBy("vec_id", "ints")
    next_ = of_length.limit(entries).collect()
    while next_ and len(found) < entries:
        for r in next_:
            if len(found) < entries:
                found.setdefault(r.vec_id, r.ints)
        next_ = of_length.where(F.col("vec_id") > max(found)).limit(entries).collect() if len(found) < entries and len(next_) == entries else []
    first = list(found.values()) or [some[0].ints]
    return Book(np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy())


# Work on a batch of vectors, in tasks. x: (vectors, parts, length) integers.


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (vectors, entries) of one part position, exact."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < _EXACT:
        a, b = x.astype(float), book.astype(float)
        return np.rint((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return ((x[:, None, :] - book) ** 2).sum(2)


def _out(d: np.ndarray, sign: int) -> np.ndarray:
    """Roots of squared distances as floats, rounded up (1) or down (-1)."""
    root = np.sqrt(d.astype(float)) * (1 + sign * 1e-12)
    return np.nextafter(root.astype(np.float32), np.float32(sign * np.inf)).clip(min=0)


def _half_gaps(book: np.ndarray) -> np.ndarray:
    """Half the distance of each entry to its nearest other one, rounded down: (parts, entries)."""
    gaps = np.full(book.shape[:2], np.inf, np.float32)
    for p, own in enumerate(book):
        d = _squares(own, own)
        if len(own) > 1:
            np.fill_diagonal(d, np.iinfo(np.int64).max)
            gaps[p] = _out(d.min(1), -1) / 2 * (1 - 1e-6)
    return gaps


def _assign(x: np.ndarray, book: Book, old: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entry, exact squared distance to it, lower bound of the second, and parts scanned of each vector."""
    n, parts, _ = x.shape
    entry, lower = np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32)
    exact, scanned = np.zeros((n, parts), np.int64), np.zeros(n, np.int32)
    gaps = None if old is None else _half_gaps(book.entries)
    for p in range(parts):
        scan = np.ones(n, bool)
        if old is not None:
            entry[:, p] = at = old[0][:, p]
            moved = book.moved[p]
            order = np.argsort(moved)
            most, second = moved[order[-1]], moved[order[-2]] if len(moved) > 1 else np.float32(0)
            fallen = old[2][:, p] - np.where(at == order[-1], second, most)
            lower[:, p] = np.nextafter(fallen.astype(np.float32), np.float32(-np.inf)).clip(min=0)
            upper = np.nextafter((old[1][:, p] + moved[at]).astype(np.float32), np.float32(np.inf))
            bound = np.maximum(lower[:, p], gaps[p][at])
            exact[:, p] = ((x[:, p] - book.entries[p][at]) ** 2).sum(1)
            scan = ~(upper < bound) & ~(_out(exact[:, p], 1) < bound)
        if scan.any():
            d = _squares(x[scan, p], book.entries[p])
            best = d.argmin(1)
            rows = np.arange(len(d))
            entry[scan, p], exact[scan, p] = best, d[rows, best]
            d[rows, best] = np.iinfo(np.int64).max
            lower[scan, p] = _out(d.min(1), -1) if d.shape[1] > 1 else np.inf
            scanned += scan
    return entry, exact, lower, scanned


def _batches(batches: Iterable[pa.RecordBatch], book: Book) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple | None]]:
    """Portions of bounded size, their integers and their old state."""
    parts, _, length = book.entries.shape
    flat = lambda c, kind: np.asarray(c.flatten()).astype(kind, copy=False).reshape(len(c), -1)
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            b = whole.slice(at, _ROWS)
            x = flat(b.column("ints"), np.int64).reshape(-1, parts, length)
            old = None
            if "entry" in b.schema.names:
                entry = np.frombuffer(b"".join(b.column("entry").to_pylist()), np.uint8).reshape(-1, parts)
                old = entry, flat(b.column("upper"), np.float32), flat(b.column("lower"), np.float32)
            yield b, x, old


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def _state(book: Book) -> Callable:
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, old in _batches(batches, book):
            entry, exact, lower, scanned = _assign(x, book, old)
            codes = pa.array([e.tobytes() for e in entry], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "ints")), codes, _lists(_out(exact, 1)), _lists(lower), pa.array(scanned)], names=_STATE)

    return step


def _codes(book: Book) -> Callable:
    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x, old in _batches(batches, book):
            entry, exact, _, scanned = _assign(x, book, old)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([e.tobytes().hex() for e in entry]), pa.array(exact.sum(1)), pa.array(scanned)], names=_CODED)

    return step


def _sums(book: Book) -> Callable:
    """For each entry that a task's parts use: their number and sums."""
    parts, entries, length = book.entries.shape

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, length), np.int64)
        for _, x, old in _batches(batches, book):
            for p in range(parts):
                np.add.at(total[p], old[0][:, p], x[:, p])
                n[p] += np.bincount(old[0][:, p], minlength=entries)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), _lists(total[p, e])], names=["part", "entry", "n", "total"])

    return step


# Rounds.


def _next_book(state: DataFrame, book: Book) -> Book:
    """Entries as the floored means of their parts; those without parts stay."""
    length = book.entries.shape[2]
    sums = state.mapInArrow(_sums(book), "part long, entry long, n long, total array<long>")
    merged = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(length))).alias("total")).collect()
    new = book.entries.copy()
    for r in merged:
        new[r.part, r.entry] = np.array([t // r.n for t in r.total], np.int64)
    return Book(new, _out(((new - book.entries) ** 2).sum(2), 1))


def codes(vectors: DataFrame, *, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Book | None]:
    """(vec_id, label, code, error, scanned) of each vector, and the final codebooks; scanned: parts that the last assignment scanned whole.

    ``entries`` is 256 at most. Reads the vectors once and the state twice a round.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rows = cut(integers(vectors, id_=id_, vector=vector, label=label, parts=parts))
    book = first_book(rows, parts, entries)
    kind = rows.schema["label"].dataType.simpleString()
    if book is None:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), _CODED_SQL.format(kind)), None
    state = rows.where(F.size("ints") == book.entries.shape[0] * book.entries.shape[2])
    for _ in range(rounds):
        state = cut(state.mapInArrow(_state(book), _STATE_SQL.format(kind)))
        book = _next_book(state, book)
    return state.mapInArrow(_codes(book), _CODED_SQL.format(kind)), book


def with_label_error(coded: DataFrame) -> DataFrame:
    """With the errors summed over equal labels, nulls together. The sums are combined before they are shuffled."""
    coded = cut(coded)
    sums = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    sums = cut(sums)
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same"))).drop("same")
