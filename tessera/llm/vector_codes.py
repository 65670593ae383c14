"""Vector code compression: product quantisation with partial-distance search.

A vector's components become integers floor(256 * x); it is cut into equal consecutive parts, and every part is replaced by
the index of the nearest entry of its position's codebook. Codebooks start as the parts of the smallest ids and move to
the floored means of what is assigned to them, for a number of rounds.

The nearest entry is found by partial distances: dimensions are taken in descending variance of the codebook; the entry
nearest in the first of them gives the first complete distance; blocks of entries are then followed dimension by
dimension, a mask dropping an entry as soon as its accumulated integer distance strictly exceeds the best complete one,
which every block lowers. What is dropped is farther than the answer, so the result is exact; ties go to the lower index.

Passes over the vectors: one for the first entries, one per round, one for the codes; no vector is shuffled. A task sends
the sums and counts of its entries only, so what reaches the driver is one row per part, entry and dimension whatever
the input: the codebooks themselves.

Defined cases: vectors that are null, hold a null or a non-finite component, or have no component are dropped; so are those
whose length differs from that of the smallest kept id (which must be a multiple of `parts`; lengths that are none are dropped
first); components are held at +-2**20 after scaling; a null id is kept and comes last in the order of ids; rows of one id
are coded apart, the lesser vector first in the order; with fewer vectors than entries codebooks are shorter; a table
without rows gives no rows; columns beyond id, vector and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import written

LIMIT = 1 << 20
BLOCK = 16


def integers(x: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x), held at +-LIMIT."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


class Codebook:
    """The entries (k x width integers) of one part position, searched by partial distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = np.argsort(-entries.var(axis=0), kind="stable") if len(entries) else np.arange(entries.shape[1])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every row of x."""
        first, rest = self.order[0], self.order[1:]
        start = np.square(x[:, first, None] - self.entries[None, :, first])
        which = start.argmin(axis=1)
        best = np.square(x - self.entries[which]).sum(axis=1)
        for at in range(0, len(self.entries), BLOCK):
            row, entry = np.nonzero(start[:, at : at + BLOCK] <= best[:, None])
            entry += at
            so_far = start[row, entry]
            for dim in rest:
                so_far = so_far + np.square(x[row, dim] - self.entries[entry, dim])
                alive = so_far <= best[row]
                row, entry, so_far = row[alive], entry[alive], so_far[alive]
            order = np.lexsort((entry, so_far, row))
            row, entry, so_far = row[order], entry[order], so_far[order]
            head = np.ones(len(row), bool)
            head[1:] = row[1:] != row[:-1]
            row, entry, so_far = row[head], entry[head], so_far[head]
            better = (so_far < best[row]) | ((so_far == best[row]) & (entry < which[row]))
            best[row[better]], which[row[better]] = so_far[better], entry[better]
        return which, best


@dataclass
class Codebooks:
    """Codebooks of all part positions: an array parts x entries x width."""

    entries: np.ndarray

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def searchers(self) -> list[Codebook]:
        return [Codebook(e) for e in self.entries]


def _kept(vectors: DataFrame, vector: str, id_: str, label: str | None) -> DataFrame:
    """(id, label, vector) of the usable rows."""
    x = F.col(f"`{vector}`").cast("array<double>")
    mark = F.col(f"`{label}`") if label else F.lit(None).cast("int")
    rows = vectors.select(F.col(f"`{id_}`").cast("long").alias("id"), mark.alias("label"), x.alias("vector"))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dimension)


def _first_rows(rows: DataFrame, entries: int) -> list:
    return rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vector: str = "embedding", id_: str = "vec_id") -> Codebooks:
    """The codebooks after `rounds` rounds over all usable vectors."""
    rows = _kept(vectors, vector, id_, None).where(F.size("vector") % parts == 0)
    first = _first_rows(rows, entries)
    if not first:
        return Codebooks(np.empty((parts, 0, 1), np.int64))
    size = len(first[0].vector)
    if any(len(r.vector) != size for r in first):
        first = _first_rows(rows.where(F.size("vector") == size), entries)
    width = size // parts
    start = integers(np.array([r.vector for r in first])).reshape(len(first), parts, width)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    own = rows.where(F.size("vector") == size).select("vector")
    for _ in range(rounds):
        books = _moved(own, books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every used entry at the floored mean of the parts assigned to it."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = books.searchers()
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for x in _slices(batches, "vector", books.dimension):
            for p, book in enumerate(searchers):
                part = x[:, p * width : (p + 1) * width]
                which, _ = book.nearest(part)
                counts[p] += np.bincount(which, minlength=entries)
                for place in range(width):  # a slice's sums are below 2**53, so exact
                    sums[p, :, place] += np.bincount(which, weights=part[:, place], minlength=entries).astype(np.int64)
        p, e = np.nonzero(counts)
        cells = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), np.repeat(counts[p, e], width), sums[p, e].ravel()]
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in cells], names=["part", "entry", "place", "n", "total"])

    told = rows.mapInArrow(run, "part long, entry long, place long, n long, total long")
    moved = books.entries.copy()
    for r in told.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        moved[r.part, r.entry, r.place] = r.total // r.n
    return Codebooks(moved)


def _slices(batches: Iterator[pa.RecordBatch], vector: str, dimension: int, rows: int = 2048) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield _matrix(batch.slice(at, rows).column(batch.schema.get_field_index(vector)), dimension)


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding", id_: str = "vec_id", label: str | None = "label") -> DataFrame:
    """id, label, codes (a byte per part), error (squared distance summed over parts) of every usable vector."""
    parts, entries, width = books.entries.shape
    if entries > 256:
        raise ValueError("a code is one byte")
    size = books.dimension if entries else -1
    rows = _kept(vectors, vector, id_, label).where(F.size("vector") == size)
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = books.searchers()
        for batch in batches:
            codes, error = np.empty((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            at = 0
            for x in _slices(iter([batch]), "vector", size):
                for p, book in enumerate(searchers):
                    which, far = book.nearest(x[:, p * width : (p + 1) * width])
                    codes[at : at + len(x), p] = which
                    error[at : at + len(x)] += far
                at += len(x)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), packed, pa.array(error)], names=["id", "label", "codes", "error"])

    return rows.mapInArrow(run, f"id long, label {kind}, codes binary, error long")


def decode(codes: DataFrame, books: Codebooks, scale: float = 256.0) -> DataFrame:
    """(id, vector) from (id, codes): every component the middle of the cell that its entry names."""
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            cells = (books.entries[np.arange(parts), at] + 0.5) / scale
            yield pa.record_batch([batch.column(0), pa.array(list(cells.reshape(len(at), parts * width)), pa.list_(pa.float64()))], names=["id", "vector"])

    return codes.select("id", "codes").mapInArrow(run, "id long, vector array<double>")


def label_errors(coded: DataFrame) -> DataFrame:
    """Columns of coded with label_error: the error summed over equal labels, nulls together (null beyond a long)."""
    sums = written(coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error")), "label-errors")
    return coded.join(sums.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def hex_code(codes: str = "codes") -> Column:
    """Two lowercase hex digits a part."""
    return F.lower(F.hex(codes))
