"""Best-fit packing of token sequences.

Bounded-space online best fit: at most `open_bins` bins are open; a bitset has a bit for every free space that some
open bin has, so the tightest bin that still holds a piece is the lowest set bit at or above the piece's length. When
a new bin is needed and all are open, the fullest closes.

Tokenising is one Arrow pass over the texts. Only the pieces (some 50 bytes each) are shuffled, by a hash of all they
have (ids, place and checksum), so a hot source and rows without a doc_id spread evenly; the partition count follows the
data (adaptive coalescing). Within a
partition pieces are ordered by that hash, hence a retried task packs identically, and each look-ahead block of
`block` pieces goes in by falling length.

Defined cases: null and empty texts give one piece holding only the end id; a null doc_id is kept; repeated rows are
packed once each; a table without rows gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import tidy_rows
from tessera.llm.lookup_tokens import LookupEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Bounded-space online best-fit over bins of `capacity`."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bits = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.n_open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            stack = self.bins[free]
            at = stack.pop()
            if not stack:
                self.free_bits ^= 1 << free
            self.n_open -= 1
        else:
            if self.n_open >= self.open_bins:
                self._close_fullest()
            free, at = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if not self.bins[left]:
                self.free_bits |= 1 << left
            self.bins[left].append(at)
            self.n_open += 1
        return at, self.capacity - free

    def _close_fullest(self) -> None:
        free = (self.free_bits & -self.free_bits).bit_length() - 1
        self.bins[free].pop()
        if not self.bins[free]:
            self.free_bits ^= 1 << free
        self.n_open -= 1


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids and the end id, cut only where longer than `capacity` (schema PIECES)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LookupEncoder.of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for col, x in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(x)
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy_rows(cut), PIECES)


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 1 << 16, block: int = 1 << 16) -> DataFrame:
    """Place rows that have a `length` (1..capacity): adds sequence_id and offset."""
    names = pieces.columns
    at_length = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer = BestFit(capacity, open_bins)
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held).drop_columns(["_order"]).combine_chunks()
                held.clear()
                sizes = table.column(at_length).to_numpy()
                where = np.empty((2, len(sizes)), np.int64)
                for i in np.argsort(-sizes, kind="stable").tolist():
                    where[:, i] = packer.place(int(sizes[i]))
                table = table.append_column("sequence_id", pa.array(where[0] + base)).append_column("offset", pa.array(where[1]))
                yield from table.to_batches()

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                yield from flush()
                n = 0
        yield from flush()

    # by everything a piece has, so that rows without a doc_id, or of one doc_id, are dealt out as well
    dealt = pieces.withColumn("_order", F.xxhash64(*names)).repartition("_order").sortWithinPartitions("_order", *names)
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.mapInArrow(tidy_rows(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens: one row per piece."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity)
