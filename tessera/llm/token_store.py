"""Token-id files with a minimal perfect hash index.

A store is a folder of shard files, a table `shards` (one row a shard) and a table `index` (one row a bucket of keys).

* A shard file holds raw ids, little-endian, of 2 bytes where the vocabulary allows it and of 4 otherwise, document after
  document; then the documents' offsets (64 bits, in ids, one more than documents) and a footer of the numbers of
  documents and ids, the width and a mark. Shards, and documents inside them, follow ascending doc_id.
* The index maps a doc_id to the shard and row of its first document and to how many it has (they follow each other, over
  shards if need be). Keys are dealt to buckets of some 2**10 by a hash; each bucket has a minimal perfect hash by hashing
  and displacing: groups of three keys on average, the largest first, each with the first seed that sends its keys to
  free slots (groups of one key name their slot). A slot stores the key's fingerprint of 64 bits, so a key that the store
  doesn't hold is told from one that it does. A look-up is one seed, one slot, one comparison and one read.

Writing: one JVM pass for counts, a sample of 20 doc_ids a shard for the ranges, one Arrow pass that encodes, one exchange of
ids by shard, and a task a shard that streams its documents to the file. Files bear a name of their own for each attempt and
the written table names those of the attempts that count, so lost executors do no harm. Tasks open files by pyarrow's file systems, so the
store's folder must be on one that these reach (local or shared folders, HDFS, S3 and the like).

Reading by key: keys meet the index by bucket, the places found are sorted by shard and row, and each task reads ranges
of its shards' files; ids are never shuffled.

What the driver holds is one entry a shard (of some 64 MB of text), and 20 sampled doc_ids a shard while writing.

Defined cases: null and empty texts have the end id only; null doc_ids come first and are a key like any other; rows of one
doc_id, repeated ones too, are documents each, in the order of their ids; such a group may fill many shards; texts are
taken whole; a table without rows gives a store without documents; only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import mix, scratch_folder, shards_for, text_slices, written
from tessera.llm.lookup_tokens import LookupEncoder

MARK = b"TESSERA1"
_FOOTER = 32
_LEAST = np.iinfo(np.int64).min
_BUCKET = 1 << 10
_DIRECT = 1 << 31  # a seed with this bit is the slot itself
_WRITTEN = "shard int, doc_id long, row long, n long, file string, ids long"
_INDEX = "bucket int, n int, seeds binary, prints binary, shards binary, rows binary, counts binary"


# ---------------------------------------------------------------- shard files


def _files(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


class ShardWriter:
    """One shard file, written front to back."""

    def __init__(self, folder: str, shard: int, width: int):
        self.name = f"shard-{shard:08d}-{uuid.uuid4().hex}.ids"
        fs, place = _files(folder)
        self.out = fs.open_output_stream(f"{place}/{self.name}")
        self.width, self.offsets = width, [0]

    def add(self, ids: bytes) -> None:
        self.out.write(ids)
        self.offsets.append(self.offsets[-1] + len(ids) // self.width)

    def close(self) -> None:
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([len(self.offsets) - 1, self.offsets[-1], self.width], "<u8").tobytes() + MARK)
        self.out.close()


class ShardReader:
    """Ranges of documents of one shard file."""

    def __init__(self, folder: str, name: str):
        fs, place = _files(folder)
        self.file = fs.open_input_file(f"{place}/{name}")
        size = self.file.size()
        foot = self.file.read_at(_FOOTER, size - _FOOTER)
        if foot[24:] != MARK:
            raise ValueError(f"{name} is no shard file")
        n, _, self.width = np.frombuffer(foot[:24], "<u8").tolist()
        self.offsets = np.frombuffer(self.file.read_at(8 * (n + 1), size - _FOOTER - 8 * (n + 1)), "<u8").astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of documents first to last - 1."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


# ---------------------------------------------------------------- the minimal perfect hash of a bucket


def _lanes(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes of a key, both one-to-one on 64-bit integers; a null key has a pair that no integer has."""
    x = keys.view(np.uint64)
    a, b = mix(x ^ np.uint64(0x9E3779B97F4A7C15)), mix(x ^ np.uint64(0xC2B2AE3D27D4EB4F))
    return np.where(known, a, np.uint64(0)), np.where(known, b, mix(np.array([0x9E3779B97F4A7C15 ^ 0xC2B2AE3D27D4EB4F], np.uint64))[0] ^ np.uint64(1))


def _slots(b: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix(b + seeds.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(n)).astype(np.int64)


def _groups(n: int) -> int:
    return max(1, -(-n // 3))


def perfect_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Seeds (32 bits a group) that send n distinct keys, given by their lanes, to n distinct slots."""
    n, groups = len(a), _groups(len(a))
    group = (a % np.uint64(groups)).astype(np.int64)
    by = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    start = np.cumsum(sizes) - sizes
    seeds = np.zeros(groups, np.uint32)
    free = np.ones(n, bool)
    order = np.argsort(-sizes, kind="stable")
    for g in order[sizes[order] > 1].tolist():
        keys = b[by[start[g] : start[g] + sizes[g]]]
        at, step = 1, 64
        while True:
            tried = np.arange(at, at + step, dtype=np.uint32)
            slots = np.sort(_slots(keys[None, :], tried[:, None], n), axis=1)
            fits = free[slots].all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
            if fits.any():
                k = int(fits.argmax())
                seeds[g], free[slots[k]] = tried[k], False
                break
            at, step = at + step, min(4096, 4 * step)
    single = np.flatnonzero(sizes == 1)
    seeds[single] = np.flatnonzero(free)[: len(single)].astype(np.uint32) | np.uint32(_DIRECT)
    return seeds


def hash_slots(a: np.ndarray, b: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of every key in a bucket of n."""
    seed = seeds[(a % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(seed & np.uint32(_DIRECT), (seed & np.uint32(_DIRECT - 1)).astype(np.int64), _slots(b, seed, n))


def _key_lanes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table["doc_id"].combine_chunks()
    return _lanes(pa.compute.fill_null(column, 0).to_numpy(zero_copy_only=False), pa.compute.is_valid(column).to_numpy(zero_copy_only=False))


def _index_bucket(table: pa.Table) -> pa.Table:
    a, b = _key_lanes(table)
    seeds = perfect_hash(a, b)
    order = np.argsort(hash_slots(a, b, seeds, len(a)))
    cells = [seeds.astype("<u4"), a[order].astype("<u8"), *(table[c].to_numpy()[order].astype(kind) for c, kind in (("shard", "<i4"), ("row", "<i8"), ("n", "<i8")))]
    return pa.table([pa.array([table["bucket"][0].as_py()], pa.int32()), pa.array([len(a)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], names=["bucket", "n", "seeds", "prints", "shards", "rows", "counts"])


def _find(keys: pa.Table, index: pa.Table) -> pa.Table:
    """Where the keys of a bucket lie, without those that the store does not hold."""
    names, kinds = ("seeds", "prints", "shards", "rows", "counts"), ("<u4", "<u8", "<i4", "<i8", "<i8")
    if not keys.num_rows or not index.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=["doc_id", "shard", "row", "n"])
    seeds, prints, *values = (np.frombuffer(index[c][0].as_py(), kind) for c, kind in zip(names, kinds, strict=True))
    a, b = _key_lanes(keys)
    slot = hash_slots(a, b, seeds, len(prints))
    hit = prints[slot] == a
    at = slot[hit]
    return pa.table([keys["doc_id"].combine_chunks().filter(pa.array(hit)), *(pa.array(v[at]) for v in values)], names=["doc_id", "shard", "row", "n"])


# ---------------------------------------------------------------- writing


@dataclass
class Store:
    """A folder of shard files with its tables. shards: shard, file, docs, ids, docs_before, ids_before."""

    path: str
    shards: DataFrame
    index: DataFrame
    buckets: int


def _id_width(tokenizer: str, end_id: int) -> int:
    return 2 if max(LookupEncoder.of(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def _range_of(ids: np.ndarray, known: np.ndarray, splits: np.ndarray, counter: int) -> np.ndarray:
    """The shard of each row: ranges between the splits; a doc_id that is a split of several ranges is dealt over all of these
    in turn (its documents follow each other all the same)."""
    key = np.where(known, ids, _LEAST)
    low, high = np.searchsorted(splits, key, "left"), np.searchsorted(splits, key, "right")
    low = np.where(known & (ids == _LEAST), high, low)  # the least integer comes after all nulls
    turn = counter + np.arange(len(ids))
    return low + turn % (high - low + 1)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> Store:
    """Encode every whole text, end it with `end_id` and write it, by ascending doc_id, to a new store."""
    spark = docs.sparkSession
    path = path or scratch_folder(spark, "tokens")
    fs, place = _files(path)
    fs.create_dir(f"{place}/files", recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    n, n_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = shards_for(spark, n_bytes)
    sample = rows.select(F.coalesce("doc_id", F.lit(int(_LEAST))).alias("k")).sample(min(1.0, 20 * shards / max(1, n)), seed=7).toArrow()
    keys = np.sort(sample["k"].to_numpy())
    splits = keys[(np.arange(1, shards) * len(keys)) // shards] if len(keys) else keys
    width, folder = _id_width(tokenizer, end_id), f"{path}/files"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, counter = LookupEncoder.of(tokenizer), np.array([end_id], f"<u{width}").tobytes(), 0
        for whole in batches:
            for batch in text_slices(whole):
                column = batch.column(0)
                known = pa.compute.is_valid(column).to_numpy(zero_copy_only=False)
                to = _range_of(pa.compute.fill_null(column, 0).to_numpy(zero_copy_only=False), known, splits, counter)
                counter += batch.num_rows
                ids = [np.frombuffer(encoder.ids(t.as_py() or ""), "<u4").astype(f"<u{width}").tobytes() + end for t in batch.column(1)]
                yield pa.record_batch([pa.array(to.astype(np.int32)), column, pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, open_shard = None, -1
        empty = lambda k, kind: pa.nulls(k, kind)

        def closed() -> pa.RecordBatch:
            out.close()
            cells = [[open_shard], [None], [None], [len(out.offsets) - 1], [out.name], [out.offsets[-1]]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["shard", "doc_id", "row", "n", "file", "ids"])

        for batch in batches:
            to, at = batch.column(0).to_numpy(), []
            for shard, ids in zip(to.tolist(), batch.column(2), strict=True):
                if shard != open_shard:
                    if out is not None:
                        yield closed()
                    out, open_shard = ShardWriter(folder, shard, width), shard
                at.append(len(out.offsets) - 1)
                out.add(ids.as_buffer())
            k = batch.num_rows
            columns = [batch.column(0), batch.column(1), pa.array(at, pa.int64()), pa.array(np.ones(k, np.int64)), empty(k, pa.string()), empty(k, pa.int64())]
            yield pa.record_batch(columns, names=["shard", "doc_id", "row", "n", "file", "ids"])
        if out is not None:
            yield closed()

    dealt = rows.mapInArrow(encode, "shard int, doc_id long, ids binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    told = written(dealt.mapInArrow(write, _WRITTEN), "token-files")
    files = told.where("file is not null").select("shard", "file", F.col("n").alias("docs"), "ids").orderBy("shard").toArrow()
    before = [np.concatenate([[0], np.cumsum(files[c].to_numpy())[:-1]]) if files.num_rows else np.empty(0) for c in ("docs", "ids")]
    table = files.append_column("docs_before", pa.array(before[0].astype(np.int64))).append_column("ids_before", pa.array(before[1].astype(np.int64)))
    schema = "shard int, file string, docs long, ids long, docs_before long, ids_before long"
    spark.createDataFrame(table.to_pylist(), schema).coalesce(1).write.parquet(f"{path}/shards")
    buckets = max(1, -(-n // _BUCKET))
    heads = told.where("file is null").groupBy("doc_id").agg(F.min(F.struct("shard", "row")).alias("at"), F.sum("n").alias("n"))
    keyed = heads.select(_bucket_of(buckets), "doc_id", "at.shard", "at.row", "n")
    keyed.groupBy("bucket").applyInArrow(_index_bucket, _INDEX).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/index")
    return open_store(spark, path)


def _bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")


def open_store(spark: SparkSession, path: str) -> Store:
    index = spark.read.schema(f"{_INDEX}, buckets int").parquet(f"{path}/index")
    shards = spark.read.schema("shard int, file string, docs long, ids long, docs_before long, ids_before long").parquet(f"{path}/shards")
    first = index.select("buckets").first()
    return Store(path, shards, index.drop("buckets"), first[0] if first else 1)


# ---------------------------------------------------------------- reading


def find_documents(store: Store, keys: DataFrame) -> DataFrame:
    """(doc_id, shard, row, n) of the keys (column doc_id, each once) that the store holds: the first document and how many."""
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).select(_bucket_of(store.buckets), "doc_id")
    return asked.groupBy("bucket").cogroup(store.index.groupBy("bucket")).applyInArrow(_find, "doc_id long, shard int, row long, n long")


def read_tokens(store: Store, keys: DataFrame, most_ids: int = 1 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian, 32 bits each) of every document of the keys.

    At most `most_ids` ids are read at once, or one document."""
    spark = keys.sparkSession
    found = store.shards.orderBy("shard").toArrow()
    numbers = {c: found[c].to_numpy() for c in ("shard", "docs", "docs_before", "ids_before")}
    files, folder = found["file"].to_pylist(), f"{store.path}/files"
    told = spark.sparkContext.broadcast((numbers, files))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of documents, cut where a shard ends."""
        table = told.value[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, row, n = (batch.column(c).to_numpy() for c in ("shard", "row", "n"))
            place = np.searchsorted(table["shard"], shard)
            first = table["docs_before"][place] + row
            last_place = np.searchsorted(table["docs_before"], first + n, "left") - 1
            pieces = last_place - place + 1
            of = np.repeat(np.arange(len(shard)), pieces)
            own = place[of] + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            a = np.maximum(first[of], table["docs_before"][own])
            b = np.minimum(first[of] + n[of], table["docs_before"][own] + table["docs"][own])
            yield pa.record_batch([batch.column(0).take(pa.array(of)), pa.array(own.astype(np.int32)), pa.array(a - table["docs_before"][own]), pa.array(b - a)], names=["doc_id", "place", "row", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = told.value
        shard, opened, held = None, -1, (0, 0, None)
        out: tuple[list, list, list] = ([], [], [])
        size = 0

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "start", "ids"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for doc, place, row, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "row", "n")), strict=True):
                if place != opened:
                    if shard is not None:
                        shard.close()
                    shard, opened, held = ShardReader(folder, names[place]), place, (0, 0, None)
                before, at = int(table["ids_before"][place]), row
                while at < row + n:
                    if not held[0] <= at < held[1]:  # read on from here, as much as is allowed
                        last = max(at + 1, int(np.searchsorted(shard.offsets, shard.offsets[at] + most_ids, "right")) - 1)
                        held = (at, last, shard.ids(at, last).astype("<u4").tobytes())
                    a, b = ((shard.offsets[at : at + 2] - shard.offsets[held[0]]) * 4).tolist()
                    out[0].append(doc)
                    out[1].append(before + int(shard.offsets[at]))
                    out[2].append(held[2][a:b])
                    size, at = size + b - a, at + 1
                    if size > 4 * most_ids:
                        yield flush()
                        size = 0
        if shard is not None:
            shard.close()
        yield flush()

    places = find_documents(store, keys).mapInArrow(spread, "doc_id long, place int, row long, n long")
    dealt = places.repartitionById(max(1, len(files)), F.col("place")).sortWithinPartitions("place", "row")
    return dealt.mapInArrow(read, "doc_id long, start long, ids binary")

