"""Shared plumbing of the corpus operators: scratch tables, Arrow text access, byte-level word hashing, census rounds."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_run = f"tessera-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset the warehouse, in local mode a temporary
    folder that goes with the process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(__import__("shutil").rmtree, _own_dir[0], True)
    return "file://" + _own_dir[0]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder, for files that tasks write themselves; `release` removes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_run}/{name}-{uuid.uuid4().hex}")
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


_tables: list[str] = []  # folders written and not removed, oldest first


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors.

    All tables of one process lie in one folder; `only`, `discard` and `release` remove them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_run}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the order of written tables, for `only`."""
    return len(_tables)


def tables_since(since: int) -> list[str]:
    """The tables written since a mark that are still there."""
    return _tables[since:]


def remove(spark: SparkSession, paths: list[str], *unless: DataFrame) -> None:
    """Remove written tables, and their names from the list, unless one of the given frames reads them."""
    kept = _tables_of(unless) if paths else set()
    for path in list(paths):
        if path not in kept:
            if path in _tables:
                _delete(spark, path)
                _tables.remove(path)
            paths.remove(path)


def only(since: int, *tables: DataFrame) -> None:
    """Of the tables written since a mark remove all but those that the given ones read."""
    remove(tables[0].sparkSession, tables_since(since), *tables)


def _tables_of(frames: tuple[DataFrame, ...]) -> set[str]:
    """Which written tables the given frames read, whatever else they read."""
    names = {p.rsplit("/", 1)[1]: p for p in _tables}
    folders = {f.rsplit("/", 2)[-2] for frame in frames for f in frame.inputFiles()} if names else set()
    return {names[f] for f in folders & names.keys()}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Remove a table of `written` that nothing reads any more."""
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for folder in folders:
        _delete(table.sparkSession, folder)
        _tables[:] = [t for t in _tables if t.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]


def release(spark: SparkSession) -> None:
    """Remove every table this process has written: results are read from them, so call it when those are stored."""
    _delete(spark, f"{shared_dir(spark)}/{_run}")
    _tables.clear()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_MOST_BITS = 1 << 26  # 8 MB


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bit table that holds every given doc_id, some 16 bits for each and 8 MB at most: a read of the texts passes
    these and a share of others, which the join then drops. A full table passes more, never less."""
    n = ids.count()
    bits = min(_MOST_BITS, 1 << max(16, (16 * n).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("m")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return table


# ---------------------------------------------------------------- memory of tasks

BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on tasks of the session send workers Arrow batches of some 4 MB at most (a longer row goes alone), as a batch
    is held on both sides at once; a lower limit that was set stays."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Return to the system what this process has freed. Workers live on after a task, and several of an executor share its
    memory; the allocators of Arrow and C would keep the most that a task ever used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy_rows(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: work, then `give_back`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def tidy_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow on groups: work, then `give_back`."""

    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        give_back()
        return out

    return run


def tidy_pair(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For applyInArrow on cogroups: work, then `give_back`."""

    def run(table: pa.Table, other: pa.Table) -> pa.Table:
        out = work(table, other)
        give_back()
        return out

    return run


# ---------------------------------------------------------------- Arrow text access


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each slice holds about `limit` bytes of text (one longer text stays whole)."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.concatenate([[0], np.cumsum(pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows in them; null counts as empty."""
    col = pa.compute.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


# ---------------------------------------------------------------- words and their hashes

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_NAME = 0xD6E8FEB86659FD93
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LONG = 16
Key = tuple[int, int]


def new_key() -> Key:
    """A key for the word names of one run."""
    return secrets.randbits(64), secrets.randbits(64)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a text column: byte spans, owning row and names.

    `space` tells the separating bytes; fold lower-cases A-Z first. A word's name is 128 bits in two lanes, `hash` and
    `check`: words of up to 16 bytes are two integers and a length, mixed in each lane with a number of the key; longer ones
    are hashed by BLAKE2b under the key. Equal words have equal names whatever the batch. Names under the fixed key are for
    choosing only, as whoever knows it can build words of one name; what is verified by name takes a key of `new_key`,
    drawn for the run, so that no text can have been made for it.
    Beside the text this keeps some bytes a byte and a few numbers a word."""

    def __init__(self, col: pa.Array, fold: bool = False, space: np.ndarray = SPACE, key: Key = (_NAME, _NAME << 1 & 2**64 - 1)):
        data, off = text_bytes(col)
        self.data, self.offsets, self.rows = data, off, len(off) - 1
        n = len(data)
        word = ~space[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        before[1:] = word[:-1]
        before[:1] = False
        self.starts = np.flatnonzero(word & (edge[:n] | ~before))
        after = np.empty(n, bool)
        after[:-1] = word[1:]
        after[n - 1 :] = False
        self.ends = np.flatnonzero(word & (edge[1:] | ~after)) + 1
        self.row = np.searchsorted(off, self.starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows)[: self.rows]
        self.first = np.concatenate([[0], np.cumsum(self.counts)])  # words of row r: first[r]..first[r+1]
        self.key = key
        self._padded = np.concatenate([_FOLD[data] if fold else data, np.zeros(2 * _LONG, np.uint8)])
        self.hash, self.check = self._named(self.ends - self.starts)

    def _named(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both lanes of the first `length` bytes of each word."""
        eight = np.lib.stride_tricks.sliding_window_view(self._padded, 8)
        halves = []
        for at in (0, 8):
            got = eight[self.starts + at].view("<u8")[:, 0]
            halves.append(got & _LOW_BYTES[np.clip(length - at, 0, 8)])
        size = length.astype(np.uint64)
        lanes = [mix(halves[0] ^ mix(halves[1] ^ mix(size + np.uint64(seed)))) for seed in self.key]
        long = np.flatnonzero(length > _LONG)
        if len(long):
            stops = (self.starts[long] + length[long]).tolist()
            secret = b"".join(k.to_bytes(8, "little") for k in self.key)
            whole = [hashlib.blake2b(self._padded[a:b], digest_size=16, key=secret).digest() for a, b in zip(self.starts[long].tolist(), stops, strict=True)]
            digest = np.frombuffer(b"".join(whole), "<u8").reshape(-1, 2)
            for k in (0, 1):
                lanes[k][long] = digest[:, k]
        return lanes[0], lanes[1]

    def names(self) -> np.ndarray:
        """One name of 64 bits a word, of both lanes."""
        return mix(self.hash * np.uint64(_NAME) + self.check)

    def prefixes(self, k: int) -> np.ndarray:
        """Names of the words' first k bytes (of all, where shorter)."""
        return self._named(np.minimum(self.ends - self.starts, k))[0]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive names of k consecutive values; entry i covers i..i+k-1 (crosses rows: the caller masks).

    Stretches are doubled, each step mixed, and the stretches of k's binary digits joined."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, width, power = None, 0, 1, h
    while True:
        if k & width:
            part = power[done : done + n]
            out = part if out is None else mix(out * np.uint64(_NAME) + part)
            done += width
        if 2 * width > k:
            return mix(out + np.uint64(k))
        power = mix(power[:-width] * np.uint64(_NAME + 2 * width) + power[width:])
        width *= 2


# ---------------------------------------------------------------- census rounds
# A shard is a set of rows that is dealt to one group; each shard sends its sorted distinct names to the buckets of the name
# space, a bucket merges what all shards sent and answers each shard with the names that two or more documents hold. A shard
# sends a name once however many documents hold it, so a hot name costs one entry a shard. Shards and buckets are sized by
# bytes (`shards_for`), so a group's memory does not depend on the number of shuffle partitions.

ASK = "bucket int, shard int, names binary, checks binary, docs binary, least binary"
ANSWER = "shard int, names binary, checks binary, docs binary, least binary"
SHARD_BYTES = 1 << 26


def shards_for(spark: SparkSession, n_bytes: int | None) -> int:
    """How many shards of about SHARD_BYTES, one a shuffle partition at least."""
    return min(2**31 - 1, max(partitions(spark), -(-(n_bytes or 0) // SHARD_BYTES)))


def _cells(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[name]])


def ask_rows(shard: int, buckets: int, names: np.ndarray, docs: np.ndarray, checks: np.ndarray | None = None, least: np.ndarray | None = None) -> pa.Table:
    """One row a bucket from a shard's distinct names (with second lanes), how many documents hold each (bytes or 32-bit
    integers) and the smallest doc_id."""
    to = (names % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    ends = np.flatnonzero(np.diff(to[order], append=-1)) + 1 if len(to) else np.empty(0, np.int64)
    cuts = list(zip(np.concatenate([[0], ends[:-1]]).astype(int).tolist(), ends.tolist(), strict=True)) if len(ends) else []
    columns = [None if c is None else c[order] for c in (names, checks, docs, least)]
    cells = [pa.array([None if c is None else c[i:j].tobytes() for i, j in cuts], pa.binary()) for c in columns]
    keep = to[order][[i for i, _ in cuts]] if cuts else []
    return pa.table([pa.array(keep, pa.int32()), pa.array([shard] * len(cuts), pa.int32()), *cells], names=["bucket", "shard", "names", "checks", "docs", "least"])


def _bucket(table: pa.Table) -> pa.Table:
    """Answers of one bucket. Where smallest doc_ids were sent, a shard only hears of names that a document smaller than one
    of its own holds."""
    sizes = [len(x.as_py()) // 8 for x in table["names"]]
    names = _cells(table, "names", np.uint64)
    width = len(table["docs"][0].as_py()) // max(1, sizes[0])
    docs = _cells(table, "docs", np.uint8 if width == 1 else np.uint32).astype(np.int64)
    checks = _cells(table, "checks", np.uint64) if table["checks"].null_count == 0 else None
    least = _cells(table, "least", np.int64) if table["least"].null_count == 0 else None
    order = np.argsort(names, kind="stable") if checks is None else np.lexsort((checks, names))
    new = np.ones(len(names), bool)
    new[1:] = names[order[1:]] != names[order[:-1]]
    if checks is not None:
        new[1:] |= checks[order[1:]] != checks[order[:-1]]
    first = np.flatnonzero(new)
    group = np.empty(len(names), np.int64)
    group[order] = np.cumsum(new) - 1
    total = np.add.reduceat(docs[order], first)[group]
    told = total >= 2
    if least is not None:
        smallest = np.minimum.reduceat(least[order], first)[group]
        told &= (least > smallest) | (docs >= 2)
    out: dict[str, list] = {"shard": [], "names": [], "checks": [], "docs": [], "least": []}
    stop = 0
    for shard, size in zip(table["shard"].to_pylist(), sizes, strict=True):
        start, stop = stop, stop + size
        pick = start + np.flatnonzero(told[start:stop])
        if len(pick):
            out["shard"].append(shard)
            out["names"].append(names[pick].tobytes())
            out["checks"].append(None if checks is None else checks[pick].tobytes())
            out["docs"].append(np.minimum(total[pick], 2**32 - 1).astype(np.uint32).tobytes() if width == 4 else None)
            out["least"].append(None if least is None else smallest[pick].tobytes())
    return pa.table([pa.array(out["shard"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("names", "checks", "docs", "least"))], names=list(out))


def census(asked: DataFrame) -> DataFrame:
    """The names that two or more documents hold, answered to every shard that sent them (schema ANSWER)."""
    return asked.groupBy("bucket").applyInArrow(tidy_group(_bucket), ANSWER)


class Answers:
    """A shard's answers, sorted by name."""

    def __init__(self, table: pa.Table):
        some = table.num_rows > 0
        has = lambda c: some and table[c].null_count == 0
        self.names = _cells(table, "names", np.uint64) if some else np.empty(0, np.uint64)
        checks = _cells(table, "checks", np.uint64) if has("checks") else None
        order = np.argsort(self.names, kind="stable") if checks is None else np.lexsort((checks, self.names))
        self.names = self.names[order]
        self.checks = None if checks is None else checks[order]
        self.docs = _cells(table, "docs", np.uint32)[order] if has("docs") else None
        self.least = _cells(table, "least", np.int64)[order] if has("least") else None

    def find(self, names: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """Positions among the answers, -1 where absent."""
        at = lookup(self.names, names)
        if checks is None or not len(self.names):
            return at
        while True:  # on to the next of equal first lanes, as long as the second lane differs
            off = (at >= 0) & (self.checks[at] != checks)
            if not off.any():
                return at
            on = np.minimum(at + 1, len(self.names) - 1)
            at = np.where(off, np.where((at + 1 < len(self.names)) & (self.names[on] == names), on, -1), at)


def lookup(sorted_names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of wanted in sorted_names, -1 where absent."""
    if not len(sorted_names):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_names, wanted), len(sorted_names) - 1)
    return np.where(sorted_names[at] == wanted, at, -1)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a long, b long): rows (node, root), root the smallest node of the component.

    Each round points every node at the smallest neighbour of its smallest neighbour, contracts the edges and repeats until
    no edge is left (every round merges each node that still has one, so there are at most log2 of their number). Only
    minima are aggregated, so a node of very high degree is combined before the shuffle and never gathered."""
    spark = edges.sparkSession
    pairs = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    roots, steps = None, []
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("b"))
        far = near.select(F.col("a").alias("b"), F.col("b").alias("to"))
        to = written(near.join(far, "b").select(F.col("a").alias("node"), "to"), "pointers")
        steps.append(to)
        if to.isEmpty():
            settled = spark.createDataFrame([], "node long, root long") if roots is None else written(roots, "roots")
            for old in (pairs, *steps):
                discard(old)
            return settled
        step = to.select(F.col("node").alias("root"), "to")
        roots = to.select("node", F.col("to").alias("root")) if roots is None else roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        left = to.select(F.col("node").alias("a"), F.col("to").alias("na"))
        right = to.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        contracted = written(pairs.join(left, "a").join(right, "b").where("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), "edges")
        discard(pairs)
        pairs = contracted
