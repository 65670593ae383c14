"""N-gram Jaccard join: exact near-duplicate classes by a grouped prefix join.

Sets are distinct k-word shingles of lower-cased words, named by 64 bits of both lanes of the words' names under a key that
is drawn for the run (a count is wrong only if two of the shingles of one pair of documents share a name by chance). Two
sets with Jaccard similarity >= t share a token among the first n - ceil(t*n) + 1 of each in any common total order. The
order here is (hash tier, document frequency, hash): the tier comes from the hash alone and tier 0 holds about 2.5 times
as many tokens as a prefix needs, so only a fraction of the tokens is ever counted, yet prefixes consist of each
document's rarest tokens there.

1. One Arrow pass turns texts into sets; documents with equal sets are one unit from then on (one row per partition
   and unit carries its low tokens, so a hot copy is combined before any shuffle). A unit is named by 128 bits of a
   cryptographic hash; should two units share the first 64, both are named anew (`settle_names`).
2. A census round counts the low tokens over all units; tokens of a single unit can make no candidate and are dropped.
3. Units with identical (size, prefix) collapse into one group. Groups meet through (prefix token, size band). Group pairs
   there must pass the size filter and the positional filter (tokens left after the shared one must suffice for the
   overlap); of the pairs that pass only a spanning forest is kept, so no pairs of a bucket are written. A bucket of
   more than `bucket` groups is not gathered: per size only the group with most tokens left is compared, which tells from
   how many tokens left on the size's groups pass with some group, and these point at it (`size_thresholds`). That gives the
   same families as comparing all pairs, whatever the size of a bucket.
4. Connected groups are expanded to their units, whose whole sets are read again and verified exactly. A family is cut
   into blocks of bounded total size, compared by an inverted index; a task returns a spanning forest of its links only.
   No cap, no sampling: a pair of a family goes unchecked only where verified links already connect it.
5. Components of the verified links give the class ids.

Defined cases: null and empty texts have the empty set and link with nothing; fewer than k words give one shingle of
all of them; rows with a null doc_id get counted shingles and a null component_id; rows of one doc_id and different
texts are judged apart; repeated rows are each returned; a table without rows gives no rows; texts are taken whole, however
long (a text is one row of shingle names); only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ASK, Answers, Key, Words, ask_rows, census, components, grams, id_bits, mark, new_key, only, partitions, shards_for, text_slices, tidy_group, tidy_pair, tidy_rows, written

_SETS = "doc_id long, copy long, unit long, mark long, n_shingles long, low binary"


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle names of each row."""
    names = words.names()
    h = grams(names, k)
    for r in range(words.rows):
        a, n = int(words.first[r]), int(words.counts[r])
        if n >= k:
            yield np.unique(h[a : a + n - k + 1])
        elif n:
            yield grams(names[a : a + n], n)
        else:
            yield h[:0]


def name_of(*parts: bytes) -> tuple[int, int]:
    """Two 64-bit lanes of a name."""
    digest = hashlib.blake2b(b"".join(parts), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def prefix_length(n: int, t: Fraction) -> int:
    return n - math.ceil(t * n) + 1


class TokenOrder:
    """Tiers of the hash space and how many of a set's tokens can be in its prefix."""

    def __init__(self, t: Fraction):
        self.t = t
        self.width = np.uint64(min(2**64 - 1, int(2**64 * min(Fraction(1), Fraction(5, 2) * (1 - t)))))

    def tier(self, tokens: np.ndarray) -> np.ndarray:
        return tokens // self.width

    def low(self, tokens: np.ndarray) -> np.ndarray:
        """The whole tiers that a sorted set's prefix can reach."""
        if not len(tokens):
            return tokens
        last = tokens[prefix_length(len(tokens), self.t) - 1] // self.width
        return tokens[: np.searchsorted(self.tier(tokens), last, "right")]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, copy (tells texts of one doc_id apart) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").alias("text"))


def _sets(docs: DataFrame, k: int, order: TokenOrder, key: Key) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in text_slices(whole):
                units, marks, sizes, lows = [], [], [], []
                for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(Words(batch.column(2), fold=True, key=key), k), strict=True):
                    unit, mark = name_of(s.tobytes())
                    first = len(s) > 0 and doc is not None and (unit, mark) not in seen
                    if first:
                        seen.add((unit, mark))
                    units.append(unit)
                    marks.append(mark)
                    sizes.append(len(s))
                    lows.append(order.low(s).tobytes() if first else None)
                columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (units, marks, sizes)), pa.array(lows, pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "copy", "unit", "mark", "n_shingles", "low"])

    return _keyed(docs).mapInArrow(tidy_rows(run), _SETS)


def settle_names(sets: DataFrame) -> DataFrame:
    """Rows with (unit, mark): where units of different marks share their name, each gets a name of both."""
    shared = sets.groupBy("unit").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a <> b").select("unit", F.lit(True).alias("twice"))
    shared = written(shared, "shared-names")
    if shared.isEmpty():
        return sets
    unit = F.when(F.col("twice"), F.xxhash64("unit", "mark")).otherwise(F.col("unit"))
    return sets.join(shared, "unit", "left").withColumn("unit", unit).select(*sets.columns)


def _distinct_units(table: pa.Table) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(unit, mark, doc_id, size, low tokens) of a shard, each unit once."""
    found: dict[int, tuple[int, int, int, int, np.ndarray]] = {}
    for unit, mark, doc, n, low in zip(*(table[c].to_pylist() for c in ("unit", "mark", "doc_id", "n_shingles")), table["low"], strict=True):
        if unit not in found or doc < found[unit][2]:
            found[unit] = (unit, mark, doc, n, np.frombuffer(low.as_py(), np.uint64))
    return list(found.values())


_PREFIXES = "unit long, mark long, doc_id long, n long, prefix array<long>, places array<long>, grp long, grp_mark long"


def _prefixes(lows: DataFrame, order: TokenOrder, buckets: int) -> DataFrame:
    """Units with a prefix token that some other unit holds: the shared tokens with their places in the order, and the
    names of the group of equal size and prefix."""

    def ask(table: pa.Table) -> pa.Table:
        units = _distinct_units(table)
        names, docs = np.unique(np.concatenate([u[4] for u in units]), return_counts=True)
        return ask_rows(table["shard"][0].as_py(), buckets, names, docs.astype(np.uint32))

    def choose(table: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("unit", "mark", "doc_id", "n", "prefix", "places", "grp", "grp_mark")}
        answers = Answers(replies)
        for unit, mark, doc, n, low in _distinct_units(table) if table.num_rows else []:
            at = answers.find(low)
            count = np.where(at >= 0, answers.docs[at], 1) if len(answers.names) else np.ones(len(low))
            chosen = np.lexsort((low, count, order.tier(low)))[: prefix_length(n, order.t)]
            places = np.flatnonzero(count[chosen] > 1)
            if len(places):
                grp = name_of(n.to_bytes(8, "little"), low[chosen].tobytes())
                for key, x in zip(out, (unit, mark, doc, n, low[chosen[places]].astype(np.int64), places, *grp), strict=True):
                    out[key].append(x)
        kinds = [pa.list_(pa.int64()) if c in ("prefix", "places") else pa.int64() for c in out]
        return pa.table([pa.array(c, kind) for c, kind in zip(out.values(), kinds, strict=True)], names=list(out))

    replies = census(lows.groupBy("shard").applyInArrow(tidy_group(ask), ASK))
    return lows.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(tidy_pair(choose), _PREFIXES)


def passing_pairs(token: np.ndarray, band: np.ndarray, grp: np.ndarray, n: np.ndarray, place: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, per (token, band), of the group pairs that pass the size and the positional filter.

    Rows are sorted by token, band, n. For the first token a similar pair shares, the overlap is at most one plus the
    tokens either has after it; so every similar pair passes at one of its tokens."""
    rows = len(token)
    last = np.ones(rows, bool)
    last[:-1] = (token[1:] != token[:-1]) | (band[1:] != band[:-1])
    ends = np.flatnonzero(last) + 1
    end = ends[np.searchsorted(ends, np.arange(rows), "right")] if rows else ends
    parent = np.arange(rows)

    def roots(i: np.ndarray) -> np.ndarray:
        r = parent[i]
        while (parent[r] != r).any():
            r = parent[r]
        parent[i] = r
        return r

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    after = n - place - 1
    a, b = [], []
    i, d = np.arange(rows), 1
    while len(i := i[i + d < end[i]]):
        i = i[n[i] * t.denominator >= n[i + d] * t.numerator]
        j = i + d
        passes = (1 + np.minimum(after[i], after[j])) * (t.numerator + t.denominator) >= t.numerator * (n[i] + n[j])
        x, y = i[passes], j[passes]
        apart = roots(x) != roots(y)
        for p, q in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            u, v = find(p), find(q)
            if u != v:
                parent[max(u, v)] = min(u, v)
                a.append(p)
                b.append(q)
        d += 1
    return grp[a], grp[b]


def least_tokens(n: Column, m: Column, t: Fraction) -> Column:
    """How many tokens groups of sizes n and m must both have left after a shared one."""
    top, both = t.numerator, t.numerator + t.denominator
    return F.floor((top * (n + m) + (both - 1)) / both).cast("long") - 1


def size_thresholds(n: np.ndarray, left: np.ndarray, alike: np.ndarray, t: Fraction) -> np.ndarray:
    """Per size of a bucket (rising) the least number of tokens left with which a group passes with some group of the bucket,
    -1 where none does. left: the most tokens left in a size; alike: whether two of its groups pass with each other.

    A pair of sizes passes for exactly those groups of both that have `least` tokens left, so its groups with most decide
    whether any does."""
    least = lambda x, y: -(-(t.numerator * (x + y)) // (t.numerator + t.denominator)) - 1
    none = np.iinfo(np.int64).max
    need = np.where(alike, least(n, n), none)
    i, d = np.arange(len(n)), 1
    while len(i := i[i + d < len(n)]):
        i = i[n[i] * t.denominator >= n[i + d] * t.numerator]
        j = i + d
        bound = least(n[i], n[j])
        ok = (left[i] >= bound) & (left[j] >= bound)
        need[i[ok]] = np.minimum(need[i[ok]], bound[ok])
        need[j[ok]] = np.minimum(need[j[ok]], bound[ok])
        d += 1
    return np.where(need == none, -1, need)


def _large_edges(tokens: DataFrame, t: Fraction) -> DataFrame:
    """Edges of the buckets that are not gathered, from their rows (token, band, grp, n, place)."""
    rows = tokens.withColumn("left", F.col("n") - F.col("place") - 1)
    size = F.col("n")
    top = F.max(F.struct("left", "grp")).alias("top")
    sizes = rows.groupBy("token", "band", "n").agg(top, (F.count_if(F.col("left") >= least_tokens(size, size, t)) > 1).alias("alike"))
    sizes = written(sizes.select("token", "band", "n", F.col("top.left").alias("left"), F.col("top.grp").alias("head"), "alike"), "bucket-sizes")

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        n, left, head = (table[c].to_numpy() for c in ("n", "left", "head"))
        need = size_thresholds(n, left, table["alike"].to_numpy(), t)
        on = need >= 0
        same = np.zeros(len(n), np.int64)
        a, b = passing_pairs(same, same, head, n, n - 1 - left, t)
        k = int(on.sum())
        columns = [np.concatenate([x, y]) for x, y in ((table["token"].to_numpy()[on], same[: len(a)]), (table["band"].to_numpy()[on], same[: len(a)]), (n[on], same[: len(a)]), (need[on], same[: len(a)]), (head[on], b))]
        other = pa.array(np.concatenate([np.zeros(k, np.int64), a]), mask=np.arange(k + len(a)) < k)
        return pa.table([*(pa.array(c.astype(np.int64)) for c in columns), other], names=["token", "band", "n", "need", "head", "other"])

    told = written(sizes.groupBy("token", "band").applyInArrow(decide, "token long, band long, n long, need long, head long, other long"), "thresholds")
    between = told.where("other is not null").select(F.col("other").alias("a"), F.col("head").alias("b"))
    inside = rows.join(told.where("other is null").drop("other"), ["token", "band", "n"]).where("left >= need and grp <> head")
    return inside.select(F.col("grp").alias("a"), F.col("head").alias("b")).unionByName(between)


def _group_edges(tokens: DataFrame, t: Fraction, bucket: int) -> DataFrame:
    """Edges (a, b) between groups from rows (token, band, grp, n, place)."""
    sizes = tokens.groupBy("token", "band").agg(F.count("*").alias("groups"))
    hot = written(sizes.where(F.col("groups") > bucket).select("token", "band", F.lit(True).alias("large")), "hot-tokens")
    placed = tokens.join(hot, ["token", "band"], "left")
    stars = _large_edges(placed.where("large").drop("large"), t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = ("token", "band", "grp", "n", "place")

        def edges(columns: list[np.ndarray]) -> pa.RecordBatch:
            a, b = passing_pairs(*columns, t)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            token, band = columns[0], columns[1]
            cut = int(np.argmax((token == token[-1]) & (band == band[-1])))  # the last bucket may go on in the next batch
            held = [c[cut:] for c in columns]
            if cut:
                yield edges([c[:cut] for c in columns])
        if held is not None:
            yield edges(held)

    cold = placed.where("large is null").select("token", "band", "grp", "n", "place")
    pairs = cold.repartition(partitions(tokens.sparkSession), "token", "band").sortWithinPartitions("token", "band", "n", "grp").mapInArrow(tidy_rows(run), "a long, b long")
    return stars.unionByName(pairs)


def _families(prefixes: DataFrame, t: Fraction, bucket: int) -> DataFrame:
    """Units with the candidate family they are in: (unit, mark, doc_id, n, family), families of two or more units."""
    groups = prefixes.groupBy("grp", "grp_mark").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("places").alias("places"), F.count("*").alias("members"))
    groups = written(groups, "groups")
    band = F.floor(F.log("n") / (math.log(1 / t) * (1 + 1e-9)))  # sizes within the ratio t are at most one band apart
    tokens = groups.select("grp", "n", band.alias("low_band"), F.explode(F.arrays_zip("prefix", "places")).alias("at"))
    tokens = tokens.select(F.col("at.prefix").alias("token"), F.explode(F.array("low_band", F.col("low_band") + 1)).alias("band"), "grp", "n", F.col("at.places").alias("place"))
    roots = components(_group_edges(tokens, t, bucket)).withColumnRenamed("node", "grp")
    several = groups.groupBy("grp").agg(F.sum("members").alias("members")).join(roots, "grp", "left").where("members > 1 or root is not null")
    several = written(several.select("grp", F.coalesce("root", "grp").alias("family")), "families")
    return prefixes.join(several, "grp").select("unit", "mark", "doc_id", "n", "family")


def _candidate_sets(docs: DataFrame, families: DataFrame, k: int, key: Key) -> DataFrame:
    """(unit, family, n, tokens): each candidate unit's whole set, read again from the document that stands for it."""
    bits = id_bits(families)
    n_bits = len(bits) * 32

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            hit = (bits[slot // 32] >> (slot % 32).astype(np.uint32)) & np.uint32(1)
            yield batch.select(["doc_id", "text"]).filter(pa.array(hit.astype(bool)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                found = list(shingle_sets(Words(batch.column("text"), fold=True, key=key), k))
                same = pa.array([name_of(s.tobytes())[1] == mark for s, mark in zip(found, batch.column("mark").to_pylist(), strict=True)], pa.bool_())
                rows = [*(batch.column(c) for c in ("unit", "family", "n")), pa.array([s.tobytes() for s in found], pa.binary())]
                yield pa.record_batch(rows, names=["unit", "family", "n", "tokens"]).filter(same)  # a doc_id may have other texts

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null")
    read = read.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(n_bits))).mapInArrow(tidy_rows(possible), "doc_id long, text string")
    return read.join(families, "doc_id").select("unit", "mark", "family", "n", "text").mapInArrow(tidy_rows(sets), "unit long, family long, n long, tokens binary")


def _task_links(table: pa.Table, t: Fraction) -> pa.Table:
    """A spanning forest of the links between a task's probes and all its units."""
    seen: dict[int, np.ndarray] = {}
    probes: set[int] = set()
    for unit, tokens, probe in zip(table["unit"].to_pylist(), table["tokens"], table["probe"].to_pylist(), strict=True):
        if unit not in seen:
            seen[unit] = np.frombuffer(tokens.as_py(), np.uint64)
        if probe:
            probes.add(unit)
    units = list(seen)
    sets = [seen[u] for u in units]
    sizes = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(column, kind="stable")
    owner_by = owner[by]
    first = np.searchsorted(column[by], np.arange(column.max() + 2))
    parent = np.arange(len(sets))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: tuple[list, list] = ([], [])
    stop = np.cumsum(sizes)
    for i, unit in enumerate(units):
        if unit not in probes:
            continue
        mine = column[stop[i] - sizes[i] : stop[i]]
        # how many tokens i shares with every unit: lengths of its tokens' posting lists, gathered at once
        a, n = first[mine], first[mine + 1] - first[mine]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(owner_by[at], minlength=len(sets))
        union = sizes + sizes[i] - shared
        for j in np.flatnonzero(shared * t.denominator >= union * t.numerator):
            x, y = find(i), find(int(j))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out[0].append(unit)
                out[1].append(units[int(j)])
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])


def _blocks_of(members: DataFrame, block_tokens: int, name: str) -> DataFrame:
    """(family, name): how many blocks of about block_tokens a family's members make."""
    return members.groupBy("family").agg(F.ceil(F.sum("n") / block_tokens).cast("int").alias(name))


def _verified_links(sets: DataFrame, t: Fraction, block_tokens: int) -> DataFrame:
    """Links that give the same components as all links within the families.

    First every block of a family is compared with itself and with the family's block 0. In families of several blocks,
    all units that are then outside the family's largest component are compared with all units of the family; units
    that the largest component already holds need no comparison with each other, so a family of very many near copies
    moves its sets once for each block of stragglers, not once for each other block. Only families of several blocks
    have a row in the tables of block counts; these are written first, so that a large family meets them in a join of
    its own stage, broadcast or split by size."""
    links = lambda tasks: tasks.applyInArrow(tidy_group(lambda table: _task_links(table, t)), "a long, b long")
    several = written(_blocks_of(sets, block_tokens, "blocks").where("blocks > 1"), "blocks")
    block = F.pmod(F.xxhash64("unit", F.lit(7)), F.col("blocks")).cast("int")
    placed = sets.join(several, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", block)
    to = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = placed.select("family", "block", "unit", "tokens", F.explode(to).alias("task")).withColumn("probe", F.col("block") == F.col("task"))
    found = written(links(first.groupBy("family", "task")), "links")
    if several.isEmpty():
        return found
    large = placed.where("blocks > 1")
    roots = components(found).withColumnRenamed("node", "unit")
    now = written(large.drop("tokens").join(roots, "unit", "left").withColumn("root", F.coalesce("root", "unit")), "rooted")
    main = written(now.groupBy("family", "root").count().groupBy("family").agg(F.max_by("root", F.struct("count", "root")).alias("main")), "main")
    strays = written(now.join(main, "family").where("root <> main").select("family", "unit", "n"), "strays")
    every = large.join(written(_blocks_of(strays, block_tokens, "stray_blocks"), "stray-blocks"), "family")
    targets = every.select("family", "unit", "tokens", F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("s"), F.col("block").alias("b"), F.lit(False).alias("probe"))
    stray = F.pmod(F.xxhash64("unit", F.lit(11)), F.col("stray_blocks")).cast("int")
    probes = every.join(strays.select("unit"), "unit", "left_semi").select("family", "unit", "tokens", stray.alias("s"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(True).alias("probe"))
    return found.unionByName(written(links(targets.unionByName(probes).groupBy("family", "s", "b")), "stray-links"))


def _classes(docs: DataFrame, k: int, threshold: str | Fraction, block_tokens: int, bucket: int) -> DataFrame:
    """One row per document: doc_id, copy, unit, n_shingles, root (the class; null for empty sets and null doc_ids)."""
    t = Fraction(threshold)
    spark = docs.sparkSession
    order = TokenOrder(t)
    key = new_key()
    sets = settle_names(written(_sets(docs, k, order, key), "sets"))
    first = sets.where("low is not null")
    shards = shards_for(spark, first.agg(F.sum(F.length("low"))).first()[0])
    lows = first.select(F.pmod("unit", F.lit(shards)).cast("int").alias("shard"), "unit", "mark", "doc_id", "n_shingles", "low")
    prefixes = written(_prefixes(lows, order, shards), "prefixes")
    families = written(_families(prefixes, t, bucket), "candidates")  # written, so that its size decides how texts meet it
    links = _verified_links(written(_candidate_sets(docs, families, k, key), "candidate-sets"), t, block_tokens)
    roots = components(links).withColumnRenamed("node", "unit")
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return sets.join(roots, "unit", "left").select("doc_id", "copy", "unit", "n_shingles", F.when(known, F.coalesce("root", "unit")).alias("root"))


def near_duplicate_classes(docs: DataFrame, k: int = 5, threshold: str | Fraction = "4/5", block_tokens: int = 1 << 16, bucket: int = 256) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    since = mark()
    rows = written(_classes(docs, k, threshold, block_tokens, bucket), "classes")
    names = written(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "names")
    only(since, rows, names)
    return rows.join(names, "root", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, threshold: str | Fraction = "4/5", block_tokens: int = 1 << 16, bucket: int = 256) -> DataFrame:
    """The documents without near copies: of each class one row stays, that of the smallest doc_id (and there of the least
    name of a text), with its columns.

    Rows of one doc_id and different texts are different documents. Rows with a null doc_id and rows without a word stay,
    but repeated rows of the same doc_id and text stay once (their other columns being those of any one of them)."""
    since = mark()
    rows = written(_classes(docs, k, threshold, block_tokens, bucket), "classes").where("root is not null")
    least = written(rows.groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    heads = rows.join(least, "root").where("doc_id = least").groupBy("root").agg(F.min("doc_id").alias("least"), F.min("copy").alias("least_copy"))
    gone = rows.join(written(heads, "heads"), "root").where("doc_id <> least or copy <> least_copy").select("doc_id", "copy").distinct()
    gone = written(gone, "gone")
    only(since, gone)
    inside = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    held = docs.select(inside, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"))
    kept = held.join(gone, ["doc_id", "copy"], "left_anti")
    once = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "copy"]))
    return once.select("doc.*")
