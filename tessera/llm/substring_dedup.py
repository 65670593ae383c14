"""Substring deduplication by recompression.

Every text is parsed in rounds, each naming runs of equal symbols and then pairs (a left symbol followed by a right one,
sides by a bit of the name). A name is a fingerprint of what it replaces, so equal stretches get equal names in all
documents; a symbol's name, extent and existence depend on a bounded stretch of words around it, which is tracked with it
(`lo`, `hi`) on the low levels. A symbol whose stretch lies inside a window of words is interior to it: every occurrence
of that window, in whatever document, holds the same symbol.

Spark rounds, over shards of documents dealt by a hash of (doc_id, text):
 A. Two censuses. High level: every symbol that `high` rounds of naming leave (18 words on average), with its successor;
    names of 128 bits, with the smallest doc_id that holds them. Low level: each window is represented by the
    least-named interior symbol of `rounds` rounds, with the stretch that forces it (a window without one by itself).
 B. Shared high-level symbols verify long repeats: windows inside one that a smaller document holds are settled. Windows
    not settled, but under a shared low-level symbol, are verified by a census of their own names of 128 bits, with the
    smallest doc_id that starts each. (The smallest document that has a window never has it settled, so it asks.)
 C. Words of settled windows and of windows that start in a document with a smaller doc_id are removed.
A shard sends a name once however many of its documents hold it, so frequent passages cost one entry a shard. The three
rounds read one exchange of the texts; shards and buckets hold some 64 MB whatever the input.

128-bit names of windows are built from the words' two lanes under a key that is drawn for the run; two different stretches
among m have one name with a chance of about m * m / 2 ** 129 (10 ** -12 for the windows of 100 TB). Names of 64 bits
only choose what is verified.

Defined cases: null and empty texts have no words; rows with a null doc_id lose nothing and cause no removal; rows of
equal doc_id don't remove each other's words; repeated rows are each returned; a table without rows gives no rows; texts
are taken whole, a very long one as one row of its shard.
Columns of docs named n_words or n_removed are replaced, any other name is kept.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ASK, Answers, Words, ask_rows, census, grams, mix, new_key, partitions, shards_for, text_slices, tidy_group, tidy_pair, written

_FAR = np.int64(1 << 60)
_RUN, _PAIR, _SIDE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), 0x8EBC6AF09C88C6E3


class Symbols:
    """A parse: for each symbol its name, words [start, end), row, and the words [lo, hi) that force it."""

    def __init__(self, name, start, end, lo, hi, row):
        self.name, self.start, self.end, self.lo, self.hi, self.row = name, start, end, lo, hi, row

    @staticmethod
    def words(hashes: np.ndarray, row: np.ndarray) -> Symbols:
        at = np.arange(len(hashes), dtype=np.int64)
        return Symbols(hashes, at, at + 1, at, at + 1, row)

    def _before(self, at: np.ndarray) -> np.ndarray:
        """lo of the symbol before, -1 (never forced) at the start of a text."""
        prev = np.maximum(at - 1, 0)
        return np.where((at > 0) & (self.row[prev] == self.row[at]), self.lo[prev], -1)

    def _after(self, at: np.ndarray) -> np.ndarray:
        """hi of the symbol after, far (never forced) at the end of a text."""
        succ = np.minimum(at + 1, len(self.name) - 1)
        return np.where((at + 1 < len(self.name)) & (self.row[succ] == self.row[at]), self.hi[succ], _FAR)

    def name_runs(self) -> Symbols:
        """Maximal runs of equal symbols become one symbol; both neighbours must be known to differ."""
        head = np.ones(len(self.name), bool)
        head[1:] = (self.name[1:] != self.name[:-1]) | (self.row[1:] != self.row[:-1])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(head)) - 1
        n = (last - first + 1).astype(np.uint64)
        name = np.where(n == 1, self.name[first], mix(self.name[first] * np.uint64(0xA0761D6478BD642F) + n))
        return Symbols(name, self.start[first], self.end[last], np.minimum(self._before(first), self.lo[first]), np.maximum(self._after(last), self.hi[last]), self.row[first])

    def name_pairs(self, level: int) -> Symbols:
        """A left symbol followed by a right one become one symbol. A symbol on its own is forced by the neighbour that it could have joined."""
        left = (mix(self.name ^ np.uint64(0x8EBC6AF09C88C6E3 + level)) >> np.uint64(63)) == 0
        pair = np.zeros(len(self.name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (self.row[:-1] == self.row[1:])
        head = np.ones(len(self.name), bool)
        head[1:] = ~pair[:-1]
        p = np.flatnonzero(head)
        q = np.where(pair[p], p + 1, p)
        name = np.where(pair[p], mix(self.name[p] * np.uint64(0xE7037ED1A0B428DB) + self.name[q]), self.name[p])
        lo = np.where(left[p], self.lo[p], self._before(p))
        hi = np.where(pair[p], self.hi[q], np.where(left[p], self._after(p), self.hi[p]))
        return Symbols(name, self.start[p], self.end[q], lo, hi, self.row[p])


def recompress(hashes: np.ndarray, row: np.ndarray, rounds: int) -> Symbols:
    symbols = Symbols.words(hashes, row)
    for level in range(rounds if len(hashes) else 0):
        symbols = symbols.name_runs().name_pairs(level)
    return symbols


def _sides(name: np.ndarray, level: int) -> np.ndarray:
    return (mix(name ^ np.uint64(_SIDE + level)) >> np.uint64(63)) == 0


class HighSymbols:
    """A parse of many rounds: name lanes, words [start, end) and row of each symbol."""

    def __init__(self, words: Words, rounds: int):
        self.name, self.check, self.row = words.hash, words.check, words.row
        self.start = np.arange(len(self.name), dtype=np.int64)
        self.stop = len(self.name)
        for level in range(rounds if len(self.name) else 0):
            self._runs()
            self._pairs(level)
        self.end = np.append(self.start[1:], self.stop)

    def _keep(self, head: np.ndarray, name: np.ndarray, check: np.ndarray) -> None:
        self.name, self.check, self.row, self.start = name, check, self.row[head], self.start[head]

    def _runs(self) -> None:
        same = (self.name[1:] == self.name[:-1]) & (self.check[1:] == self.check[:-1]) & (self.row[1:] == self.row[:-1])
        if same.any():
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            n = np.diff(np.append(first, len(self.name))).astype(np.uint64)
            lanes = [np.where(n == 1, x[first], mix(x[first] * _RUN + n)) for x in (self.name, self.check)]
            self._keep(first, *lanes)

    def _pairs(self, level: int) -> None:
        left = _sides(self.name, level)
        pair = left[:-1] & ~left[1:] & (self.row[:-1] == self.row[1:])
        at = np.flatnonzero(pair)
        lanes = []
        for x in (self.name, self.check):
            x = x.copy()
            x[at] = mix(x[at] * _PAIR + x[at + 1])
            lanes.append(x)
        first = np.flatnonzero(np.concatenate([[True], ~pair]))
        self._keep(first, *(x[first] for x in lanes))

    def joined(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol with its successor in the text: name lanes, words [start, end) and row, where a window fits in."""
        follows = np.zeros(len(self.name), bool)
        follows[:-1] = self.row[1:] == self.row[:-1]
        nxt = np.minimum(np.arange(len(self.name)) + 1, max(0, len(self.name) - 1))
        lanes = [mix(x * _PAIR + np.where(follows, x[nxt] if len(x) else x, np.uint64(0))) for x in (self.name, self.check)]
        end = np.where(follows, self.end[nxt] if len(self.end) else self.end, self.end)
        fits = end - self.start >= width
        return lanes[0][fits], lanes[1][fits], self.start[fits], end[fits], self.row[fits]


def _covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in some [start, stop)."""
    depth = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(stops, minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0


class Windows:
    """All windows of `width` words of a slice of texts."""

    def __init__(self, words: Words, width: int):
        self.words, self.width = words, width
        n = len(words.hash)
        at = np.arange(max(0, n - width + 1))
        self.at = at[words.row[at] == words.row[at + width - 1]] if len(at) else at  # first word of each
        self._whole: tuple[np.ndarray, np.ndarray] | None = None

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both lanes of the windows' names."""
        if self._whole is None:
            self._whole = grams(self.words.hash, self.width), grams(self.words.check, self.width)
        return self._whole[0][at], self._whole[1][at]

    def _stretches(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Names of stretches of 1 to `width` words, by the binary digits of their lengths."""
        out, power, size = length.astype(np.uint64), self.words.hash, 1
        at = at.copy()
        while size <= self.width and len(power):
            digit = (length & size) > 0
            out = np.where(digit, mix(out * _PAIR + power[np.minimum(at, len(power) - 1)]), out)
            at += np.where(digit, size, 0)
            power = mix(power[:-size] * _RUN + power[size:])
            size *= 2
        return out

    def representatives(self, rounds: int) -> np.ndarray:
        """For each window the least name, with its forcing stretch, among its interior symbols; else its own name."""
        s = recompress(self.words.hash, self.words.row, rounds)
        inner = np.flatnonzero((s.lo >= 0) & (s.hi - s.lo <= self.width))
        lo, hi = s.lo[inner], s.hi[inner]
        name = mix(self._stretches(lo, hi - lo) + s.name[inner])
        order = np.argsort(name)[::-1]  # the least name is written last
        name, lo, first = name[order], lo[order], np.maximum(hi[order] - self.width, 0)
        n = lo - first + 1  # a symbol is inside the windows that start in [hi - width, lo]
        top = np.iinfo(np.uint64).max
        best = np.full(len(self.words.hash), top)
        best[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] = np.repeat(name, n)
        best = best[self.at]
        none = best == top
        best[none] = self.names(self.at[none])[0]
        return best


def _slices(table: pa.Table):
    for batch in table.combine_chunks().to_batches():
        yield from text_slices(batch)


def _docs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids, and which are known."""
    col = batch.column(batch.schema.get_field_index("doc_id"))
    return pa.compute.fill_null(col, 0).to_numpy(zero_copy_only=False), pa.compute.is_valid(col).to_numpy(zero_copy_only=False)


def _merge(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(name, check or None, doc) of a shard -> distinct names, checks, 2 where several documents hold one (else 1), the
    smallest doc_id."""
    lanes = len(parts[0]) - 1 if parts else 1
    columns = [np.concatenate([p[i] for p in parts]) for i in range(lanes + 1)] if parts else [np.empty(0, np.uint64), np.empty(0, np.int64)]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    fresh = np.ones(len(order), bool)
    fresh[1:] = False
    for c in columns[:lanes]:
        fresh[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(fresh)
    docs = columns[-1]
    last = np.append(first[1:], len(order)) - 1
    several = (docs[first] != docs[last]) if len(first) else np.empty(0, bool)
    return columns[0][first], columns[1][first] if lanes == 2 else None, (1 + several).astype(np.uint8), docs[first]


def _unrepeated(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Without entries equal to the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return [c[new] for c in columns]


def remove_repeats(docs: DataFrame, width: int = 13, rounds: int = 2, high: int = 10) -> DataFrame:
    """Remove every word covered by a window of `width` words that also starts in a document with a smaller doc_id.

    Returns the columns of docs, text being the kept words joined by one space where any was removed, and n_words,
    n_removed. Windows are judged on the input."""
    spark, key = docs.sparkSession, new_key()
    shards = buckets = shards_for(spark, docs.agg(F.sum(F.octet_length("text"))).first()[0])
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed")]
    own = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    own = own.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    dealt = own.repartition(partitions(spark), "shard")

    def each(table: pa.Table):
        """Slices of a shard with what all rounds use: words, windows, doc_id and known of each text."""
        for batch in _slices(table) if table.num_rows else ():
            words = Words(batch.column(batch.schema.get_field_index("text")), key=key)
            yield batch, words, Windows(words, width), *_docs_of(batch)

    def ask_symbols(table: pa.Table) -> pa.Table:
        low, tall = [], []
        for _, words, windows, ids, known in each(table):
            names, row = windows.representatives(rounds), words.row[windows.at]
            ok = known[row]
            low.append(_unrepeated([names[ok], ids[row[ok]]]))  # neighbours often share their representative
            name, check, _, _, row = HighSymbols(words, high).joined(width)
            ok = known[row]
            tall.append([name[ok], check[ok], ids[row[ok]]])
        shard = table["shard"][0].as_py()
        names, _, docs, _ = _merge(low)
        asked = [ask_rows(shard, buckets, names, docs)]
        if sum(len(t[0]) for t in tall):
            names, checks, docs, least = _merge(tall)
            asked.append(ask_rows(shard, buckets, names, docs, checks, least))
        # even buckets are of low symbols, odd ones of high symbols
        parts = [t.set_column(0, "bucket", pa.compute.add(pa.compute.multiply(t["bucket"], pa.scalar(2, pa.int32())), pa.scalar(k, pa.int32()))) for k, t in enumerate(asked)]
        return pa.concat_tables(parts)

    def settled(words: Words, ids: np.ndarray, known: np.ndarray, tall: Answers) -> np.ndarray:
        """Which words start a window inside a high-level symbol that a smaller document holds."""
        n = len(words.hash)
        if not len(tall.names):
            return np.zeros(n, bool)
        name, check, start, end, row = HighSymbols(words, high).joined(width)
        hit = tall.find(name, check)
        ok = (hit >= 0) & known[row]
        ok[ok] = tall.least[hit[ok]] < ids[row[ok]]
        return _covered(start[ok], end[ok] - width + 1, n)

    def ask_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        is_tall = pa.compute.is_valid(replies["checks"])
        shared, tall = Answers(replies.filter(pa.compute.invert(is_tall))), Answers(replies.filter(is_tall))
        parts = []
        for _, words, windows, ids, known in each(table) if len(shared.names) else ():
            done = settled(words, ids, known, tall)[windows.at]
            open_ = ~done & known[words.row[windows.at]]
            open_[open_] = shared.find(windows.representatives(rounds)[open_]) >= 0
            at = windows.at[open_]
            parts.append(_unrepeated([*windows.names(at), ids[words.row[at]]]))
        names, checks, docs, least = _merge(parts)
        return ask_rows(table["shard"][0].as_py() if table.num_rows else 0, buckets, names, docs, np.empty(0, np.uint64) if checks is None else checks, least)

    kept_schema = own.drop("shard").schema.add("n_words", "long").add("n_removed", "long")

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        answers = Answers(replies)  # of windows and of high-level symbols
        out = []
        for batch, words, windows, ids, known in each(table):
            texts = batch.column(batch.schema.get_field_index("text"))
            removed = np.zeros(len(words.hash), bool)
            if len(answers.names):
                starts = settled(words, ids, known, answers)
                hit = answers.find(*windows.names(windows.at))
                row = words.row[windows.at]
                ok = (hit >= 0) & known[row]
                ok[ok] = answers.least[hit[ok]] < ids[row[ok]]
                starts[windows.at[ok]] = True
                first = np.flatnonzero(starts)
                removed = _covered(first, first + width, len(removed))
            n_removed = np.bincount(words.row, weights=removed, minlength=words.rows).astype(np.int64)
            if n_removed.any():
                texts = texts.to_pylist()
                for r in np.flatnonzero(n_removed):
                    mask = ~removed[words.first[r] : words.first[r + 1]]
                    texts[r] = b" ".join(compress(texts[r].encode().split(), mask.tolist())).decode()
                texts = pa.array(texts, pa.string())
            fields = {c: batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id")}
            out.append(pa.table([fields["row"], fields["doc_id"], texts, pa.array(words.counts.astype(np.int64)), pa.array(n_removed)], names=["row", "doc_id", "text", "n_words", "n_removed"]))
        if not out:
            kinds = {f.name: f.type for f in table.schema}
            return pa.table([pa.array([], t) for t in (kinds["row"], pa.int64(), pa.string(), pa.int64(), pa.int64())], names=["row", "doc_id", "text", "n_words", "n_removed"])
        return pa.concat_tables(out)

    symbols = written(census(dealt.groupBy("shard").applyInArrow(tidy_group(ask_symbols), ASK)), "symbols")
    repeats = census(dealt.groupBy("shard").cogroup(symbols.groupBy("shard")).applyInArrow(tidy_pair(ask_windows), ASK))
    verified = symbols.where("checks is not null").unionByName(repeats)
    kept = dealt.groupBy("shard").cogroup(verified.groupBy("shard")).applyInArrow(tidy_pair(remove), kept_schema)
    order = [F.col(f"row.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns if c not in ("n_words", "n_removed")]
    return kept.select(*order, "n_words", "n_removed")
