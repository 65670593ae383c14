"""Spelling variant grouping by letter-parity bitmask bands.

A word's mask has a bit for every letter (Latin-1 letters share 38 bits beside the 26), set where the letter occurs an
odd number of times. An inserted or deleted character flips one bit, a replaced one two or none, so of three bands of the
mask at least one is equal in words one edit apart. Words meet through (band, value of the band) with lengths at most one
apart; masks that differ in more bits than one edit can flip go, a pair is taken in its first equal band only, and what is left
is verified character by character in matrices of one length.

1. One Arrow pass counts the words of whole texts, combined in each task; the words' table is written.
2. Per (band, value, length) the words are counted: a small table whatever the input. Values of up to `block` words are
   one task; of larger ones every length is cut into blocks and each pair of blocks of equal or neighbouring length is a
   task, so no task holds more than two blocks. Only verified pairs leave a task.
3. Pairs are combined to the number of near words and the most frequent one. Forms are followed to their end by doubling:
   every step to a form multiplies the count by `factor`, so a chain has at most log(largest count) / log(factor) steps.

Defined cases: null and empty texts have no words; a null doc_id is the empty text in the hash; repeated rows count each;
equal counts go to the smaller word in code-point order; a table without rows gives no rows; words and texts are taken whole
however long; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import discard, text_slices, written

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KEPT = 1 << 18  # distinct words a task holds before it sends them


def _bit(code: int) -> int:
    """a to z have bits of their own, the characters from 0xC0 on the 38 above."""
    return code - 97 if 97 <= code <= 122 else 26 + code % 38


_BIT = np.array([1 << _bit(c) for c in range(256)], np.uint64)
#: Every third letter is in one band, so frequent and rare ones mix.
BANDS = np.array([sum(1 << b for b in range(k, 64, 3)) for k in range(3)], np.uint64)


def parity_masks(words: list[bytes]) -> np.ndarray:
    """Letter-parity masks of non-empty Latin-1 words."""
    if not words:
        return np.empty(0, np.uint64)
    ends = np.cumsum([len(w) for w in words])
    return np.bitwise_xor.reduceat(_BIT[np.frombuffer(b"".join(words), np.uint8)], np.concatenate([[0], ends[:-1]]))


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, divisor: int = 199) -> DataFrame:
    """(word, n): the words of all whole texts, A-Z folded, of every 199th (doc_id, run) one character short."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for whole in batches:
            for batch in text_slices(whole):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    folded = (text.as_py() or "").encode().translate(_LOWER).decode()
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in Counter(runs.findall(folded)).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % divisor == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        seen[word] += n
                if len(seen) > _KEPT:
                    yield flush()
        yield flush()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _with_masks(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            columns = [pa.array([len(c) for c in codes], pa.int32()), pa.array(parity_masks(codes).view(np.int64))]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["word", "n", "length", "mask"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, length int, mask long")


def _matrix(codes: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), length)


def _near(a: list[bytes], b: list[bytes], mask_a: np.ndarray, mask_b: np.ndarray, band: int, same: bool, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words one edit apart; the words of a have one length, those of b the same or one more.

    same: a and b are one list, each pair once. Pairs that a band before `band` holds are left to it."""
    if not a or not b:
        return
    size, longer = len(a[0]), len(b[0]) - len(a[0])
    left, right = _matrix(a, size), _matrix(b, size + longer)
    step = max(1, cells // len(b))
    for at in range(0, len(a), step):
        flips = mask_a[at : at + step, None] ^ mask_b[None]
        ok = np.bitwise_count(flips) <= (1 if longer else 2)
        for earlier in range(band):
            ok &= (flips & BANDS[earlier]) != 0
        i, j = np.nonzero(ok)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        pieces = max(1, (1 << 22) // (size + 1))
        for k in range(0, len(i), pieces):
            p, q = i[k : k + pieces], j[k : k + pieces]
            if longer:  # equal up to some place, and from there on one further
                ahead = np.cumprod(left[p] == right[q, :-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
                behind = np.cumprod((left[p] == right[q, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
                one = ahead + behind >= size
            else:
                one = (left[p] != right[q]).sum(axis=1) == 1
            yield p[one], q[one]


def _task_pairs(table: pa.Table) -> pa.Table:
    """The near pairs of a task, both ways: of all its words, of blocks i and j of one length, or of neighbouring lengths."""
    band, kind, i, j = (table[c][0].as_py() for c in ("band", "kind", "i", "j"))
    word, n = table["word"].to_pylist(), table["n"].to_numpy()
    codes = [w.encode("latin-1") for w in word]
    length, side = table["length"].to_numpy(), table["side"].to_numpy()
    mask = table["mask"].to_numpy().view(np.uint64)
    out: tuple[list, list, list] = ([], [], [])

    def compare(x: np.ndarray, y: np.ndarray, same: bool) -> None:
        for p, q in _near([codes[k] for k in x], [codes[k] for k in y], mask[x], mask[y], band, same):
            for k, m in ((x[p], y[q]), (y[q], x[p])):
                out[0].extend(word[t] for t in k)
                out[1].extend(word[t] for t in m)
                out[2].extend(n[m].tolist())

    at = {s: np.flatnonzero(length == s) for s in np.unique(length).tolist()}
    if kind == "blocks":
        compare(np.flatnonzero(side == i), np.flatnonzero(side == j), i == j)
    elif kind == "lengths":
        short, *long = [at[s] for s in sorted(at)]
        for other in long:
            compare(short, other, False)
    else:
        for s, own in at.items():
            compare(own, own, True)
            if s + 1 in at:
                compare(own, at[s + 1], False)
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])


def near_words(words: DataFrame, block: int = 1024) -> DataFrame:
    """(word, near, near_n) of every pair of the table's words (word, n; each once) that is one edit apart, both ways."""
    masked = written(_with_masks(words), "masks")
    bands = [F.struct(F.lit(k).alias("band"), F.col("mask").bitwiseAND(F.lit(letters)).alias("value")) for k, letters in enumerate(BANDS.view(np.int64).tolist())]
    banded = masked.select("word", "n", "length", "mask", F.explode(F.array(*bands)).alias("b")).select("b.*", "word", "n", "length", "mask")
    sizes = written(banded.groupBy("band", "value", "length").agg(F.count("*").alias("words")), "cells")
    large = sizes.groupBy("band", "value").agg(F.sum("words").alias("all")).where(F.col("all") > block)
    # one row per (band, value, length) of the large values
    cells = sizes.join(large.select("band", "value"), ["band", "value"]).withColumn("blocks", F.ceil(F.col("words") / block).cast("int"))
    beside = lambda by, name: cells.select("band", "value", (F.col("length") + by).alias("length"), F.col("blocks").alias(name))
    plan = cells.select("band", "value", "length", "blocks").join(beside(1, "shorter"), ["band", "value", "length"], "left").join(beside(-1, "longer"), ["band", "value", "length"], "left")
    plan = written(plan.na.fill(0, ["shorter", "longer"]), "plan")
    placed = banded.join(plan, ["band", "value", "length"], "left")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    to = lambda kind, at, i, j: F.struct(F.lit(kind).alias("kind"), at.alias("at"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    size, side = F.col("length"), F.col("side")
    tasks = F.concat(
        F.transform(upto(F.col("blocks")), lambda k: to("blocks", size, F.least(k, side), F.greatest(k, side))),
        F.transform(upto(F.col("longer")), lambda k: to("lengths", size, side, k)),
        F.transform(upto(F.col("shorter")), lambda k: to("lengths", size - 1, k, side)),
    )
    whole = F.array(to("whole", F.lit(0), F.lit(0), F.lit(0)))
    dealt = placed.withColumn("side", F.coalesce(own, F.lit(0))).withColumn("task", F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(tasks)))
    rows = dealt.select("band", "value", "task.*", "word", "n", "length", "mask", "side")
    return rows.groupBy("band", "value", "kind", "at", "i", "j").applyInArrow(_task_pairs, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, the distance doubling each round."""
    steps = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(ahead, "root", "left")
        moved = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        discard(steps)
        steps = moved.select("word", "root")
        if moved.where("on").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, factor: int = 5, divisor: int = 199, block: int = 1024) -> DataFrame:
    """word, n, n_near, form, form_n, root of every distinct word of `least_length` characters found `least_count` times."""
    words = written(word_counts(docs, least_length, least_count, divisor), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("n")
    told = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    told = written(told, "near")
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
