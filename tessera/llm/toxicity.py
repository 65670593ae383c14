"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are runs of ASCII letters and digits and of non-ASCII bytes, A-Z folded. A word's embedding is the sum of three rows
of one hashed table: of the word and of its first 4 and 5 bytes, so that inflected forms share their stem. Filters of
widths 1, 2 and 3 slide over the words; ReLU and max pooling over the whole text give the features of a logistic output.
Embeddings start from smoothed class log-odds of the training rows and are trained with everything else by Adam;
only the words at the pooled positions get a gradient.

Labels are read only where crc32(doc_id as text) mod 5 is not 0; all these rows and their whole texts are used. Three quarters
of them, by a hash of the doc_id, are trained on in shards of some 4,096 texts: one job counts in how many texts of each
class every bucket is, then every shard improves a copy of the model, and the copies are averaged (three rounds of two
passes; with one shard 12 to 60 passes and nothing to average). The last quarter calibrates: a logistic scaling moves the
best F1 threshold to score 0.5, and every language gets a threshold of its own, its best F1 threshold drawn towards 0.5 as
by `prior_rows` rows of it, so that it follows the language's rows as far as there are any (column flagged; lang is never an
input of a score). All its rows are counted; cuts are looked for between 4,096 bins of the logits. The driver holds a model
(some 5 MB), the bins and one threshold a language; a task holds the bucket ids of one shard (6 bytes a word).

Scoring is one Arrow pass over whole texts: a bucket's contribution to every filter tap is tabulated, so convolution is
a few gathers and additions a word. Weights (some 10 MB) go to the executors with the function.

Defined cases: null and empty texts have all-zero features and so a constant score; a null doc_id is scored and never
held out; repeated rows are each returned; of several texts of one labelled doc_id one is learned from, the same at every
run; equal scores fall on one side of a threshold together; without labels of both classes every score is the share of
label 1 (0.0 without any); a table without rows gives no rows; only doc_id, text and lang are read; every text is scored
whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Words, id_bits, mix, text_slices, written

WIDTHS, FILTERS, DIM = (1, 2, 3), 16, 16
TAPS = [(w, j) for w in WIDTHS for j in range(w)]

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


STEMS = (4, 5)
PARTS = 1 + len(STEMS)


def buckets_of(col: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and its stems (words x PARTS), and words per row."""
    words = Words(col, fold=True, space=_BREAK)
    names = [words.hash, *(mix(words.prefixes(k) + np.uint64(k)) for k in STEMS)]
    return np.stack([(h % np.uint64(buckets)).astype(np.int32) for h in names], axis=1), words.counts


@dataclass
class Model:
    embed: np.ndarray  # buckets x DIM
    conv: np.ndarray  # taps x DIM x FILTERS
    bias: np.ndarray  # widths x FILTERS
    out: np.ndarray  # widths * FILTERS
    shift: float = 0.0
    scale: float = 1.0
    prior: float | None = None  # a constant score instead
    thresholds: dict[str, float] = field(default_factory=dict)

    def _pooled(self, taps: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """ReLU max pools of each row."""
        n, rows = len(taps[0]), len(counts)
        ends = np.cumsum(counts)
        starts = ends - counts
        left = np.repeat(ends, counts) - np.arange(n)  # words from here to the end of the row
        pools = np.zeros((rows, len(WIDTHS), FILTERS), np.float32)
        full = np.flatnonzero(counts > 0)
        for i, w in enumerate(WIDTHS):
            act = np.full((n, FILTERS), -1e9, np.float32)
            if n >= w:
                total = sum(taps[TAPS.index((w, j))][j : n - w + 1 + j] for j in range(w)) + self.bias[i]
                act[: n - w + 1] = np.where((left[: n - w + 1] >= w)[:, None], total, -1e9)
            if len(full):
                top = np.maximum.reduceat(act, starts[full], axis=0)
                pools[full, i] = np.maximum(top, 0)
        return pools

    def tables(self) -> list[np.ndarray]:
        return [self.embed @ self.conv[t] for t in range(len(TAPS))]

    def logits(self, buckets: np.ndarray, counts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        pools = self._pooled([sum(t[buckets[:, k]] for k in range(PARTS)) for t in tables], counts)
        return pools.reshape(len(counts), -1) @ self.out

    def scores(self, buckets: np.ndarray, counts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(counts), self.prior)
        z = self.scale * (self.logits(buckets, counts, tables).astype(np.float64) - self.shift)
        return np.round(1 / (1 + np.exp(-np.clip(z, -60, 60))), 6)


PIECE = 20_000  # words of a text that are convolved at once in training


def first_model(seen: np.ndarray, n: np.ndarray, seed: int = 7) -> Model:
    """The untrained model: embeddings from the smoothed class log-odds of the buckets. seen: in how many texts of class 0 and 1
    each bucket is; n: texts of both classes."""
    rng = np.random.default_rng(seed)
    buckets = seen.shape[1]
    odds = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    doubt = 1 / np.sqrt(seen.sum(axis=0) + 1)
    embed = rng.normal(0, 0.05, (buckets, DIM)).astype(np.float32)
    embed[:, 0] = odds * (1 - doubt) / PARTS * 1.5
    conv = rng.normal(0, 0.2, (len(TAPS), DIM, FILTERS)).astype(np.float32)
    conv[:, 0, ::2] = np.abs(conv[:, 0, ::2]) + 0.3
    m = Model(embed, conv, np.full((len(WIDTHS), FILTERS), -0.3, np.float32), rng.normal(0, 0.05, len(WIDTHS) * FILTERS).astype(np.float32))
    m.out += 0.1 * np.tile(np.arange(FILTERS) % 2 == 0, len(WIDTHS)).astype(np.float32)
    return m


def _pool_places(m: Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ReLU max pools of one text and the words at which they are taken (-1: none), piece by piece."""
    pools, hits = np.zeros((len(WIDTHS), FILTERS), np.float32), np.full((len(WIDTHS), FILTERS), -1)
    flat = m.conv.transpose(1, 0, 2).reshape(DIM, -1)
    for s in range(0, len(ids), PIECE):
        part = ids[s : s + PIECE + max(WIDTHS) - 1]
        taps = (m.embed[part].sum(axis=1) @ flat).reshape(len(part), len(TAPS), FILTERS)
        for i, w in enumerate(WIDTHS):
            k = min(PIECE, len(part) - w + 1)
            if k > 0:
                act = sum(taps[j : j + k, TAPS.index((w, j))] for j in range(w)) + m.bias[i]
                best = act.argmax(axis=0)
                value = act[best, np.arange(FILTERS)]
                more = value > pools[i]
                pools[i], hits[i] = np.where(more, value, pools[i]), np.where(more, best + s, hits[i])
    return pools, hits


def improve(m: Model, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rates: list[float], batch: int = 64, seed: int = 7) -> None:
    """Adam steps on bucket sequences (words x PARTS) with labels 0/1, one pass per rate; weights: of both classes."""
    rng = np.random.default_rng(seed)
    bias_out = np.array([-m.shift], np.float32)
    dense = [m.conv, m.bias, m.out, bias_out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    e1, e2 = np.zeros_like(m.embed), np.zeros_like(m.embed)
    weight = weights[labels]
    step = 0
    for rate in rates:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            ids = np.concatenate([texts[r] for r in rows])
            starts = np.cumsum([0, *(len(texts[r]) for r in rows[:-1])])
            found = [_pool_places(m, texts[r]) for r in rows]
            pools = np.stack([p for p, _ in found])
            hits = np.stack([np.where(h >= 0, h + a, -1) for (_, h), a in zip(found, starts, strict=True)])
            flat = pools.reshape(len(rows), -1)
            p = 1 / (1 + np.exp(-np.clip(flat @ m.out + bias_out, -30, 30)))
            g = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            g_out = flat.T @ g + 1e-4 * m.out
            g_pool = (g[:, None] * m.out[None]).reshape(pools.shape)
            g_conv, g_bias = np.zeros_like(m.conv), np.zeros_like(m.bias)
            touched, g_rows = [], []
            for i, w in enumerate(WIDTHS):
                r, f = np.nonzero(hits[:, i] >= 0)
                grad, first = g_pool[r, i, f], hits[r, i, f]
                np.add.at(g_bias[i], f, grad)
                for j in range(w):
                    t = TAPS.index((w, j))
                    np.add.at(g_conv[t].T, f, grad[:, None] * m.embed[ids[first + j]].sum(axis=1))
                    touched.append(ids[first + j].ravel())
                    g_rows.append(np.repeat(grad[:, None] * m.conv[t][:, f].T, PARTS, axis=0))
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for par, (m1, m2), grad in zip(dense, moments, (g_conv, g_bias, g_out, np.array([g.sum()], np.float32)), strict=True):
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                par -= rate * fix * m1 / (np.sqrt(m2) + 1e-8)
            used, inverse = np.unique(np.concatenate(touched), return_inverse=True) if touched else (np.empty(0, int), np.empty(0, int))
            if len(used):
                grad = np.zeros((len(used), DIM), np.float32)
                np.add.at(grad, inverse, np.concatenate(g_rows))
                e1[used] += 0.1 * (grad - e1[used])
                e2[used] += 0.001 * (grad * grad - e2[used])
                m.embed[used] -= rate * fix * e1[used] / (np.sqrt(e2[used]) + 1e-8)
    m.shift = -float(bias_out[0])


def _best_threshold(low: np.ndarray, high: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> float:
    """The value halfway below the score at which F1 is best. Rising bins of equal or near scores: their least and largest
    score, their rows of label 1 and all their rows."""
    low, high, ones, rows = (x[::-1] for x in (low, high, ones, rows))
    k = int(np.argmax(2 * np.cumsum(ones) / (np.cumsum(rows) + max(1e-9, ones.sum()))))
    return float((low[k] + high[k + 1]) / 2 if k + 1 < len(low) else low[k])


def _logit(p: float) -> float:
    p = min(1 - 1e-9, max(1e-9, p))
    return float(np.log(p / (1 - p)))


def stretches(n: int, limit: int, width: int = 64) -> np.ndarray:
    """Which of n words stand for a text: all of them, or evenly spaced stretches of `width` with at most `limit` words."""
    if n <= limit:
        return np.arange(n)
    count = max(1, limit // width)
    starts = np.arange(count) * (n - width) // max(1, count - 1)
    return (starts[:, None] + np.arange(width)).ravel()


def taken(sizes: list[int], most: int) -> list[int]:
    """Which of the texts, in their order, are in the sample: every one that still fits."""
    out, total = [], 0
    for i, size in enumerate(sizes):
        if total + size <= most:
            out.append(i)
            total += size
    return out


_SHARD = 4096  # texts that a model is trained on before it is averaged with the others
_BLOCK = 1 << 14
_BINS = 4096


def _rows(docs: DataFrame, usable: DataFrame, buckets: int, text_words: int | None) -> DataFrame:
    """doc_id, lang, toxic, words, ids of every labelled text: hashed where it lies, only ids are shuffled."""
    bits = id_bits(usable)
    n_bits = len(bits) * 32
    kind = np.uint16 if buckets <= 1 << 16 else np.int32

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            slot = every.column(3).to_numpy()
            hit = (bits[slot // 32] >> (slot % 32).astype(np.uint32)) & np.uint32(1)
            for batch in text_slices(every.filter(pa.array(hit.astype(bool)))):
                ids, counts = buckets_of(batch.column(1), buckets)
                parts = np.split(ids.astype(kind), np.cumsum(counts)[:-1]) if batch.num_rows else []
                if text_words is not None:
                    parts = [x[stretches(len(x), text_words)] for x in parts]
                columns = [batch.column(0), batch.column(2), pa.array([len(x) for x in parts], pa.int64()), pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "lang", "words", "ids"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).where("doc_id is not null")
    own = own.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(n_bits))).mapInArrow(hashed, "doc_id long, lang string, words long, ids binary")
    pick = F.min_by(F.struct("lang", "toxic", "words", "ids"), F.struct(F.xxhash64("ids"), "lang")).alias("r")  # a doc_id may have other texts
    return own.join(usable, "doc_id").groupBy("doc_id").agg(pick).select("doc_id", "r.*")


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of float vectors that come in blocks (shard, block, v), added in the order of their shards in two steps."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total = sum(np.frombuffer(v.as_py(), np.float32).astype(np.float64) for v in table["v"])
        return pa.table([pa.array([table["shard"][0].as_py() // 64], pa.int64()), table["block"].slice(0, 1), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["shard", "block", "v"])

    schema = "shard long, block int, v binary"
    some = parts.groupBy("block", F.floor(F.col("shard") / 64)).applyInArrow(lambda table: add(table), schema)
    rows = some.groupBy("block").applyInArrow(lambda table: add(table), schema).toArrow().sort_by("block")  # as large as the model
    return np.concatenate([np.frombuffer(v.as_py(), np.float32) for v in rows["v"]])


def _by_shard(rows: DataFrame, work, kind: type) -> np.ndarray:
    """The sum over all shards of work(shard, texts, labels), a vector; rows lie by shard, and tasks hold one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            v = work(now, texts, np.array(labels)).astype(np.float32)
            cut = [v[k : k + _BLOCK].tobytes() for k in range(0, len(v), _BLOCK)]
            for k, x in enumerate(cut):
                yield pa.record_batch([pa.array([now], pa.int64()), pa.array([k], pa.int32()), pa.array([x], pa.binary())], names=["shard", "block", "v"])

        now, texts, labels = None, [], []
        for batch in batches:
            for shard, toxic, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != now and texts:
                    yield from told()
                    texts, labels = [], []
                now = shard
                texts.append(np.frombuffer(ids.as_py(), kind).reshape(-1, PARTS))
                labels.append(toxic)
        if texts:
            yield from told()

    return _summed(rows.select("shard", "toxic", "ids").mapInArrow(run, "shard long, block int, v binary"))


def _trained(rows: DataFrame, n: np.ndarray, buckets: int, kind: type, shards: int, steps: int = 900, batch: int = 64) -> Model:
    """The model trained on all rows: every shard improves a copy of the model by itself, then the copies are averaged by their
    rows, an embedding over the shards that moved it; one shard goes through all its passes alone."""

    def presence(shard: int, texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
        seen = np.zeros((2, buckets))
        for x, y in zip(texts, labels, strict=True):
            seen[y, np.unique(x)] += 1
        return seen.ravel()

    m = first_model(_by_shard(rows, presence, kind).reshape(2, buckets).astype(np.float64), n)
    total = int(n.sum())
    passes, rounds = int(np.clip(round(steps * batch / total), 12, 60)), 1
    if shards > 1:
        passes, rounds = 6, 3
    rates = [0.01 * (1 - k / passes) + 0.001 for k in range(passes)]
    weights = 0.5 * total / np.maximum(1, n)

    for at in range(rounds):
        now = rates[at * passes // rounds : (at + 1) * passes // rounds]

        def moved(shard: int, texts: list[np.ndarray], labels: np.ndarray, now=now, at=at) -> np.ndarray:
            own = Model(m.embed.copy(), m.conv.copy(), m.bias.copy(), m.out.copy(), m.shift)
            improve(own, texts, labels, weights, now, batch, seed=7 + at)
            by, k = own.embed - m.embed, len(texts)
            tail = [own.conv - m.conv, own.bias - m.bias, own.out - m.out, np.array([own.shift - m.shift, 1.0])]
            return k * np.concatenate([by.ravel(), (by != 0).any(axis=1), *(x.ravel() for x in tail)])

        v = _by_shard(rows, moved, kind)
        by, on, tail = np.split(v, [buckets * DIM, buckets * (DIM + 1)])
        tail = tail[:-1] / tail[-1]
        conv, bias, out, shift = np.split(tail, np.cumsum([m.conv.size, m.bias.size, m.out.size]))
        m = Model(m.embed + by.reshape(buckets, DIM) / np.maximum(1, on)[:, None], m.conv + conv.reshape(m.conv.shape), m.bias + bias.reshape(m.bias.shape), m.out + out, m.shift + float(shift[0]))
    return m


def _calibrated(model: Model, rows: DataFrame, kind: type, prior_rows: int) -> Model:
    """Shift, scale and thresholds from the logits of all given rows, counted in bins that are told apart by their own least and
    largest logit; per language one row of thresholds leaves Spark."""

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            z = []
            for ids in batch.column(2):
                x = np.frombuffer(ids.as_py(), kind).reshape(-1, PARTS)
                z.append(float(model.logits(x, np.array([len(x)]), tables)[0]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(z, pa.float64())], names=["lang", "toxic", "z"])

    told = written(rows.select(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", "ids").mapInArrow(logits, "lang string, toxic int, z double"), "logits")
    low, high = told.agg(F.min("z"), F.max("z")).first()
    place = F.least(F.floor((F.col("z") - low) / max(high - low, 1e-9) * _BINS), F.lit(_BINS - 1)).alias("bin")
    bins = written(told.groupBy("lang", place).agg(F.min("z").alias("low"), F.max("z").alias("high"), F.sum("toxic").alias("ones"), F.count("*").alias("rows")), "bins")
    every = bins.groupBy("bin").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("ones").alias("ones"), F.sum("rows").alias("rows")).toArrow().sort_by("bin")
    low, high, ones, count = (every[c].to_numpy().astype(float) for c in ("low", "high", "ones", "rows"))
    model.shift = _best_threshold(low, high, ones, count)
    middle = (low + high) / 2
    std = np.sqrt(max(0.0, np.average(middle**2, weights=count) - np.average(middle, weights=count) ** 2))
    model.scale = float(np.clip(2.0 / (std + 1e-6), 0.1, 20))
    shift, scale = model.shift, model.scale

    def threshold(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        low, high, ones, count = (table[c].to_numpy().astype(float) for c in ("low", "high", "ones", "rows"))
        keep = 0 < ones.sum() < count.sum()
        score = lambda z: 1 / (1 + np.exp(-np.clip(scale * (z - shift), -60, 60)))
        n = count.sum()
        pulled = _logit(_best_threshold(score(low), score(high), ones, count)) * n / (n + prior_rows)
        return pa.table([table["lang"].slice(0, int(keep)), pa.array([1 / (1 + float(np.exp(-pulled)))][: int(keep)], pa.float64())], names=["lang", "threshold"])

    model.thresholds = {r.lang: r.threshold for r in bins.groupBy("lang").applyInArrow(threshold, "lang string, threshold double").orderBy("lang").collect()}
    return model


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, max_words: int | None = None, text_words: int | None = None, prior_rows: int = 100) -> Model:
    """Train and calibrate on all labelled rows. max_words, text_words: bounds for a quick try on fewer words."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = usable.agg(F.avg("toxic")).first()[0]
    rows = written(_rows(docs, usable, buckets, text_words), "labelled")
    if max_words is not None:
        sizes = sorted(rows.select(F.xxhash64("doc_id").alias("order"), "doc_id", "words").collect())
        chosen = [(sizes[i].doc_id,) for i in taken([r.words for r in sizes], max_words)]
        rows = rows.join(docs.sparkSession.createDataFrame(chosen, "doc_id long"), "doc_id")
    rows = rows.withColumn("part", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0))
    counts = {(r.part, r.toxic): r["count"] for r in rows.groupBy("part", "toxic").count().collect()}
    n = lambda *parts: np.array([sum(counts.get((p, y), 0) for p in parts) for y in (0, 1)])
    if not n(True, False).all():
        empty = np.zeros((1, DIM), np.float32)
        return Model(empty, np.zeros((len(TAPS), DIM, FILTERS), np.float32), np.zeros((len(WIDTHS), FILTERS), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), prior=float(share or 0.0))
    calibrate = F.col("part") if n(True).all() else F.lit(True)
    learn, own = (~F.col("part"), n(False)) if n(False).all() else (F.lit(True), n(True, False))
    kind = np.uint16 if buckets <= 1 << 16 else np.int32
    shards = -(-int(own.sum()) // _SHARD)
    dealt = rows.where(learn).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(shards)))
    dealt = written(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id"), "learn")
    return _calibrated(_trained(dealt, own, buckets, kind, shards), rows.where(calibrate), kind, prior_rows)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), flagged (score over the language's threshold) of every row."""
    model = fit(docs, labels, **options)
    n = len(model.embed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for whole in batches:
            for batch in text_slices(whole, limit=1 << 19):
                ids, counts = buckets_of(batch.column(1), n)
                score = model.scores(ids, counts, tables)
                limit = np.array([model.thresholds.get(x or "", 0.5) for x in batch.column(2).to_pylist()])
                yield pa.record_batch([batch.column(0), batch.column(3), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(score >= limit)], names=["doc_id", "held_out", "score", "predicted", "flagged"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    doc = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc.cast("string")) % 5 == 0, F.lit(False))
    return docs.select(doc.alias("doc_id"), "text", lang.alias("lang"), held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, flagged boolean")
