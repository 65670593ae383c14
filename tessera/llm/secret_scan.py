"""Secret scans: a battery of randomness tests per inferred encoding, with length-aware false-discovery control.

Patterns give the base spans (assign, access, hex). Further candidates are maximal runs of token characters, 20 at least,
and the pieces of 20 at least into which a run falls at the characters outside base64, base64url and base62. A piece's
encoding is the smallest alphabet that holds all its characters (hex, base32, base36, base58/62, base64). The battery
tests it as a uniform sequence over that alphabet:

* chi-squared of the symbol counts (moments of the exact multinomial),
* number of runs above/below the middle of the alphabet,
* lag-1 serial correlation of the symbol indices;

a piece passes if the Bonferroni-combined p-value is at least `alpha`. The hypothesis tested of a run is that it is
ordinary: characters drawn as in the corpus's runs of letters, digits and the like. Against it stands, for each piece, the
likelihood ratio of a token that is uniform over one of the eight alphabets, each as likely as the others (so the choice
of the alphabet is paid for), to the corpus's character frequencies; it counts 0 where the battery fails. Characters other
than the 62 letters and digits are weighed by their share relative to these, which only lowers the ratio, so its
expectation for ordinary text is at most 1, for whichever class of characters the piece was cut by: an e-value. The run's
e-value is the mean of its pieces'. Per stratum of run length e-BH at level `fdr` runs over *all* runs of the corpus, those
that failed the battery included, from a histogram of fixed size: whatever the dependence between runs, the expected share
of ordinary ones among those reported is at most `fdr` in each stratum. In a reported run the pieces that reach the cutoff
themselves are named, of overlapping ones that with most bits.

Passes: (1) Arrow over the texts: base spans, candidates, byte counts, written to the shared folder; (2) the candidates'
tests and their histogram (8 x 256 cells at most go to the driver); (3) selection and assembly, DataFrame only.

`fdr` holds for that hypothesis: long identifiers and paths whose characters hang together are rarer than it expects, and
may be reported somewhat more often.

Defined cases: null and empty texts have no spans; a null doc_id is kept; repeated rows are each returned (and counted);
texts are taken whole, the work growing with their length however many tokens one holds;
ties in bits go to the longer, then the first piece; a table without rows gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import mark as tables_now
from tessera.llm._common import only, tidy_rows, written

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_HINT = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])=*")
_PIECES = [re.compile(p) for p in (r"[A-Za-z0-9+/]{20,}+", r"[A-Za-z0-9_-]{20,}+", r"[A-Za-z0-9]{20,}+")]

#: Alphabets by size (fixed values).
ALPHABETS = {
    "hex": string.digits + "abcdef",
    "HEX": string.digits + "ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase,
    "BASE36": string.digits + string.ascii_uppercase,
    "base62": string.digits + string.ascii_uppercase + string.ascii_lowercase,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "base64url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
}
_INDEX = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
#: First lengths of the strata.
STRATA = (20, 24, 32, 40, 48, 64, 96, 192)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if _HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def candidates(text: str) -> list[tuple[int, int, int, int, str]]:
    """(run, length of the run, start, end, token) of the runs' pieces, each once; a run's padding belongs to the span of
    what ends with it."""
    out = []
    for number, m in enumerate(_CANDIDATE.finditer(text)):
        run = m[0].rstrip("=")
        pieces = {x.span() for p in _PIECES for x in p.finditer(run)}
        for a, b in sorted(pieces):
            out.append((number, len(run), m.start() + a, m.end() if b == len(run) else m.start() + b, run[a:b]))
    return out


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token."""
    chars = set(token)
    return next((name for name, index in _INDEX.items() if chars <= index.keys()), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str, name: str) -> dict[str, float]:
    """p-values of the tests that the token is uniform over the alphabet."""
    k, n = len(ALPHABETS[name]), len(token)
    x = np.fromiter(map(_INDEX[name].__getitem__, token), np.int64, n)
    counts = np.bincount(x, minlength=k)
    chi2 = float(((counts - n / k) ** 2).sum() * k / n)
    # the statistic's exact mean and variance under a uniform multinomial; only an excess speaks against it
    p_chi2 = 0.5 * math.erfc((chi2 - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)) / math.sqrt(2))
    high = x >= k // 2
    runs, q = 1 + int((high[1:] != high[:-1]).sum()), (k - k // 2) / k
    switch = 2 * q * (1 - q)
    p_runs = _two_sided((runs - 1 - (n - 1) * switch) / math.sqrt((n - 1) * switch * (1 - switch)))
    z = (x - (k - 1) / 2) / math.sqrt((k * k - 1) / 12)
    p_serial = _two_sided(float((z[1:] * z[:-1]).sum()) / math.sqrt(n - 1))
    return {"chi2": p_chi2, "runs": p_runs, "serial": p_serial}


def log_shares(counts: np.ndarray) -> np.ndarray:
    """Log2 of each byte's share among letters and digits, from byte counts of the corpus (add-one, so none is 0)."""
    counts = counts + 1.0
    plain = [ord(c) for c in ALPHABETS["base62"]]
    return np.log2(counts / counts[plain].sum())


def log_e_value(token: str, log_share: np.ndarray) -> float:
    """Log2 of the likelihood ratio of a uniform token, over an alphabet that any of the eight may be, to ordinary text."""
    chars = set(token)
    sizes = sorted(len(index) for index in _INDEX.values() if chars <= index.keys())
    if not sizes:
        return -math.inf
    uniform = -len(token) * math.log2(sizes[0]) + math.log2(sum((sizes[0] / k) ** len(token) for k in sizes) / len(_INDEX))
    return float(uniform - log_share[np.frombuffer(token.encode(), np.uint8)].sum())


def _scan(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, base, candidates, bytes of rows (keys, text)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    fields = [("run", pa.int32()), ("size", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())]
    names = [f for f, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, cands, counts = [], [], np.zeros(256, np.int64)
            for t in batch.column("text"):
                text = t.as_py() or ""
                counts += np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
                bases.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base_spans(text)])
                cands.append([dict(zip(names, c, strict=True)) for c in candidates(text)])
            per_row = [counts.tolist()] + [None] * (batch.num_rows - 1)  # the batch's counts ride on its first row
            columns = [pa.array(bases, span), pa.array(cands, pa.list_(pa.struct(fields))), pa.array(per_row[: batch.num_rows], pa.list_(pa.int64()))]
            yield pa.record_batch([*(batch.column(k) for k in keys), *columns], names=[*keys, "base", "candidates", "bytes"])

    schema = ", ".join(f"{k} long" for k in keys) + ", base array<struct<kind:string,start:int,end:int>>"
    return docs.select(*keys, "text").mapInArrow(tidy_rows(run), schema + ", candidates array<struct<run:int,size:int,start:int,end:int,token:string>>, bytes array<bigint>")


def judge(found: list[dict], log_share: np.ndarray, alpha: float) -> tuple[list[dict], list[dict]]:
    """The runs of a text (stratum, bits of the e-value), and the pieces that pass the battery, none overlapping."""
    runs: dict[int, list[float]] = {}
    sizes, passed = {}, []
    for c in found:
        token = c["token"]
        name, e = encoding(token), -math.inf
        if name is not None:
            p = min(1.0, 3 * min(battery(token, name).values()))
            if p >= alpha:
                e = log_e_value(token, log_share)
                passed.append({"start": c["start"], "end": c["end"], "run": c["run"], "encoding": name, "bits": _bits(e), "p": p})
        runs.setdefault(c["run"], []).append(e)
        sizes[c["run"]] = c["size"]
    told = {}
    for number, es in runs.items():
        top = max(es)
        mean = top + math.log2(sum(2.0 ** max(-1000.0, e - top) for e in es) / len(es)) if top > -math.inf else top
        told[number] = {"stratum": sum(sizes[number] >= s for s in STRATA) - 1, "bits": _bits(mean)}
    apart: list[dict] = []
    taken: dict[int, list[tuple[int, int]]] = {}  # per run the kept pieces by start; as none overlap, only neighbours can
    for t in sorted(passed, key=lambda t: (-t["bits"], t["start"] - t["end"], t["start"])):
        kept = taken.setdefault(t["run"], [])
        at = bisect.bisect(kept, (t["start"], t["end"]))
        if (at == 0 or kept[at - 1][1] <= t["start"]) and (at == len(kept) or t["end"] <= kept[at][0]):
            kept.insert(at, (t["start"], t["end"]))
            apart.append(t)
    pieces = [{**t, "stratum": told[t["run"]]["stratum"], "run_bits": told[t["run"]]["bits"]} for t in sorted(apart, key=lambda t: t["start"])]
    return list(told.values()), pieces


def _bits(e: float) -> int:
    return int(min(255.0, max(0.0, e)))


def _tested(scanned: DataFrame, keys: list[str], log_share: np.ndarray, alpha: float) -> DataFrame:
    """keys, base, runs (stratum, bits) and tokens that pass the battery."""
    run_type = [("stratum", pa.int32()), ("bits", pa.int32())]
    token_type = [("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("stratum", pa.int32()), ("run_bits", pa.int32()), ("bits", pa.int32()), ("p", pa.float64())]
    wanted = [f for f, _ in token_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [judge(row, log_share, alpha) for row in batch.column("candidates").to_pylist()]
            runs = pa.array([r for r, _ in judged], pa.list_(pa.struct(run_type)))
            tokens = pa.array([[{f: t[f] for f in wanted} for t in ts] for _, ts in judged], pa.list_(pa.struct(token_type)))
            yield pa.record_batch([*(batch.column(k) for k in keys), batch.column("base"), runs, tokens], names=[*keys, "base", "runs", "tokens"])

    schema = ", ".join(f"{k} long" for k in keys) + ", base array<struct<kind:string,start:int,end:int>>, runs array<struct<stratum:int,bits:int>>"
    schema += ", tokens array<struct<start:int,end:int,encoding:string,stratum:int,run_bits:int,bits:int,p:double>>"
    return scanned.select(*keys, "base", "candidates").mapInArrow(tidy_rows(run), schema)


def e_bh_cutoffs(histogram: dict[tuple[int, int], int], totals: dict[int, int], fdr: float) -> list[int]:
    """Per stratum the least number of bits b with 2**b >= m / (fdr * #{bits >= b}); 256 where none."""
    out = []
    for stratum in range(len(STRATA)):
        m, above, cut = totals.get(stratum, 0), 0, 256
        for bits in range(255, -1, -1):
            above += histogram.get((stratum, bits), 0)
            if above and bits >= math.log2(max(1, m) / (fdr * above)):
                cut = bits
        out.append(cut)
    return out


def _spans(texts: DataFrame, keys: list[str], fdr: float, alpha: float) -> DataFrame:
    """keys, base, found of rows (keys, text)."""
    scanned = written(_scan(texts, keys), "secrets")
    counts = np.zeros(256)
    for byte, n in scanned.where("bytes is not null").select(F.posexplode("bytes").alias("b", "n")).groupBy("b").agg(F.sum("n")).collect():
        counts[byte] += n
    tested = written(_tested(scanned, keys, log_shares(counts), alpha), "tested")
    cells = tested.select(F.explode("runs").alias("t")).groupBy("t.stratum", "t.bits").count().collect()
    histogram = {(s, b): n for s, b, n in cells}
    totals: dict[int, int] = {}
    for (s, _), n in histogram.items():
        totals[s] = totals.get(s, 0) + n
    cut = F.array(*[F.lit(c) for c in e_bh_cutoffs(histogram, totals, fdr)])
    found = F.filter("tokens", lambda t: (t["run_bits"] >= F.get(cut, t["stratum"])) & (t["bits"] >= F.get(cut, t["stratum"])))
    free = F.filter(found, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return tested.select(*keys, "base", free.alias("found"))


def secret_spans(docs: DataFrame, fdr: float = 0.01, alpha: float = 0.001) -> DataFrame:
    """(doc_id, base, found) of every whole text; found are the method's own spans (kind `random`, encoding, bits, p)."""
    return _spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), ["doc_id"], fdr, alpha)


def spans_in_order() -> Column:
    """Spans (kind, start, end) of the columns base and found, by start, then kind as listed, `random` last."""
    as_span = lambda s, rank: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"))
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).otherwise(2)
    spans = F.array_sort(F.concat(F.transform("base", lambda s: as_span(s, rank(s))), F.transform("found", lambda s: as_span(s, F.lit(3)))))
    name = F.array(*[F.lit(k) for k in (*BASE, "random")])
    return F.transform(spans, lambda s: F.struct(F.get(name, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def redact(docs: DataFrame, fdr: float = 0.01, mark: str = "[secret]") -> DataFrame:
    """Columns of docs, every secret span of the text replaced by `mark`.

    Texts and spans meet through two 64-bit keys of the text itself, so null or repeated doc_ids do no harm, and a text
    that occurs often is scanned once. Only texts with spans have a row on the other side of that join."""
    keys = ["key", "other_key"]
    key = [F.xxhash64("text", F.lit(1)).alias("key"), F.xxhash64(F.lit(2), "text").alias("other_key")]
    since = tables_now()
    texts = docs.where("text is not null").select(*key, F.col("text").alias("text")).dropDuplicates(keys)
    spans = written(_spans(texts, keys, fdr, 0.001).select(*keys, spans_in_order().alias("spans")).where(F.size("spans") > 0), "spans")
    only(since, spans)
    step = lambda acc, s: F.struct(
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring("doc.text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *key).join(spans, keys, "left")
    joined = joined.withColumn("done", F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step))
    text = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(F.concat("done.out", F.substring("doc.text", F.col("done.at") + 1, F.length("doc.text"))))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
