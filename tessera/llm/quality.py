"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Per document: word and symbol counts, duplicate lines and repeated 5-word windows (see `features`), all inside the row by
array functions, so nothing is shuffled. Rules reject when a ratio exceeds a cutoff. Cutoffs are learned from labels, in
every language (stratum) apart:

* half of the labelled rows (even doc_id) proposes: per rule the cutoff with the best bad-minus-weighted-good rejection, and
  an order of the rules by that gain (rules without a gain are left out). This gives nested rule sets, the first rule, the
  first two, and so on;
* the other half certifies: a rule set is certified if the exact binomial tail P(Bin(n, risk) <= k) is at most the
  stratum's share of `confidence`, k of the n good holdout documents being rejected by any rule of the set. The sets are
  tested from the smallest on and testing stops at the first failure (fixed sequence, which needs no correction), strata
  share `confidence` by Bonferroni in Tarone's form: strata whose n could not certify anything, (1 - risk) ** n being above
  the share, are not counted and certify nothing. So with probability 1 - confidence the rules in force falsely reject
  at most the share `risk` of good documents in every stratum at once;
* the largest certified set is in force in the stratum.

No stratum is pooled with others and none has a minimum size of labels but that bound (99 good holdout rows for one
stratum, 145 for four); `rules_in_force` reports each. The features are written once to the shared folder.

Defined cases: null and empty texts have no words and fail the base rules; a null lang is its own stratum; a null doc_id is
kept (it matches no label); several labels of a doc_id count as the least; ties in gain go to the mildest cutoff, then
to the first rule by name; repeated rows are each returned; without labels, or with too few to certify anything, only
the base rules apply; a table without rows gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._common import mark, only, written

WORD = r"[^\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: rule -> (numerator, denominator, largest cutoff of the grid)
RULES = {
    "symbols": ("n_symbols", "n_words", 1.2),
    "dup_lines": ("n_dup_lines", "n_lines", 0.96),
    "repeats": ("n_repeat_words", "n_words", 0.24),
    "long_words": ("word_chars", "n_words", 24.0),
    "shouting": ("n_bangs", "n_words", 1.2),
    "capitals": ("n_capitals", "word_chars", 0.96),
}
STEPS = 24
#: Largest share of good documents that all rules together may reject in a stratum.
RISK = 0.03


def grid(rule: str) -> list[float]:
    """The rule's cutoffs, rising."""
    top = RULES[rule][2]
    return [round(top * (i + 1) / STEPS, 6) for i in range(STEPS)]


def features(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, carry, the counts in BASE, n_lines, n_bangs, n_capitals of every whole text.

    n_repeat_words: each 5-word window becomes (hash << b) | position with 2**b > n_words; equal windows are neighbours
    after sorting. What so agrees in the upper bits is sorted by the whole 64-bit hash, neighbours of equal hash are
    compared by their words, and the positions found are merged as intervals of five words."""
    text = F.coalesce("text", F.lit(""))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.cast("string").alias("lang"), text.alias("text"), *carry)
    rows = rows.select(
        "doc_id",
        "lang",
        *carry,
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[!?]")).cast("long").alias("n_bangs"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
    )
    windows = F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id",
        "lang",
        *carry,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_bangs",
        "n_capitals",
        "words",
        windows.alias("windows"),
    )
    mask = F.expr("shiftleft(1L, length(bin(n_words))) - 1")
    rows = rows.withColumn("mask", mask)
    rows = rows.withColumn("keyed", F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(F.bitwise_not("mask")).bitwiseOR(i.cast("long")))))
    close = lambda x, y: F.coalesce(x.bitwiseOR(F.col("mask")) == y.bitwiseOR(F.col("mask")), F.lit(False))
    near = F.filter("keyed", lambda x, i: close(x, F.get("keyed", i - 1)) | close(x, F.get("keyed", i + 1)))
    at = F.transform(near, lambda x: x.bitwiseAND(F.col("mask")).cast("int"))
    rows = rows.withColumn("near", F.sort_array(F.transform(at, lambda p: F.struct(F.get("windows", p).alias("h"), p.alias("p"))))).drop("keyed", "mask", "windows")
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (F.slice("words", x["p"] + 1, 5) == F.slice("words", y["p"] + 1, 5)), F.lit(False))
    twice = F.filter("near", lambda x, i: same(x, F.get("near", i - 1)) | same(x, F.get("near", i + 1)))
    rows = rows.withColumn("twice", F.sort_array(F.transform(twice, lambda x: x["p"].cast("long")))).drop("near", "words")
    covered = F.aggregate(
        "twice",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + 5 - F.greatest(acc["end"], p)).alias("n"), (p + 5).alias("end")),
        lambda acc: acc["n"],
    )
    rows = rows.withColumn("n_repeat_words", covered).drop("twice")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _ratio(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")), F.lit(0.0))


def _exceeded(rule: str) -> Column:
    """How many of the rule's cutoffs a document exceeds."""
    ratio = _ratio(rule)
    return F.size(F.filter(F.array(*[F.lit(c) for c in grid(rule)]), lambda cut: ratio > cut))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, so its error is below 1e-13 for every n."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    shift = F.log(n.cast("double") + 1)
    for i in range(2, 9):
        shift = shift + F.log(n.cast("double") + i)
    return series - shift


def binomial_tail(n: Column, k: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), for k < n * risk (else 1): the term of k, and the lower ones by their ratio as far down as they
    change a double (12 standard deviations and 60 more)."""
    q, lost = 1 - risk, n - k
    log_top = _log_factorial(n) - _log_factorial(k) - _log_factorial(lost) + k * F.log(F.lit(risk)) + lost * F.log(F.lit(q))
    count = F.least(k, F.ceil(12 * F.sqrt(n * (risk * q))) + 60)
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    series = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, j: F.struct((acc["term"] * ((k - j) * q / ((n - k + j + 1) * risk))).alias("term"), (acc["sum"] + acc["term"] * ((k - j) * q / ((n - k + j + 1) * risk))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(k < n * risk, F.exp(log_top) * series).otherwise(F.lit(1.0))


def _stratum() -> Column:
    return F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))


def propose(tune: DataFrame, good_weight: float) -> DataFrame:
    """From rows of (stratum, good, the counts): stratum and per rule cut_ and rank_ (null: not proposed)."""
    rules = list(RULES)
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), _exceeded(r).alias("above")) for r in rules])
    rows = tune.select("stratum", "good", F.explode(levels).alias("level"))
    # how many rows exceed the first i cutoffs and no more; at most strata x rules x (STEPS + 1) rows from here on
    cells = rows.groupBy("stratum", "level.rule", "level.above").agg(F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad"))
    every = cells.select("stratum", "rule").distinct().select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("above"))
    cells = every.join(cells, ["stratum", "rule", "above"], "left").fillna(0)
    by = W.partitionBy("stratum", "rule")
    down = by.orderBy(F.desc("above")).rowsBetween(W.unboundedPreceding, 0)
    rate = lambda c: F.coalesce(F.try_divide(F.sum(c).over(down).cast("double"), F.sum(c).over(by).cast("double")), F.lit(0.0))
    gains = cells.select("stratum", "rule", "above", F.round(rate("bad") - good_weight * rate("good"), 9).alias("gain")).where("above > 0 and gain > 0")
    best = gains.groupBy("stratum", "rule").agg(F.max("gain").alias("gain"), F.max_by("above", F.struct("gain", "above")).alias("above"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("stratum").orderBy(F.desc("gain"), "rule")))
    cut = lambda r: F.get(F.array(*[F.lit(c) for c in grid(r)]), F.col("above") - 1)
    own = lambda r, c: F.max(F.when(F.col("rule") == r, c))
    return ranked.groupBy("stratum").agg(*[own(r, cut(r)).alias(f"cut_{r}") for r in rules], *[own(r, F.col("rank")).alias(f"rank_{r}") for r in rules])


def certify(plan: DataFrame, holdout: DataFrame, risk: float, confidence: float) -> DataFrame:
    """From `propose` and the good holdout rows (stratum, the counts): one row per proposed stratum with hold_good, certifiable
    and the cutoffs of the rules in force (null: off)."""
    rules = list(RULES)
    met = holdout.join(plan, "stratum")
    first = F.least(*[F.when(_ratio(r) > F.col(f"cut_{r}"), F.col(f"rank_{r}")) for r in rules])  # null: no rule rejects
    counts = met.select("stratum", first.alias("first")).groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("first") <= j).alias(f"k{j}") for j in range(1, len(rules) + 1)])
    # one row a stratum from here on
    strata = plan.join(counts, "stratum", "left").fillna(0, ["n", *[f"k{j}" for j in range(1, len(rules) + 1)]])
    strata = strata.withColumn("least_p", F.exp(F.col("n") * F.log(F.lit(1 - risk))))
    order = W.orderBy("least_p", "stratum")
    strata = strata.withColumn("place", F.row_number().over(order)).withColumn("next_p", F.lead("least_p").over(order))
    share = strata.agg((F.lit(confidence) / F.min(F.when(F.coalesce(F.col("next_p") > F.lit(confidence) / F.col("place"), F.lit(True)), F.col("place")))).alias("share"))
    tested = strata.join(F.broadcast(share))  # one row
    passed, held = F.col("least_p") <= F.col("share"), F.lit(0)
    for j in range(1, len(rules) + 1):
        passed = passed & (binomial_tail(F.col("n"), F.col(f"k{j}"), risk) <= F.col("share"))
        held = F.when(passed, F.lit(j)).otherwise(held)
    tested = tested.withColumn("held", held)
    cuts = [F.when(F.col(f"rank_{r}") <= F.col("held"), F.col(f"cut_{r}")).alias(f"cut_{r}") for r in rules]
    return tested.select("stratum", F.col("n").alias("hold_good"), (F.col("least_p") <= F.col("share")).alias("certifiable"), *cuts)


def _learned(found: DataFrame, labels: DataFrame, risk: float, confidence: float, good_weight: float) -> DataFrame:
    """The cutoffs of every proposed stratum."""
    truth = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    counts = sorted({c for top, bottom, _ in RULES.values() for c in (top, bottom)})
    labelled = found.where("not base_failed").join(truth, "doc_id").select(_stratum().alias("stratum"), (F.col("doc_id") % 2 != 0).alias("holdout"), (F.col("quality") == 1).alias("good"), *counts)
    labelled = written(labelled, "labelled")
    plan = written(propose(labelled.where("not holdout"), good_weight), "proposed")
    return written(certify(plan, labelled.where("holdout and good"), risk, confidence), "cutoffs")


def rules_in_force(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = 0.05, good_weight: float = 10.0) -> DataFrame:
    """One row per stratum for which rules were proposed: stratum (= and the language, empty for null), hold_good,
    certifiable, in_force (names of the rules that are on)."""
    cuts = _learned(written(features(docs), "features"), labels, risk, confidence, good_weight)
    on = F.array_compact(F.array(*[F.when(F.col(f"cut_{r}").isNotNull(), F.lit(r)) for r in RULES]))
    return cuts.select("stratum", "hold_good", "certifiable", on.alias("in_force"))


def _judged(found: DataFrame, cuts: DataFrame) -> DataFrame:
    """found (of `features`) with the column kept."""
    judged = found.withColumn("stratum", _stratum()).join(cuts, "stratum", "left")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_ratio(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return judged.withColumn("kept", ~(F.col("base_failed") | rejected))


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = 0.05, good_weight: float = 10.0) -> DataFrame:
    """doc_id, BASE and kept for every row of docs. labels: doc_id, quality (1 good, 0 bad; null is no label)."""
    found = written(features(docs), "features")
    return _judged(found, _learned(found, labels, risk, confidence, good_weight)).select("doc_id", *BASE, "kept")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = 0.05, good_weight: float = 10.0) -> DataFrame:
    """The rows of docs that pass, with their columns.

    Cutoffs are learned from a table of the features; then the texts are read once more, judged and passed on in one go,
    so that no document is written or shuffled on the way."""
    since = mark()
    cuts = _learned(written(features(docs), "features"), labels, risk, confidence, good_weight)
    only(since, cuts)
    lang = [F.col("lang").alias("lang")] if "lang" in docs.columns else []
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), *lang)
    # a condition that is not deterministic stays above the features; pushed below, it would repeat their expressions many times over
    found = features(rows, carry=("doc",)).withColumn("_here", F.spark_partition_id())
    return _judged(found, cuts).where("kept and _here >= 0").select("doc.*")
