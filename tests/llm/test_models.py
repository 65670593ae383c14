import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import quality, toxicity
from tessera.llm import queries as Q
from tessera.llm.queries import vocabulary

from . import helpers as H


def _features(text):
    text = text or ""
    words = H.WORD.findall(text)
    lines = [x for x in text.split("\n") if H.WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    mask = [False] * len(words)
    for i, g in enumerate(grams):
        if seen[g] > 1:
            mask[i : i + 5] = [True] * 5
    n, rep = len(words), sum(mask)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n)


def test_features_match_brute_force(spark):
    rows = H.corpus(160)
    got = {r.doc_id: tuple(r[c] for c in quality.BASE) for r in quality.features(H.frame(spark, rows)).collect()}
    assert got == {i: _features(t) for i, t, *_ in rows}


def test_features_of_odd_rows(spark):
    got = quality.features(H.odd_frame(spark)).collect()
    assert len(got) == len(H.ODD)
    want = sorted((r[0] or 0, *_features(r[1])) for r in H.ODD)
    assert sorted((r.doc_id or 0, *(r[c] for c in quality.BASE)) for r in got) == want


def test_verdicts_without_labels_follow_the_base_rules(spark):
    none = H.labels(spark, [])
    got = quality.quality_verdicts(H.odd_frame(spark), none).collect()
    assert len(got) == len(H.ODD) and all(r.kept == (not r.base_failed) for r in got)
    assert quality.quality_verdicts(H.frame(spark, []), none).count() == 0
    assert quality.keep_good(H.odd_frame(spark), none).where("doc_id is null").count() == 1


@pytest.mark.parametrize("n, k, risk", [(50, 0, 0.02), (2000, 3, 0.0033), (100_000, 250, 0.004), (100_000, 380, 0.004), (10, 5, 0.02)])
def test_binomial_tail(spark, n, k, risk):
    from math import comb

    from pyspark.sql import functions as F

    got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), risk).alias("p")).first().p
    if k >= n * risk:
        assert got == 1.0
    elif n <= 2000:
        assert got == pytest.approx(sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)), rel=1e-9)
    else:
        from decimal import Decimal, getcontext

        getcontext().prec = 60
        p = Decimal(risk)
        term = total = (1 - p) ** n
        for i in range(1, k + 1):
            term *= (n - i + 1) * p / (i * (1 - p))
            total += term
        assert got == pytest.approx(float(total), rel=1e-8)


def test_cutoffs_reject_junk_and_spare_clean_documents(spark):
    rng = np.random.default_rng(4)
    rows, truth = [], []
    for i in range(6000):
        good = i % 5 != 0
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(14)]
        text = " ".join(words if good else [w + "***" for w in words])
        rows.append((i, text, "en" if i % 3 else "xx", "s", 0))
        truth.append((i, int(good), 0))
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(H.frame(spark, rows), H.labels(spark, truth), risk=0.1).collect()}
    assert all(got[i] == (i % 5 != 0) for i in range(6000))


def test_every_language_is_a_stratum_of_its_own(spark):
    """Production parameters: 99 good holdout rows certify alone, 134 for three strata; fr has too few and is not counted."""
    rows, truth = [], []
    for i in range(3600):
        lang = ["en", "en", "en", "de", None, "en"][i // 2 % 6] if i < 3000 else ("fr" if i < 3100 else "en")
        good = i % 7 != 0
        words = [f"w{i}x{j}" for j in range(14)]
        rows.append((i, " ".join(words if good else [w + "***" for w in words]), lang, "s", 0))
        truth.append((i, int(good), 0))
    docs, labels = H.frame(spark, rows), H.labels(spark, truth)
    report = {r.stratum: r for r in quality.rules_in_force(docs, labels).collect()}
    assert set(report) == {"=en", "=de", "", "=fr"}
    assert not report["=fr"].certifiable and report["=fr"].in_force == []
    assert all(report[s].certifiable and "symbols" in report[s].in_force for s in ("=en", "=de", ""))
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, labels).collect()}
    assert all(got[i] == (i % 7 != 0 or lang == "fr") for i, _, lang, *_ in rows)


def test_a_rule_set_that_rejects_good_holdout_documents_fails(spark):
    """On the proposing half the rule looks perfect, on the other it rejects a tenth of the good documents."""
    rows, truth = [], []
    for i in range(2000):
        good = i % 4 < 2
        junk = not good or (i % 2 and i % 20 == 1)
        rows.append((i, " ".join(f"w{i}x{j}" + "***" * junk for j in range(14)), "en", "s", 0))
        truth.append((i, int(good), 0))
    report = quality.rules_in_force(H.frame(spark, rows), H.labels(spark, truth)).collect()
    assert [(r.stratum, r.certifiable, r.in_force) for r in report] == [("=en", True, [])]


def test_certified_cutoffs_hold_their_risk(spark):
    """A rule whose ratio tells nothing is never switched on."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("a*" if rng.random() < 0.3 else "bcdef" for _ in range(1)) + " x y z u v w q r s t o p " + str(i), "en", "s", 0) for i in range(3000)]
    truth = [(i, int(rng.random() < 0.8), 0) for i in range(3000)]
    got = quality.quality_verdicts(H.frame(spark, rows), H.labels(spark, truth)).collect()
    assert sum(not r.kept for r in got) <= 0.03 * 3000


def test_toxicity_learns_and_respects_the_split(spark):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows, truth = [], []
    for i in range(1500):
        toxic = int(rng.random() < 0.3)
        words = list(rng.choice(base, 40))
        if toxic:
            words[rng.integers(40)] = str(rng.choice(["moron!", "IDIOT", "scum,"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        truth.append((i, 1, toxic))
    got = {r.doc_id: r for r in toxicity.toxicity(H.frame(spark, rows), H.labels(spark, truth)).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in sorted(got) if got[i].held_out] == held
    assert np.mean([got[i].predicted == truth[i][2] for i in held]) > 0.95
    flipped = [(i, q, 1 - t if i in set(held) else t) for i, q, t in truth]
    again = {r.doc_id: r.score for r in toxicity.toxicity(H.frame(spark, rows), H.labels(spark, flipped)).collect()}
    assert again == {i: r.score for i, r in got.items()}  # held-out labels are never read
    moved = [(i, t, "zz", "other", 9) for i, t, *_ in rows]
    assert {r.doc_id: r.score for r in toxicity.toxicity(H.frame(spark, moved), H.labels(spark, truth)).collect()} == again


def test_toxicity_of_odd_rows_and_without_labels(spark):
    odd = H.odd_frame(spark)
    got = toxicity.toxicity(odd, H.labels(spark, [(1, 1, None), (None, 1, 1), (2, 1, 0)])).collect()
    assert len(got) == len(H.ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(H.frame(spark, []), H.labels(spark, [])).count() == 0


def test_toxicity_languages_follow_their_rows_and_repeated_ids_do_no_harm(spark):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows, truth = [], []
    for i in range(700):
        toxic = int(rng.random() < 0.3)
        words = list(rng.choice(base, 40))
        if toxic:
            words[rng.integers(40)] = "scum"
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], "s", 0))
        truth.append((i, 1, toxic))
    rows += [(i, "another text of the same id", "en", "s", 0) for i in range(0, 700, 50)]
    docs, labels = H.frame(spark, rows), H.labels(spark, truth)
    model = toxicity.fit(docs, labels)
    assert set(model.thresholds) == {"", "de", "en"} and all(0 < t < 1 for t in model.thresholds.values())
    again = toxicity.fit(docs.repartition(7), labels)
    assert np.array_equal(again.embed, model.embed) and again.thresholds == model.thresholds
    small = toxicity.fit(docs, labels, max_words=4000)  # about a hundred rows
    assert small.prior is None and not np.array_equal(small.embed, model.embed)
    flat = toxicity.toxicity(docs, labels).collect()
    assert len(flat) == len(rows)
    for r in flat:
        assert r.predicted == int(r.score >= 0.5)


def test_plain_convolution_gives_the_same_scores(spark):
    """Scores against a network written word by word."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    m = toxicity.Model(rng.normal(size=(50, toxicity.DIM)).astype(np.float32), rng.normal(size=(len(toxicity.TAPS), toxicity.DIM, toxicity.FILTERS)).astype(np.float32), rng.normal(size=(3, toxicity.FILTERS)).astype(np.float32), rng.normal(size=3 * toxicity.FILTERS).astype(np.float32))
    texts = ["alpha beta gamma delta", "", "one", "zeta  eta", None]
    ids, counts = toxicity.buckets_of(pa.array(texts), 50)
    got, at = m.scores(ids, counts, m.tables()), 0
    for r, n in enumerate(counts):
        x = [sum(m.embed[b] for b in word) for word in ids[at : at + n]]
        at += n
        z = 0.0
        for i, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                acts = [sum(x[s + j] @ m.conv[toxicity.TAPS.index((w, j))][:, f] for j in range(w)) + m.bias[i, f] for s in range(n - w + 1)]
                z += max([0.0, *acts]) * m.out[i * toxicity.FILTERS + f]
        assert got[r] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def _fixture(spark, tmp_path, rows, truth=None):
    d = str(tmp_path)
    H.frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    H.labels(spark, truth or [(i, 1, 0) for i in range(20)]).write.parquet(f"{d}/labels.parquet")
    return d


def test_pipeline_matches_brute_force(spark, tmp_path):
    """With learned cutoffs (words with *** are junk) and random tokens that only the battery finds."""
    from tokenizers import Tokenizer

    from tessera.llm import secret_scan

    rng = np.random.default_rng(17)
    letters = secret_scan.ALPHABETS["base62"]
    rows = H.corpus(150, seed=11)
    truth = []
    for i in range(1000, 1840):  # 140 good holdout rows a language
        junk = i % 3 == 0
        words = [f"***{i}{j % 10}" if junk else f"w{i}x{j:02d}" for j in range(14)]
        if i % 40 == 1 and not junk:
            words[5] = "".join(letters[k] for k in rng.integers(0, 62, 48))
        rows.append((i, " ".join(words), ["en", "de"][i // 2 % 2], "s", 0))
        truth.append((i, int(not junk), 0))
    got = corpus_pipeline.run(spark, _fixture(spark, tmp_path, rows, truth)).collect()
    kept = [r for r in rows if not _features(r[1])[5] and "***" not in r[1]]
    cls = H.classes(kept, 5, 4, 5)
    kept = [r for r in kept if cls[r[0]][1] == r[0]]
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want, masked = {}, 0
    texts = {r[0]: r[1] for r in kept}
    for i, words, mask in H.without_repeats(kept):
        if words and all(mask):
            continue
        text = " ".join(w for w, gone in zip(words, mask) if not gone) if any(mask) else texts[i]
        spans = [(a, b) for _, a, b in secret_scan.base_spans(text)]
        tokens = [w for w in text.split() if len(w) == 48]
        masked += len(tokens)
        spans += [(text.index(w), text.index(w) + 48) for w in tokens]
        out, at = "", 0
        for a, b in sorted(spans):
            out, at = out + text[at:a] + "[secret]", b
        ids = [*lib.encode(out + text[at:], add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())
    assert masked >= 5
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got} == want


def test_texts_of_one_id_are_judged_apart(spark, tmp_path):
    rows = [(1, "ein Text mit mehr als zehn Worten steht hier fuer die erste Zeile", "de", "s", 0), (1, "zu kurz", "de", "s", 0), (1, "x" * 100_000, "de", "s", 0), (None, "auch ohne Nummer ein Text mit mehr als zehn Worten der hier bleibt", "de", "s", 0)]
    d = _fixture(spark, tmp_path, rows)
    for name in ("op2_bpe", "op4_quality_rules", "op5_pii", "op6_toxicity", "op8_secret_scan", "op9_license_scan", "op10_audio"):
        assert Q.QUERIES[name](spark, d).count() == 4, name
    assert {(r.doc_id, r.kept) for r in Q.op4_quality_rules(spark, d).collect()} == {(1, True), (1, False), (None, True)}
    pieces = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id or 0) for r in pieces) == [0, 1]


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    d = _fixture(spark, tmp_path, H.corpus(60))
    docs = H.odd_frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), d).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() >= 1


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    from .. import oracle

    con = oracle.connect(sf_dir)
    columns, ours, theirs = oracle.differences(Q.QUERIES[name](spark, sf_dir), con, Q.oracle_sql()[name])
    assert columns is None and not ours and not theirs




def test_one_long_text_does_not_switch_toxicity_off(spark):
    """A labelled text longer than the word bound stands in the sample by stretches, and one that does not fit is passed over."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        text = " ".join(rng.choice(words, 30)) + (" vile filth scum" if bad else " kind calm sun")
        rows.append((i, text * (400 if i < 12 else 1), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    got = toxicity.toxicity(H.frame(spark, rows), H.labels(spark, labels), max_words=6000, text_words=1000).collect()
    held = [r for r in got if r.held_out]
    assert len({r.score for r in got}) > 50
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in held]) > 0.9


def test_stretches_and_what_fits():
    at = toxicity.stretches(10_000, 1000)
    assert len(at) <= 1000 and at[0] == 0 and at[-1] == 9999 and (np.diff(at) > 0).all()
    assert toxicity.stretches(7, 1000).tolist() == list(range(7))
    assert toxicity.taken([5, 9, 3, 2], 10) == [0, 2, 3]


def test_stages_do_not_touch_each_others_tables(spark, tmp_path):
    """Two stages built before either runs, on different documents."""
    rows = H.corpus(60)
    H.labels(spark, [(i, i % 2, 0) for i in range(60)]).write.parquet(f"{tmp_path}/labels.parquet")
    docs = H.frame(spark, rows)
    first = [corpus_pipeline.good_quality(spark, docs, str(tmp_path)), corpus_pipeline.one_of_each(spark, docs, str(tmp_path))]
    more = [corpus_pipeline.without_repeats(spark, docs, str(tmp_path)), corpus_pipeline.without_secrets(spark, docs, str(tmp_path))]
    counts = [df.count() for df in (*first, *more)]
    alone = [stage(spark, docs, str(tmp_path)).count() for _, stage in corpus_pipeline.STAGES[:-1]]
    assert counts == alone and all(counts)


def test_toxicity_reads_every_labelled_word(spark):
    texts = [(i, "word " * (25_000 if i == 3 else i), "en", "s", 0) for i in range(12)]
    usable = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    rows = toxicity._rows(H.frame(spark, texts), usable, 1 << 16, None).collect()
    assert {r.doc_id: r.words for r in rows} == {i: 25_000 if i == 3 else i for i in range(10)}
    assert all(len(r.ids) == 2 * toxicity.PARTS * r.words for r in rows)


def test_toxicity_is_trained_in_shards(spark, monkeypatch):
    """Every row counts once for the bucket frequencies, and averaged shards learn what their rows tell."""
    monkeypatch.setattr(toxicity, "_SHARD", 64)
    counted, own = [], toxicity.first_model
    monkeypatch.setattr(toxicity, "first_model", lambda seen, n: counted.append((seen.max(axis=1), n)) or own(seen, n))
    rng = np.random.default_rng(8)
    rows, truth = [], []
    for i in range(800):
        words = ["common", *(f"w{k}" for k in rng.integers(0, 50, 20)), *(["scum"] if i % 4 == 0 else [])]
        rows.append((i, " ".join(words), "en", "s", 0))
        truth.append((i, 1, int(i % 4 == 0)))
    got = toxicity.toxicity(H.frame(spark, rows), H.labels(spark, truth)).collect()
    (seen, n) = counted[0]
    assert n.sum() > 400 and seen.tolist() == n.tolist()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][2] for r in held]) > 0.95
