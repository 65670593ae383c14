import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import queries as Q
from tessera.llm import spelling

from . import helpers as H

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(rows, least_length=6, least_count=5, divisor=199):
    found = Counter()
    for doc, text, *_ in rows:
        for run in RUN.findall(text or ""):
            w = H.fold(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % divisor == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(rows, factor=5, **options):
    n = counts(rows, **options)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= factor * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


def rows_of(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def texts(seed=5, n=300):
    """Words with misspellings, Latin-1 letters, chains of forms and ties."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿÀ×") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    out = []
    for i in range(n):
        words = []
        for _ in range(80):
            w = base[min(rng.randrange(40), rng.randrange(40))]
            if rng.random() < 0.3:
                k, c = rng.randrange(len(w)), rng.choice("abé")
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        out.append((i, " ".join(words) + rng.choice(["", "1", "-x"]), "en", "s", 0))
    chain = ["chained", "chainea", "chaineab", "chainabb"]
    out += [(i, " ".join(sum(([w] * 2 * 9**k for k, w in enumerate(chain)), [])), "en", "s", 0) for i in range(900, 906)]
    return out


@pytest.mark.parametrize("block", [4096, 16, 3])
def test_brute_force(spark, block):
    rows = texts()
    want = brute(rows, divisor=7)
    assert len(want) > 100 and any(w[3] and w[5] != w[3] for w in want) and max(w[2] for w in want) > 3
    got = spelling.spelling_variants(H.frame(spark, rows).repartition(3), divisor=7, block=block)
    assert rows_of(got) == want


def test_odd_rows_and_clashing_columns(spark):
    got = spelling.spelling_variants(H.odd_frame(spark), least_length=3, least_count=2)
    assert rows_of(got) == brute(H.ODD, least_length=3, least_count=2)
    assert spelling.spelling_variants(H.frame(spark, [])).count() == 0


def test_very_long_words_and_many_alike(spark):
    """One edit apart at 200,000 letters, and one band value held by every word."""
    long = "x" * 200_000
    rows = [(i, f"{long} {long}y {long[:-1]}z", "en", "s", 0) for i in range(5)]
    rows += [(100 + i, " ".join(f"{a * 2}{b * 2}{c * 2}{d * 2}" for a in "abc" for b in "abc" for c in "abc" for d in "ab"), "en", "s", 0) for i in range(5)]
    got = spelling.spelling_variants(H.frame(spark, rows), divisor=10**9, block=8)
    assert rows_of(got) == brute(rows, divisor=10**9)


def test_pairs_once_per_direction(spark):
    words = spark.createDataFrame([(w, 5) for w in ("letter", "lettre", "letters", "better", "bitter", "butter")], "word string, n long")
    pairs = sorted((r.word, r.near) for r in spelling.near_words(words, block=1).collect())
    want = sorted((a, b) for a in ("letter", "lettre", "letters", "better", "bitter", "butter") for b in ("letter", "lettre", "letters", "better", "bitter", "butter") if one_edit(a, b))
    assert pairs == want


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = Q.op11_spelling_variants(spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == brute(rows)
