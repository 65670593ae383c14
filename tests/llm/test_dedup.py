import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fractions import Fraction

from tessera.llm._common import Answers, Words, _bucket, ask_rows, components, discard, grams, release, shards_for, shared_dir, written
from tessera.llm.ngram_join import keep_one_of_each, near_duplicate_classes, passing_pairs, settle_names
from tessera.llm.substring_dedup import HighSymbols, Windows, _covered, recompress, remove_repeats

from . import helpers as H


@pytest.mark.parametrize("k, t, num, den", [(3, "9/10", 9, 10), (5, "4/5", 4, 5)])
def test_classes_match_all_pairs(spark, k, t, num, den):
    rows = H.corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_classes(H.frame(spark, rows), k, t).collect()}
    assert got == H.classes(rows, k, num, den)


def test_chain_of_links_is_one_class(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 60 - i] + [f"x{i}{j}" for j in range(i)]), "en", "s", 0) for i in range(6)]
    got = {r.doc_id: r.component_id for r in near_duplicate_classes(H.frame(spark, rows), 3, "9/10").collect()}
    assert got == {i: c for i, (_, c) in H.classes(rows, 3, 9, 10).items()}


def test_many_near_copies_over_several_blocks_and_full_buckets(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"z{i}"] + base[i + 1 :]), "en", "s", 0) for i in range(150)]
    got = near_duplicate_classes(H.frame(spark, rows), 3, "9/10", block_tokens=4000, bucket=3).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 150


@pytest.mark.parametrize("k, t, num, den", [(3, "9/10", 9, 10), (5, "4/5", 4, 5)])
def test_families_of_several_blocks_with_stragglers(spark, k, t, num, den):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(140):
        words = list(base)
        for j in rng.choice(120, rng.integers(0, 9), replace=False):
            words[j] = f"z{rng.integers(1000)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_classes(H.frame(spark, rows), k, t, block_tokens=1500).collect()}
    want = H.classes(rows, k, num, den)
    assert got == want and 3 < len({c for _, c in want.values()}) < 140


def test_keep_one_of_each(spark):
    rows = H.corpus()
    kept = keep_one_of_each(H.frame(spark, rows)).collect()
    want = {i for i, (_, c) in H.classes(rows, 5, 4, 5).items() if i == c}
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)


def test_keep_one_of_each_tells_texts_of_one_id_apart(spark):
    text = lambda seed: " ".join(f"{seed}{j}" for j in range(30))
    rows = [(5, text("a")), (5, text("b")), (6, text("a")), (1, text("c")), (7, text("d")), (7, text("e")), (8, text("b")), (3, text("e")), (7, text("d")), (None, text("a")), (9, ""), (9, None), (9, "")]
    kept = keep_one_of_each(H.frame(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()
    key = lambda r: (r[0] or -1, r[1] or "~")
    want = [(5, text("a")), (5, text("b")), (1, text("c")), (7, text("d")), (3, text("e")), (None, text("a")), (9, ""), (9, None)]
    assert sorted(((r.doc_id, r.text) for r in kept), key=key) == sorted(want, key=key)


def _thue_morse(n, letters):
    """Such words collide under every polynomial hash modulo a power of two."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [8, 1024, 4096])
def test_regular_words_and_windows_have_different_names(n):
    a, b = _thue_morse(n, "ab"), _thue_morse(n, "ba")
    w = Words(pa.array([f"{a} {b}"]))
    assert w.hash[0] != w.hash[1] and w.check[0] != w.check[1] and w.hash[0] != w.check[0]
    x = np.where([c == "a" for c in a], np.uint64(3), np.uint64(5))
    assert grams(x, n)[0] != grams(np.uint64(8) - x, n)[0]


def test_regular_words_link_and_remove_nothing(spark):
    a, b = _thue_morse(2048, "AB"), _thue_morse(2048, "BA")
    rows = [(1, f"{a} q r s", "en", "s", 0), (2, f"{b} q r s", "en", "s", 0)]
    got = {r.doc_id: r.component_id for r in near_duplicate_classes(H.frame(spark, rows), 3, "9/10").collect()}
    assert got == {1: 1, 2: 2}
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{a} {tail}", "en", "s", 0), (2, f"{b} {tail}", "en", "s", 0), (3, f"{a} {tail}", "en", "s", 0)]
    assert {r.doc_id: r.n_removed for r in remove_repeats(H.frame(spark, rows)).collect()} == {1: 0, 2: 0, 3: 13}


def test_units_that_share_a_name_are_named_anew(spark):
    rows = [(1, 10, 7), (2, 10, 7), (3, 10, 8), (4, 11, 9)]
    got = {r.doc_id: r.unit for r in settle_names(spark.createDataFrame(rows, "doc_id long, unit long, mark long")).collect()}
    assert got[1] == got[2] != got[3] and 10 not in (got[1], got[3]) and got[4] == 11


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=14), min_size=2, max_size=9), st.sampled_from([Fraction(4, 5), Fraction(9, 10), Fraction(1, 2)]))
def test_similar_groups_stay_connected(sets, t):
    """Bucket by bucket, as the join sees them: groups by prefix tokens with places, any pair of similar sets is connected."""
    import math

    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for token in range(26):
        rows = []
        for g, s in enumerate(sets):
            order = sorted(s)
            prefix = order[: len(s) - math.ceil(t * len(s)) + 1]
            if token in prefix:
                rows.append((len(s), g, prefix.index(token)))
        rows.sort()
        if rows:
            n, g, place = (np.array(c) for c in zip(*rows))
            for a, b in zip(*passing_pairs(np.full(len(rows), token), np.zeros(len(rows)), g, n, place, t)):
                parent[find(int(a))] = find(int(b))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i < j and len(x & y) >= t * len(x | y):
                assert find(i) == find(j)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([1, 2]), st.integers(0, 4), st.integers(-5, 5)), min_size=1, max_size=30), st.booleans())
def test_census_answers(entries, checked):
    """(name, check, shard, doc): names equal in the first lane only are told apart."""
    asked, want = [], {}
    for shard in sorted({e[2] for e in entries}):
        mine = sorted({(n, c if checked else 0) for n, c, s, _ in entries if s == shard})
        docs = {k: {d for n, c, s, d in entries if s == shard and (n, c if checked else 0) == k} for k in mine}
        names, checks = (np.array(x, np.uint64) for x in zip(*mine))
        asked.append(ask_rows(shard, 1, names, np.array([min(2, len(docs[k])) for k in mine], np.uint8), checks if checked else None, np.array([min(docs[k]) for k in mine], np.int64)))
        for k in mine:
            want.setdefault(k, {})[shard] = docs[k]
    answers = _bucket(pa.concat_tables(asked))
    for shard in {e[2] for e in entries}:
        mine = Answers(answers.filter(pa.compute.equal(answers["shard"], shard)))
        for (n, c), by in want.items():
            if shard not in by:
                continue
            least = min(d for ds in by.values() for d in ds)
            told = any(d > least for d in by[shard])
            at = mine.find(np.array([n], np.uint64), np.array([c], np.uint64) if checked else None)[0]
            assert (at >= 0) == told or (at >= 0 and min(by[shard]) == least)
            if told:
                assert mine.least[at] == least


def test_scratch_tables_are_removed(spark):
    import os

    table = written(spark.range(3), "scratch")
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder) and table.count() == 3
    discard(table)
    assert not os.path.isdir(folder)
    kept = written(spark.range(3), "scratch").inputFiles()[0].removeprefix("file://")
    release(spark)
    assert not os.path.exists(kept) and shared_dir(spark)
    assert shards_for(spark, 10 << 30) == 160 and shards_for(spark, None) == 4


def test_odd_rows_have_defined_classes(spark):
    got = near_duplicate_classes(H.odd_frame(spark), 3, "9/10").collect()
    assert len(got) == len(H.ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[1].component_id == 1 and by[2].component_id == 2 and by[6].component_id == 5
    assert by[None].component_id is None and by[None].n_shingles > 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (9, 1), (20, 21), (22, 21), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {5: 1, 3: 1, 9: 1, 1: 1, 20: 20, 21: 20, 22: 20}


def test_components_of_long_paths_and_random_graphs(spark):
    rng = np.random.default_rng(1)
    path = rng.permutation(200)
    edges = [(int(a), int(b)) for a, b in zip(path, path[1:])] + [tuple(map(int, 1000 + rng.integers(0, 300, 2))) for _ in range(200)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if any(a != b and n in (a, b) for a, b in edges)}


def test_repeats_match_brute_force(spark):
    rows = H.corpus(160, seed=5)
    got = {r.doc_id: (r.n_words, r.n_removed, H.WORD.findall(r.text)) for r in remove_repeats(H.frame(spark, rows)).collect()}
    want = {i: (len(w), sum(m), [x for x, gone in zip(w, m) if not gone]) for i, w, m in H.without_repeats(rows)}
    assert got == want


def test_repeats_of_odd_rows(spark):
    got = remove_repeats(H.odd_frame(spark)).collect()
    assert len(got) == len(H.ODD)
    by = {r.doc_id: r for r in got}
    assert by[6].n_removed == by[6].n_words == 90 and by[5].n_removed == 0
    assert by[1].n_words == 0 and by[1].text is None and by[None].n_removed == 0
    assert by[8].shard == "shard"


def test_empty_tables(spark):
    empty = H.frame(spark, [])
    assert near_duplicate_classes(empty).count() == 0
    assert remove_repeats(empty).count() == 0
    assert keep_one_of_each(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=13, max_size=60), st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_equal_windows_have_equal_representatives(core, before, after):
    """Whatever surrounds a window, its representative is the same."""
    texts = [" ".join(core), " ".join(before + core + after), " ".join(after + core + before)]
    words = Words(pa.array(texts))
    w = Windows(words, 13)
    names = w.representatives(2)
    keys = {}
    flat = [x for t in texts for x in t.split()]
    for at, name in zip(w.at, names):
        assert keys.setdefault(tuple(flat[at : at + 13]), name) == name


def test_recompression_shrinks_and_covers():
    words = Words(pa.array(["a b c d e f g h i j k l m n o p " * 20]))
    s = recompress(words.hash, words.row, 2)
    assert len(s.name) < 0.75 * len(words.hash)
    assert s.start[0] == 0 and s.end[-1] == len(words.hash) and (s.start[1:] == s.end[:-1]).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b日", max_size=20)), max_size=8))
def test_words_match_the_pattern(texts):
    words = Words(pa.array(texts, pa.string()), fold=True)
    want = [H.WORD.findall(H.fold(t or "")) for t in texts]
    assert words.counts.tolist() == [len(w) for w in want]
    seen = {}
    for name, word in zip(words.hash.tolist(), [x for w in want for x in w]):
        assert seen.setdefault(word, name) == name
    assert len(set(seen.values())) == len(seen)
    assert np.array_equal(words.first, np.cumsum([0, *words.counts]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=200), st.lists(st.sampled_from("abcdef"), max_size=60))
def test_high_symbols_name_what_they_replace(words, more):
    texts = [" ".join(words), " ".join(more + words), " ".join(words)]
    flat = [x for t in texts for x in t.split()]
    w = Words(pa.array(texts))
    name, check, start, end, row = HighSymbols(w, 6).joined(3)
    spelled = {}
    for n, c, a, b in zip(name.tolist(), check.tolist(), start, end):
        assert spelled.setdefault((n, c), flat[a:b]) == flat[a:b]
    copies = [[k for k, r in zip(zip(name.tolist(), check.tolist()), row) if r == i] for i in (0, 2)]
    assert copies[0] == copies[1]


def test_covered():
    assert _covered(np.array([1, 2, 6]), np.array([3, 4, 7]), 8).tolist() == [False, True, True, True, False, False, True, False]


def test_long_copies_are_settled_by_high_symbols(spark):
    rng = np.random.default_rng(8)
    text = " ".join(f"w{i}" for i in rng.integers(0, 90, 700))
    rows = [(i, text if i % 2 else f"{text} and something else {i}", "en", "s", 0) for i in range(6)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(H.frame(spark, rows)).collect()}
    assert got == {i: (len(w), sum(m)) for i, w, m in H.without_repeats(rows)}


def test_words_built_to_share_a_name_do_not(spark):
    """Under the fixed key two words of 16 bytes can be built to have one first lane; keys of a run are drawn anew."""
    from tessera.llm._common import _NAME, mix, new_key

    one = lambda x: int(mix(np.array([x], np.uint64))[0])
    inner = one(16 + _NAME & 2**64 - 1)
    first = b"Passwordmanageme"
    a, b = (int.from_bytes(first[i : i + 8], "little") for i in (0, 8))
    want = a ^ one(b ^ inner)
    for k in range(10**6):  # another second half whose first half is text
        other = int.from_bytes(f"{k:08d}".encode(), "little")
        half = want ^ one(other ^ inner)
        if all(c not in b" \t\n\v\f\r" for c in half.to_bytes(8, "little")):
            break
    second = half.to_bytes(8, "little") + other.to_bytes(8, "little")
    assert first != second
    column = pa.StringArray.from_buffers(2, pa.py_buffer(np.array([0, 16, 32], np.int32).tobytes()), pa.py_buffer(first + second))
    fixed, drawn = Words(column), Words(column, key=new_key())
    assert fixed.rows == len(fixed.hash) == 2
    assert fixed.hash[0] == fixed.hash[1] and fixed.names()[0] != fixed.names()[1]
    assert drawn.hash[0] != drawn.hash[1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(6, 30), st.integers(0, 5)), min_size=2, max_size=14), st.sampled_from([Fraction(4, 5), Fraction(9, 10)]))
def test_large_buckets_have_the_same_families(groups, t):
    """Sizes compared by their best group give the components of all passing pairs."""
    from tessera.llm.ngram_join import size_thresholds

    rows = sorted((n, min(place, n - 1), g) for g, (n, place) in enumerate(groups))
    n, place, _ = (np.array(c, np.int64) for c in zip(*rows))
    left = n - place - 1
    passes = lambda i, j: n[i] * t.denominator >= n[j] * t.numerator and (1 + min(left[i], left[j])) * (t.numerator + t.denominator) >= t.numerator * (n[i] + n[j])

    def parts(edges):
        parent = list(range(len(n)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(n))]

    want = parts([(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if passes(i, j)])
    sizes = np.unique(n)
    heads = [max(np.flatnonzero(n == s), key=lambda i: left[i]) for s in sizes]
    bound = lambda x, y: -(-(t.numerator * (x + y)) // (t.numerator + t.denominator)) - 1
    alike = np.array([(left[n == s] >= bound(s, s)).sum() > 1 for s in sizes])
    need = size_thresholds(sizes, left[heads], alike, t)
    same = np.zeros(len(sizes), np.int64)
    a, b = passing_pairs(same, same, np.array(heads), sizes, sizes - 1 - left[heads], t)
    stars = [(i, heads[k]) for k, s in enumerate(sizes) for i in np.flatnonzero(n == s) if need[k] >= 0 and left[i] >= need[k]]
    assert parts([*zip(a, b), *stars]) == want


@pytest.mark.parametrize("bucket", [1, 3])
def test_a_token_that_all_have(spark, bucket):
    """One hot shingle in every document: buckets that are not gathered give the same classes."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        body = " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(5, 40)))
        rows.append((i, "all have these words " + body, "en", "s", 0))
        if i % 3 == 0:
            rows.append((100 + i, "all have these words " + body + " more", "en", "s", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_classes(H.frame(spark, rows), k=3, threshold="9/10", bucket=bucket).collect()}
    assert got == H.classes(rows, 3, 9, 10)
