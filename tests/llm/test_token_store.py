import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import queries as Q
from tessera.llm import token_store as S
from tessera.llm.queries import vocabulary

from . import helpers as H

WORD_BPE = vocabulary("word_bpe_49k.json")


def want_ids(rows, end=1):
    """(doc_id, ids) by ascending doc_id, nulls first."""
    lib = Tokenizer.from_file(WORD_BPE)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(r[0], [*lib.encode(r[1] or "", add_special_tokens=False).ids, end]) for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300), st.booleans())
def test_perfect_hash_is_minimal(keys, null):
    ids = np.array([*keys, 0] if null else [*keys], np.int64)
    known = np.ones(len(ids), bool)
    known[len(keys) :] = False
    a, b = S._lanes(ids, known)
    seeds = S.perfect_hash(a, b)
    assert sorted(S.hash_slots(a, b, seeds, len(a)).tolist()) == list(range(len(a)))


def test_perfect_hash_of_a_full_bucket():
    ids = np.arange(1 << 14, dtype=np.int64) * 20
    a, b = S._lanes(ids, np.ones(len(ids), bool))
    assert len(np.unique(S.hash_slots(a, b, S.perfect_hash(a, b), len(a)))) == len(ids)


def read(spark, rows, keys=None, **options):
    store = S.write_tokens(H.frame(spark, rows).repartition(3), WORD_BPE)
    asked = keys if keys is not None else H.frame(spark, rows).select("doc_id").distinct()
    return store, sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in S.read_tokens(store, asked, **options).collect())


def check(rows, found):
    want = want_ids(rows)
    assert [f[0] for f in found] == np.cumsum([0] + [len(f[2]) for f in found])[:-1].tolist()
    assert [f[1] for f in found] == [w[0] for w in want]
    group = {}
    for doc, ids in want:
        group.setdefault(doc, []).append(tuple(ids))
    for _, doc, ids in found:
        group[doc].remove(tuple(ids))


def test_round_trip(spark):
    rows = H.corpus(60)
    _, found = read(spark, rows)
    check(rows, found)
    _, found = read(spark, rows, most_ids=1)
    check(rows, found)


def test_odd_rows_and_clashing_columns(spark):
    store = S.write_tokens(H.odd_frame(spark), WORD_BPE)
    found = sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in S.read_tokens(store, H.odd_frame(spark).select("doc_id").distinct()).collect())
    check(H.ODD, found)
    assert len(found) == len(H.ODD)


@pytest.mark.parametrize("hot", [None, 5, -(2**63)])
def test_a_hot_key_fills_many_shards(spark, hot):
    rows = [(hot, f"word {i % 7}", "en", "s", 0) for i in range(300)] + [(i, "other words", "en", "s", 0) for i in range(-3, 9)] + [(None, "none", "en", "s", 0), (-(2**63), "least", "en", "s", 0)]
    store, found = read(spark, rows)
    check(rows, found)
    sizes = [r.docs for r in store.shards.collect()]
    assert hot == -(2**63) or (len(sizes) > 2 and max(sizes) < 200)


def test_unknown_keys_are_told(spark):
    rows = [(i * 3, f"text {i}", "en", "s", 0) for i in range(100)]
    keys = spark.createDataFrame([(i,) for i in range(300)] + [(None,)], "doc_id long")
    _, found = read(spark, rows, keys)
    assert [f[1] for f in found] == [i * 3 for i in range(100)]


def test_empty_table_and_reopening(spark):
    store, found = read(spark, [])
    assert found == [] and store.shards.count() == 0
    store, found = read(spark, H.corpus(20))
    again = S.open_store(spark, store.path)
    keys = spark.createDataFrame([(7,), (3,)], "doc_id long")
    assert [(r.doc_id, r.ids) for r in S.read_tokens(again, keys).orderBy("start").collect()] == [(d, np.array(i, "<u4").tobytes()) for s, d, i in found if d in (3, 7)]


def test_wide_ids(tmp_path):
    out = S.ShardWriter(f"file://{tmp_path}", 3, 4)
    for ids in ([70000, 1], [], [2]):
        out.add(np.array(ids, "<u4").tobytes())
    out.close()
    back = S.ShardReader(f"file://{tmp_path}", out.name)
    assert [back.ids(i, i + 1).tolist() for i in range(3)] == [[70000, 1], [], [2]] and back.ids(0, 3).tolist() == [70000, 1, 2]


def test_query_against_the_library(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    at, want = 0, set()
    for doc, ids in want_ids(rows):
        want.add((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in Q.op12_token_store(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want
