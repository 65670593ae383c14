import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, packing
from tessera.llm.lookup_tokens import LookupEncoder
from tessera.llm import queries as Q
from tessera.llm.queries import vocabulary

from . import helpers as H

WORD_BPE, BYTE_BPE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
TEXTS = st.text(alphabet=st.sampled_from("ab 'sStTdDlLrReE \n\t\xa0éÉßªº12²,.!|<>日🎉́İΣ\x1c"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_word_bpe_lookup_is_exact(text):
    want = Tokenizer.from_file(WORD_BPE) if not hasattr(test_word_bpe_lookup_is_exact, "t") else test_word_bpe_lookup_is_exact.t
    test_word_bpe_lookup_is_exact.t = want
    assert np.frombuffer(LookupEncoder.of(WORD_BPE).ids(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_byte_bpe_is_exact_and_round_trips(text):
    own = bpe.ForcedBoundaryBPE.of(BYTE_BPE)
    ids = own.encode(text)
    lib = Tokenizer.from_file(BYTE_BPE) if not hasattr(test_byte_bpe_is_exact_and_round_trips, "t") else test_byte_bpe_is_exact_and_round_trips.t
    test_byte_bpe_is_exact_and_round_trips.t = lib
    want = lib.encode(text, add_special_tokens=False).ids
    assert ids == ",".join(map(str, want))
    assert own.decode(ids) == lib.decode(want, skip_special_tokens=False) == text


def test_fragments_split_at_impossible_pairs():
    own = bpe.ForcedBoundaryBPE.of(BYTE_BPE)
    pieces = own.split(b"qzxjQ")
    assert b"".join(pieces) == b"qzxjQ"
    for a, b in zip(pieces, pieces[1:]):
        assert not own.joined[a[-1], b[0]]


def test_special_tokens():
    own, lib = bpe.ForcedBoundaryBPE.of(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for text in ("<|endoftext|>", "a<|endoftext|>b", "x <|endoftext|> y<|endoftext"):
        assert own.encode(text) == ",".join(map(str, lib.encode(text, add_special_tokens=False).ids))


def test_round_trip_rows(spark):
    rows = bpe.bpe_round_trip(H.odd_frame(spark), BYTE_BPE).collect()
    assert len(rows) == len(H.ODD)
    assert {r.doc_id: r.n_tokens for r in rows}[1] == 0
    enc = bpe.bpe_encode(H.odd_frame(spark), BYTE_BPE)
    back = {r.doc_id: r.text for r in bpe.bpe_decode(enc, BYTE_BPE).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in H.ODD)
    assert bpe.bpe_round_trip(H.frame(spark, []), BYTE_BPE).count() == 0


def _documents(spark, tmp_path, rows):
    H.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_bpe_query_digests(spark, tmp_path):
    rows = [r for r in H.ODD if r[0] not in (None, 5)] + [(700 + i, *r[1:]) for i, r in enumerate(H.corpus(20))]
    lib = Tokenizer.from_file(BYTE_BPE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op2_bpe(spark, _documents(spark, tmp_path, rows)).collect()}
    want = {}
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_packing_query(spark, tmp_path):
    rows = H.corpus(40) + [(500, "wort " * 5000, "en", "s", 0), (501, None, "en", "s", 0)]
    lib = Tokenizer.from_file(WORD_BPE)
    got = Q.op1_best_fit_packing(spark, _documents(spark, tmp_path, rows)).collect()
    _check(got, {r[0] for r in rows})
    want = {}
    for i, t, *_ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want |= {(i, k // 2048): (k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(1, 20))
def test_best_fit_keeps_its_bounds(lengths, open_bins):
    p = packing.BestFit(50, open_bins)
    used = {}
    for n in lengths:
        at, offset = p.place(n)
        assert offset == used.get(at, 0) and offset + n <= 50
        used[at] = offset + n
        assert p.n_open <= open_bins
        assert all(bool(p.bins[f]) == bool(p.free_bits >> f & 1) for f in range(51))


def test_best_fit_takes_the_tightest_bin():
    p = packing.BestFit(10, 4)
    assert [p.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]


def test_fullest_bin_closes_first():
    p = packing.BestFit(10, 2)
    for n in (5, 8, 6):  # 8 is the fullest when 6 needs a bin
        p.place(n)
    assert p.place(2)[0] == 2  # not the closed bin of 8


def _check(rows, want_docs):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert {r.doc_id for r in rows} == want_docs
    return seqs


def test_packing_contract(spark):
    rows = packing.pack_documents(H.odd_frame(spark), WORD_BPE).collect()
    seqs = _check(rows, {r[0] for r in H.ODD})
    lib = Tokenizer.from_file(WORD_BPE)
    total = 0
    for i, t, *_ in H.ODD:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        if i == 5:
            continue
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        cuts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, 2048 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cuts)]
    assert len(seqs) <= -(-total // 2048) + 1
    assert packing.pack_documents(H.frame(spark, []), WORD_BPE).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_is_near_the_bound(spark, seed):
    rows = packing.pack_documents(H.frame(spark, H.corpus(150, seed)), WORD_BPE).collect()
    seqs = _check(rows, set(range(150)))
    assert len(seqs) <= -(-sum(r.length for r in rows) // 2048) + 1
