"""Byte-level BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be bridged by a merge, so a cut between its bytes is
certain. Every pre-token is split at such pairs; the fragments are encoded independently and their ids concatenated,
which equals encoding the pre-token whole: merges left and right of a certain cut neither join nor affect each other.

Fragments and pre-tokens are looked up in bounded caches; what is missing goes to the tokenizer's bare merge model.
One Arrow pass, no shuffle: each task holds one batch of texts.

Defined cases: null and empty texts give no ids and decode to the empty text; a null doc_id is kept; repeated rows are
each returned; a table without rows gives no rows; columns of clashing names are ignored (only doc_id and text are read).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Character classes of the Latin-1 range, where they cannot differ between Unicode versions.
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼½¾", r"\x09-\x0d\x20\x85\xa0"
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cache(dict):
    """Computed values of short keys; emptied when it holds `keep`."""

    def __init__(self, compute, keep: int):
        super().__init__()
        self.compute, self.keep = compute, keep

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) < 64:
            if len(self) >= self.keep:
                self.clear()
            self[key] = value
        return value


class ForcedBoundaryBPE:
    def __init__(self, path: str, keep: int = 250_000):
        spec = json.load(open(path, encoding="utf-8"))
        stand_in = byte_alphabet()
        raw = {token: bytes(stand_in[c] for c in token) for token in spec["model"]["vocab"]}
        self.id_bytes = {str(i): raw[t] for t, i in spec["model"]["vocab"].items()}
        self.stand_ins = {b: c for c, b in stand_in.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_bytes |= {str(i): t.encode() for t, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: joined[a, b]: some token has byte a followed by byte b; elsewhere a cut is certain.
        self.joined = np.zeros((256, 256), bool)
        for token in raw.values():
            b = np.frombuffer(token, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        whole = Tokenizer.from_file(path)
        self.pre, self.model = whole.pre_tokenizer, whole.model
        self._joined = self.joined.tobytes()
        self._decimal = {i: str(i) for i in [*spec["model"]["vocab"].values(), *self.special.values()]}
        self.pre_tokens = Cache(self._pre_token, keep)
        self.fragments = Cache(self._fragment, keep)

    @staticmethod
    @functools.cache
    def of(path: str) -> ForcedBoundaryBPE:
        return ForcedBoundaryBPE(path)

    # ------------------------------------------------------------ encoding

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the tokenizer's merges on these bytes alone, without its pre-tokenizer."""
        return [t.id for t in self.model.tokenize(fragment.decode("latin-1").translate(self.stand_ins))]

    def split(self, data: bytes) -> list[bytes]:
        """Fragments between certain cuts."""
        joined, out, at = self._joined, [], 0
        for i in range(1, len(data)):
            if not joined[data[i - 1] << 8 | data[i]]:
                out.append(data[at:i])
                at = i
        out.append(data[at:])
        return out

    def _fragment(self, fragment: bytes) -> str:
        return ",".join([self._decimal[i] for i in self.merge(fragment)])

    def _pre_token(self, word: str) -> str:
        parts = self.split(word.encode())
        return self._fragment(parts[0]) if len(parts) == 1 else ",".join(map(self.fragments.__getitem__, parts))

    def _ordinary(self, text: str) -> str:
        try:
            text.encode("latin-1")
            words = _PRE.findall(text)
        except UnicodeEncodeError:
            words = [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return ",".join(map(self.pre_tokens.__getitem__, words))

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        return ",".join([str(self.special[p]) if p in self.special else self._ordinary(p) for p in self.special_split.split(text) if p])

    # ------------------------------------------------------------ decoding

    def decode(self, ids: str) -> str:
        """Text of decimal ids joined by commas; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.id_bytes.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def bpe_encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE.of(tokenizer)
        for batch in batches:
            ids = [[int(i) for i in s.split(",")] if (s := bpe.encode(t.as_py() or "")) else [] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of rows with an `ids` array; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE.of(tokenizer)
        for batch in batches:
            texts = [bpe.decode(",".join(map(str, x.as_py() or []))) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode then decode in one pass; digests of both (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE.of(tokenizer)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [])
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                rows[0].append(ids.count(",") + 1 if ids else 0)
                rows[1].append(sha(ids))
                rows[2].append(sha(bpe.decode(ids)))
            yield pa.record_batch([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
