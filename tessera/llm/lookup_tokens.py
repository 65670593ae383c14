"""Word-level id lookup for the lower-casing word BPE: pieces of text repeat, so each distinct one is encoded once.

Defined cases: an empty text has no ids (a null one is the caller's to replace); the text is taken whole however long; a text
with characters beyond Latin-1 or with a special token in it is encoded by the tokenizer itself; equal texts have equal
ids whatever was encoded before, the kept pieces being a bounded cache only."""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from tessera.llm.bpe import byte_alphabet

#: What the tokenizer's own pre-tokenizer keeps, for texts of Latin-1 characters, where this spelling of the classes and
#: str.lower() provably agree with it; other texts are encoded by the tokenizer as a whole.
_LETTER, _NUMBER = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼½¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\x09-\x0d\x20\x85\xa0{_LETTER}{_NUMBER}]+")


class LookupEncoder(dict):
    """piece -> little-endian uint32 ids; missing pieces are encoded by the tokenizer, at most `keep` are kept."""

    def __init__(self, path: str, keep: int = 250_000):
        super().__init__()
        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.stand_ins = {b: c for c, b in byte_alphabet().items()}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    @functools.cache
    def of(path: str) -> LookupEncoder:
        return LookupEncoder(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        merged = self.model.tokenize(piece.encode().decode("latin-1").translate(self.stand_ins))  # the merges alone
        ids = array("I", [t.id for t in merged]).tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _PIECE.findall(text.lower())))
