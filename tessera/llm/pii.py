"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) are always reported when they pass their own check. Further kinds: `iban` (mod-97),
`national` (ddd-dd-dddd), `birth` (dates) and `account` (runs of 6 to 18 digits); these are reported when pattern score
plus context adjustment reaches `threshold`. Every span has a score, so callers may filter the base kinds as well.

One Arrow pass, no shuffle; patterns are linear in the text (possessive, anchored at run starts). An IBAN has the length of its
country, in groups however spaced, so words that follow it in capitals are not taken for its end.

Defined cases: null and empty texts have no spans; a null doc_id is kept; repeated rows are each returned; a table
without rows gives no rows; only doc_id and text are read; texts are taken whole, however long (slices of some 1 MB of texts
are worked on at a time, a longer text alone), and so are their runs of digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import text_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national", "birth", "account")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CAPITALS_DIGITS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_BIRTH = re.compile(r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][01]?[0-9][./](?:19|20)[0-9]{2})(?![0-9./-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{6,18}(?![0-9A-Za-z.-])")

#: Lengths of IBANs by country (fixed values of the public registry).
IBAN_LENGTHS = {
    **{"AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28},
    **{"CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18},
    **{"GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32},
    **{"LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15},
    **{"PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25},
    **{"SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20},
}

#: Words that make a kind likelier, or tell that digits nearby mean something else (fixed values).
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "national": ("ssn", "social", "security", "tax", "id"),
    "birth": ("born", "birth", "dob", "geboren", "naissance", "nacimiento"),
    "account": ("account", "acct", "customer", "konto", "compte", "cuenta", "passport"),
}
AGAINST = ("example", "sample", "test", "version", "isbn", "page", "chapter")
_NEAR = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without spaces, 15 to 34 characters."""
    if not 15 <= len(iban) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the whole local run before an @, back to the last match, if a domain follows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From every head on, as many capitals and digits as the country has, single spaces between them allowed."""
    done = 0
    for head in _IBAN.finditer(text):
        left, at = IBAN_LENGTHS.get(head[0][:2], 0) - 4, head.end()
        if left < 0 or head.start() < done:
            continue
        while left and at < len(text):
            if text[at] == " " and text[at - 1] != " ":
                at += 1
                continue
            if text[at] not in _CAPITALS_DIGITS:
                break
            at, left = at + 1, left - 1
        if not left and not (at < len(text) and text[at].isascii() and text[at].isalnum()) and mod97(text[head.start() : at].replace(" ", "")):
            yield head.start(), at
            done = at


def _matches(pattern: re.Pattern, ok: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: ((m.start(), m.end()) for m in pattern.finditer(text) if ok(m[0]))


#: kind -> (cheap necessary condition, proposer with its validator, score before context)
_PROPOSE: dict[str, tuple[Callable[[str], bool], Callable[[str], Iterator[tuple[int, int]]], float]] = {
    "email": (lambda t: "@" in t, _emails, 0.9),
    "ip": (lambda t: True, _matches(_IP, lambda s: all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in s.split("."))), 0.6),
    "card": (lambda t: True, _matches(_CARD, lambda s: 12 <= len(d := _digits(s)) <= 19 and luhn(d)), 0.7),
    "phone": (lambda t: "+" in t, _matches(_PHONE, lambda s: 9 <= len(_digits(s)) <= 15), 0.7),
    "iban": (lambda t: True, _ibans, 0.9),
    "national": (lambda t: "-" in t, _matches(_NATIONAL, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"), 0.5),
    "birth": (lambda t: True, _matches(_BIRTH, lambda s: True), 0.2),
    "account": (lambda t: True, _matches(_ACCOUNT, lambda s: True), 0.2),
}
_DIGIT = re.compile(r"[0-9]")


def _uncovered(spans: list[Span]) -> list[Span]:
    """Without the bare numbers (account) that a more telling span overlaps; one sweep by start."""
    kept: list[Span] = []
    others = sorted((s for s in spans if s.kind != "account"), key=lambda s: s.start)
    at, reach = 0, 0
    for s in sorted((s for s in spans if s.kind == "account"), key=lambda s: s.start):
        while at < len(others) and others[at].start < s.end:  # all that start before its end; account spans do not overlap
            reach = max(reach, others[at].end)
            at += 1
        if reach <= s.start:
            kept.append(s)
    return [s for s in spans if s.kind != "account"] + kept


def find_pii(text: str, threshold: float = 0.6, reach: int = 40) -> list[Span]:
    """All spans by start, then kind; code points, end exclusive. Context is `reach` characters on either side."""
    out: list[Span] = []
    digits = bool(_DIGIT.search(text))
    for kind, (possible, propose, prior) in _PROPOSE.items():
        if not possible(text) or (kind != "email" and not digits):
            continue
        for start, end in propose(text):
            near = {w.lower() for w in _NEAR.findall(text[max(0, start - reach) : start])} | {w.lower() for w in _NEAR.findall(text[end : end + reach])}
            score = prior + 0.4 * any(w in near for w in CONTEXT[kind]) - 0.2 * any(w in near for w in AGAINST)
            if kind in BASE or score >= threshold:
                out.append(Span(kind, start, end, round(min(1.0, max(0.0, score)), 2)))
    out = _uncovered(out)
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def pii_spans(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(doc_id, spans) of every whole text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                spans = [[s._asdict() for s in find_pii(t.as_py() or "", threshold)] for t in batch.column(1)]
                yield pa.record_batch([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")
