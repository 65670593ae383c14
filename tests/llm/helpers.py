"""Small fixtures and plain re-statements of the contracts."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(n=120, seed=3):
    """Invented prose with exact copies, near copies, shared passages, secrets and junk."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["la", "ne", "ti", "or", "us", "ém", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    out = []
    for i in range(n):
        kind = i % 8
        text = [rng.choice(words) for _ in range(rng.randint(5, 160))]
        if kind == 1 and out:
            text = WORD.findall(rng.choice(out)[1] or "x")
        if kind == 2 and out:
            text = WORD.findall(rng.choice(out)[1] or "x y")
            text[rng.randrange(len(text))] = "changed"
        if kind == 3:
            text[len(text) // 2 : len(text) // 2] = passage
        if kind == 4:
            text.append("password=hunter2222")
        if kind == 5:
            text = text[:8] * 12
        if kind == 6:
            text = [rng.choice(words)] * 40 + text
        out.append((i, "".join(w + rng.choice([" ", " ", " ", "\n", "\t"]) for w in text), rng.choice(["en", "de"]), "src", 0))
    return out


ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \t\n ", None, None, None),
    (None, "no id but some words in a text that is long enough for a window of words here", "en", "s", 1),
    (4, "one", "de", "s", 3),
    (5, "same words again " * 30, "en", "s", 3),
    (5, "same words again " * 30, "en", "s", 3),
    (6, "same words again " * 30, "en", "s", 3),
    (7, "x" * 200_000, "en", "s", 3),
    (8, "word " * 30_000, "en", "s", 3),
    (9, "日本語 テスト 🎉 İ ſ <|endoftext|> Kelvin K", "ja", "s", 3),
    (10, "\x00\x01 control \x1c\x1d sep", "en", "s", 3),
]
#: Names that operators use inside.
CLASHES = ["shard", "unit", "low", "row", "n", "words", "length", "piece", "family", "_key", "_spans", "bucket", "slot", "kept", "held_out", "n_words", "n_removed", "stratum", "media", "spans"]


def odd_frame(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(c) for c in CLASHES})


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def shingles(text, k):
    w = WORD.findall(fold(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, k, num, den):
    """doc_id -> (set size, class id), all pairs compared."""
    sets = {i: shingles(t, k) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(rows, width=13):
    """[(doc_id, words, mask of removed words)]"""
    first = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        mask = [False] * len(w)
        for j in range(len(w) - width + 1):
            if i is not None and first[tuple(w[j : j + width])] < i:
                mask[j : j + width] = [True] * width
        out.append((i, w, mask))
    return out
