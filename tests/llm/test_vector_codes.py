import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector int, codes int, error string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def vectors(n=150, dim=8, seed=1):
    rng = random.Random(seed)
    return [(i * 2 + 1, [rng.choice([-0.5, 0.25, rng.gauss(0, 0.2)]) for _ in range(dim)], rng.choice([0, 1, None])) for i in range(n)]


def brute(rows, parts, entries, rounds):
    """{(id, code, error, label error)}, all components of the codebooks."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) % parts == 0]
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if order and len(r[1]) == len(order[0][1])]
    order = [r for r in order if len(r[1]) == len(order[0][1])]
    ints = lambda v: [max(-(2**20), min(2**20, math.floor(256 * float(np.float32(x))))) for x in v]
    width = len(order[0][1]) // parts if order else 1
    cut = lambda v, p: ints(v)[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    near = lambda x, p: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for r in good:
                got.setdefault(near(cut(r[1], p), p)[1], []).append(cut(r[1], p))
            books[p] = [[sum(c) // len(got[k]) for c in zip(*got[k])] if k in got else e for k, e in enumerate(books[p])]
    coded = [(r, [near(cut(r[1], p), p) for p in range(parts)]) for r in good]
    sums = {}
    for r, found in coded:
        sums[r[2]] = sums.get(r[2], 0) + sum(d for d, _ in found)
    flat = [c for book in books for e in book for c in e]
    return sorted(((r[0] is None, r[0] or 0, bytes(k for _, k in found).hex(), sum(d for d, _ in found), sums[r[2]]) for r, found in coded)), flat


def coded(spark, rows, parts, entries, rounds):
    books = V.fit(frame(spark, rows).repartition(3), parts, entries, rounds)
    got = V.label_errors(V.encode(frame(spark, rows), books)).withColumn("code", V.hex_code()).collect()
    return sorted((r.id is None, r.id or 0, r.code, r.error, r.label_error) for r in got), books.entries.ravel().tolist()


@pytest.mark.parametrize("parts,entries,rounds", [(4, 16, 2), (2, 64, 1), (8, 40, 3), (4, 200, 0)])
def test_brute_force(spark, parts, entries, rounds):
    rows = vectors()
    assert coded(spark, rows, parts, entries, rounds) == brute(rows, parts, entries, rounds)


def test_unusable_repeated_and_extreme_vectors(spark):
    rows = vectors(30) + [
        (None, [0.1] * 8, 1),
        (None, None, 1),
        (2, None, 1),
        (4, [], 1),
        (6, [0.1, None] * 4, 1),
        (8, [float("nan")] * 8, 1),
        (10, [float("inf")] + [0.0] * 7, 1),
        (12, [0.5] * 4, 1),
        (14, [0.5] * 7, 1),
        (1, [0.25] * 8, None),
        (1, [-0.25] * 8, None),
        (1, [-0.25] * 8, None),
        (500, [3e38] * 4 + [-3e38] * 4, 0),
    ]
    assert coded(spark, rows, 4, 16, 2) == brute(rows, 4, 16, 2)


def test_first_of_other_length(spark):
    rows = [(0, [0.1] * 7, 1), (1, [0.5] * 4, 1), (2, [0.2] * 8, 1), (3, [0.7] * 4, None)]
    found = coded(spark, rows, 4, 16, 2)
    assert found == brute(rows, 4, 16, 2) and len(found[0]) == 2


@pytest.mark.parametrize("rows", [[], [(1, None, 1)]])
def test_nothing_to_code(spark, rows):
    books = V.fit(frame(spark, rows))
    assert V.label_errors(V.encode(frame(spark, rows), books)).count() == 0
    assert books.digest() == hashlib.sha256(b"").hexdigest()


def test_partial_distances_are_exact():
    rng = np.random.default_rng(3)
    for width in (1, 3, 4, 9):
        entries = rng.integers(-40, 40, (64, width)) * rng.integers(1, 30, width)
        entries[10] = entries[3]  # ties
        x = np.concatenate([rng.integers(-900, 900, (500, width)), entries])
        which, far = V.Codebook(entries).nearest(x)
        every = np.square(x[:, None] - entries[None]).sum(axis=2)
        assert (which == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def test_decoded_vectors_are_near(spark):
    rows = vectors(200)
    df = frame(spark, rows)
    books = V.fit(df, 4, 64, 4)
    back = {r.id: r.vector for r in V.decode(V.encode(df, books), books).collect()}
    of = {i: np.float32(v) for i, v, _ in rows}
    rest = sum(np.square(np.array(back[i]) - of[i]).sum() for i in back)
    assert rest < 0.2 * sum(np.square(v - np.mean(list(of.values()), axis=0)).sum() for v in of.values())
