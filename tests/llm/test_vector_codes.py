"""Vector codes against whole-number arithmetic in plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from cellgrid.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, _id string, code string, error string, _sum int"


def plain(rows, parts, entries, rounds, scale):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = lambda v: [math.floor(Fraction(x) * scale) for x in v] + [0] * (parts * width - len(v))
    cut = lambda v: [tuple(whole(v)[p * width:(p + 1) * width]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

    def assign(v):
        out = []
        for p, part in enumerate(cut(v)):
            far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p, (e, _) in enumerate(assign(v)):
                held[p, e].append(cut(v)[p])
        for (p, e), vs in held.items():
            books[p][e] = tuple(sum(c) // len(vs) for c in zip(*vs))
    final = [(i, "".join(f"{e:02x}" for e, _ in assign(v)), sum(f for _, f in assign(v)), label) for i, v, label in kept]
    final = [(i, c, e if e < 1 << 63 else None, label) for i, c, e, label in final]
    by = Counter()
    for _, _, e, label in final:
        by[label] += e or 0
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, c, e, by[label], digest) for i, c, e, label in final)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z", 1) for i, v, label in rows], SCHEMA).repartition(3)


def odd_vectors():
    rng = random.Random(5)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(0, 0.3)) for _ in range(8)], rng.choice([0, 1, None])) for i in range(120)]
    rows += [(200, None, 1), (201, [0.5] * 7 + [None], 1), (202, [float("nan")] + [0.0] * 7, 0), (203, [float("-inf")] * 8, 0)]
    rows += [(7, rows[7][1], 2), (7, rows[7][1], 2), (None, [0.25] * 8, None), (204, [0.125, -0.125], 1), (205, [], 3)]
    return rows


@pytest.mark.parametrize("parts, entries, rounds", [(4, 6, 2), (3, 200, 1), (16, 4, 0)])
def test_codes_equal_plain_arithmetic(spark, parts, entries, rounds):
    rows = odd_vectors()
    got = vc.compress(table(spark, rows), parts=parts, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, parts, entries, rounds, 256)


def test_components_beyond_the_limbs(spark):
    f32 = lambda x: float(np.float32(x))
    rows = odd_vectors() + [(300, [f32(3e5)] * 8, 1), (301, [f32(-7e9), f32(1e18)] + [0.0] * 6, 1), (302, [f32(3e38)] * 8, 5)]
    got = vc.compress(table(spark, rows), parts=4, entries=130)
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, 4, 130, 2, 256)


def test_exact_dot_needs_limbs():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(1 << 29), 1 << 29, (40, 6)) for _ in range(2))
    assert (vc.exact_dot(a, b) == np.array([[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a])).all()
    assert max(abs((a.astype(float) @ b.T.astype(float)) - vc.exact_dot(a, b)).ravel()) > 0  # plain floats are not enough


def test_no_usable_vector(spark):
    assert vc.compress(table(spark, [])).count() == 0
    assert vc.compress(table(spark, [(1, None, 1), (2, [float("nan")], 1)])).count() == 0


def test_decode_gives_the_entries(spark):
    rows = odd_vectors()
    df = table(spark, rows)
    books = vc.train(df, parts=4, entries=200, rounds=0)
    back = vc.decode(vc.encode(df, books), books)
    exact = {tuple(math.floor(x * 256) / 256 for x in v) for i, v, _ in rows if v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)}
    assert {tuple(r.vector) for r in back.where("error = 0").collect()} >= exact
