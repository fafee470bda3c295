"""Vector codes against plain whole-number arithmetic."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from eventspark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string"


def plain_codes(rows, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(order[0][1])
    cut = lambda v: [[math.floor(1024 * x) for x in v[size * p // 4 : size * (p + 1) // 4]] for p in range(4)]
    books = list(zip(*[cut(r[1]) for r in order[:256] if len(r[1]) == size], strict=True))
    books = [[list(e) for e in part] for part in books]
    points = [(r, cut(r[1])) for r in kept if len(r[1]) == size]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    find = lambda part, book: min((away(part, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        near = [[find(part, book)[1] for part, book in zip(ps, books, strict=True)] for _, ps in points]
        for p, book in enumerate(books):
            held = defaultdict(list)
            for (_, ps), codes in zip(points, near, strict=True):
                held[codes[p]].append(ps[p])
            for e, those in held.items():
                book[e] = [sum(c) // len(those) for c in zip(*those, strict=True)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for r, ps in points:
        found = [find(part, book) for part, book in zip(ps, books, strict=True)]
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
        sums[r[2]] += out[-1][3]
    rest = [(r[0], r[2], None, None) for r in kept if len(r[1]) != size]
    return [(v, c, e, sums[of] if of in sums else None, sha, of) for v, of, c, e in [*out, *rest]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def check(spark, rows):
    got = vc.product_codes(frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256", "label"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_codes(rows)))


def vectors(seed, n, size):
    r = random.Random(seed)
    centre = [[r.uniform(-1, 1) for _ in range(size)] for _ in range(9)]
    return [
        (r.randint(0, 3 * n), [float(np.float32(v + r.gauss(0, 0.2))) for v in r.choice(centre)], r.choice([None, 1, 2, 3]))
        for _ in range(n)
    ]


@pytest.mark.parametrize(("n", "size"), [(700, 16), (40, 8), (300, 7)])
def test_codes(spark, n, size):
    rows = vectors(n, n, size)
    check(spark, rows)


def test_ties_repeats_nulls_and_odd_rows(spark):
    grid = [(i, [float(i % 3) / 1024, float(i % 2) / 1024, 0.0, -0.0003], i % 2) for i in range(300)]
    odd = [
        (None, [0.5, 0.5, 0.5, 0.5], None),
        (3, None, 1),
        (4, [1.0, None, 1.0, 1.0], 1),
        (5, [1.0, float("nan"), 1.0, 1.0], 1),
        (6, [1.0, float("inf"), 1.0, 1.0], 1),
        (400, [1.0, 2.0, 3.0], 7),
        (401, [], 1),
        (7, [9.0, -9.0, 9.0, -9.0], 2),
    ]
    check(spark, grid + odd + odd[-1:] * 3 + odd[:1])


def test_empty_and_unusable(spark):
    for rows in ([], [(1, None, 1)], [(1, [float("nan")], 1)]):
        assert vc.product_codes(frame(spark, rows)).collect() == []
    check(spark, [(1, [], 1), (2, [], 2)])
    with pytest.raises(Exception, match="too large"):
        vc.product_codes(frame(spark, [(1, [1e30] * 4, 1)])).collect()


def test_many_labels_are_salted(spark, monkeypatch):
    monkeypatch.setattr(vc, "BROADCAST", 0)
    check(spark, vectors(5, 120, 8))


def test_pivots_spare_most_distances_and_lose_none():
    r = np.random.default_rng(4)
    centre = r.integers(-900, 900, (60, 8))
    x = centre[r.integers(0, 60, 3000)] + r.integers(-30, 30, (3000, 8))
    entries = x[:256].copy()
    entries[40] = entries[200]
    pivots = vc.pivots_of(entries, 12)
    index, least, tried = vc.nearest(x, vc._distances(x, pivots).astype(np.float32), entries, pivots)
    every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert tried < 0.1 * every.size
    assert 200 not in index


def test_query_equals_plain_arithmetic(spark):
    from eventspark.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = QUERIES["op13_pivot_codes"](spark, d).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(r[:5] for r in plain_codes(rows))
