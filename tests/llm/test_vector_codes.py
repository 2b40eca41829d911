"""Vector codes against plain Python integers."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tropelens.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error double, weight int"


def plainly(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [r for r in rows if r[1] is not None and r[1] and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return Counter(), []
    sizes = Counter(len(r[1]) for r in kept)
    size = min(s for s, n in sizes.items() if n == max(sizes.values()))
    kept = [(i, [max(-vc.LIMIT, min(vc.LIMIT, math.floor(x * scale))) for x in v], label) for i, v, label in kept if len(v) == size]
    w = size // parts
    cut = [(i, [tuple(v[p * w : p * w + w]) for p in range(parts)], label) for i, v, label in kept]
    raw = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, [np.array(p, dtype="<i4").tobytes() for p in r[1]]))
    books = [[r[1][p] for r in raw[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for r in cut:
                groups[best(r[1][p], books[p])[1]].append(r[1][p])
            books[p] = [tuple(sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)) if k in groups else e for k, e in enumerate(books[p])]
    coded, errors = [], Counter()
    for i, ps, label in cut:
        found = [best(ps[p], books[p]) for p in range(parts)]
        coded.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        errors[label] += coded[-1][3]
    return Counter((*r, errors[r[1]]) for r in coded), books


def fixture():
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(32)], rng.choice([0, 0, 0, 1, None])) for k in range(150)]
    rows += [(200 + k, rows[3][1], 7) for k in range(80)] + [rows[4]] * 3  # a hot vector, repeated rows
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 31 + [None], 1), (303, [0.0] * 31 + [math.nan], 1), (304, [math.inf] + [0.0] * 31, 1)]
    rows += [(305, [0.5] * 16, 1), (306, [0.5] * 20, 1), (None, [-0.0] * 32, None), (None, [1e9, -1e30] * 16, 3), (307, [-1e-9] * 32, 2), (4, [0.25] * 32, 2)]
    return rows


@pytest.mark.parametrize("options", [{}, {"entries": 8, "rounds": 3}, {"parts": 4, "entries": 200}, {"broadcast_bytes": 2000}, {"scale": 1}])
def test_codes_against_plain_integers(spark, options):
    rows = fixture()
    table = spark.createDataFrame([(*r, "x", 1.0, 1) for r in rows], SCHEMA).repartition(5)
    got, books = vc.vector_codes(table, **options)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    want, want_books = plainly(rows, **{k: v for k, v in options.items() if k != "broadcast_bytes"})
    assert Counter(map(tuple, got.collect())) == want
    assert books.tolist() == [[list(e) for e in book] for book in want_books]


def test_few_and_no_vectors(spark):
    for rows in ([], [(1, None, 0)], [(1, [0.1] * 16, None), (2, [0.2] * 16, None)]):
        got, _ = vc.vector_codes(spark.createDataFrame([(*r, "x", 1.0, 1) for r in rows], SCHEMA))
        assert Counter(map(tuple, got.collect())) == plainly(rows)[0]


def test_heavy_keys_stay_out_of_the_shuffle_join(spark):
    left = spark.range(1000).selectExpr("id", "if(id < 600, null, id) as k")
    right = left.groupBy("k").count().withColumnRenamed("count", "weight").withColumn("n", vc.F.lit(1))
    got = vc.joined_back(left, right, ["k"], 1000, 1, 5)
    assert got.count() == 1000 and got.where("weight = 600").count() == 600 and got.columns == ["id", "k", "weight", "n"]


def test_ties_go_to_the_lower_entry():
    values = np.array([[0, 0], [5, 5]])
    book = np.array([[1, 0], [0, 1], [5, 6], [6, 5]])
    for scale in (1, 1 << 21):
        at, d = vc.nearest(values * scale, book * scale)
        assert at.tolist() == [0, 2] and d.tolist() == [scale * scale] * 2
