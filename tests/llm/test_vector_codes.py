import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Python integers, row by row."""
    kept = []
    for i, e, label in rows:
        if e is not None and all(c is not None and math.isfinite(c) for c in e):
            kept.append((i, tuple(math.floor(float(np.float32(c)) * scale) for c in e), label))
    if not kept:
        return []
    step = len(kept[0][1]) // parts
    cut = lambda x, p: x[p * step : (p + 1) * step]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x, p) for _, x, _ in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, x, _ in kept:
                own.setdefault(nearest(cut(x, p), books[p])[1], []).append(cut(x, p))
            for k, xs in own.items():
                books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, total = [], {}
    for i, x, label in kept:
        near = [nearest(cut(x, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in near)
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in near), error, label))
    return sorted(((i, code, error, total[label], digest) for i, code, error, label in out), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def some():
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.choice([None, 0, 1, 2])) for i in range(400)]
    rows += [(400 + i, rows[7][1], 1) for i in range(60)]  # a common vector
    rows += [(500, None, 1), (501, [None] * 8, 1), (502, [float("nan")] + [0.0] * 7, 0), (503, [float("inf")] + [0.0] * 7, 0), (504, [-0.0] * 8, None)]
    rows += [rows[5], rows[5], (5, [0.5] * 8, 1), (None, [0.25] * 8, 2), (None, [0.25] * 8, None)]
    rng.shuffle(rows)
    return rows


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark, some):
    df = vectors(spark, some).withColumns({n: F.lit("clash") for n in ("x", "code", "_label", "part")})
    assert as_rows(V.compressed(df)) == brute(some)
    assert as_rows(V.compressed(df, parts=2, entries=7, rounds=3)) == brute(some, 2, 7, 3)


def test_sql_agrees(spark, some):
    rows = [r for r in some if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(V.SQL).fetchall(), key=str) == brute(rows)


def test_few_and_no_rows(spark):
    few = [(3, [1.0, 2.0, 3.0, 4.0], None), (1, [1.0, 2.0, 3.0, 4.0], 1)]
    assert as_rows(V.compressed(vectors(spark, few))) == brute(few)
    assert V.compressed(vectors(spark, [])).collect() == []
    assert V.compressed(vectors(spark, [(1, None, 1)])).collect() == []


def test_unequal_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        V.compressed(vectors(spark, [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)]))
    with pytest.raises(ValueError):
        V.compressed(vectors(spark, [(1, [1.0] * 6, 0)]))


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (3, 10_000, (1 << 26) - 1, (1 << 29) - 1):
        x, y = (rng.integers(-top, top + 1, (n, 16)) for n in (50, 30))
        x[0], y[0] = -top, top
        want = [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in y] for r in x]
        assert V.dots(x, y).tolist() == want
        for bits in (5, 24):
            assert (sum(v.astype(np.int64) << (bits * k) for k, v in enumerate(V.limbs(x, bits))) == x).all()
    code, error = V.nearest(np.array([[0, 0], [4, 4]]), np.array([[1, 1], [-1, -1], [1, 1], [3, 5]]))
    assert code.tolist() == [0, 3] and error.tolist() == [2, 2]
    with pytest.raises(OverflowError):
        V.nearest(np.array([[1 << 40] * 4]), np.array([[0] * 4]))
