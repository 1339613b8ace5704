import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=4):
    kept = [(i, [math.floor(float(np.float32(c)) * 256) for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, float) - np.array(total) / n
    value, vector = np.linalg.eigh(a.T @ a / n)
    value, vector = value[::-1], vector[:, ::-1]
    out = {}
    for i, x in kept:
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, total))
        z = (np.array(x) - np.array(total) / n) @ vector[:, :k] / np.sqrt(value[:k])
        out.setdefault(i, []).append((n, deviation, z, value[:k] / value.sum()))
    return out


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6)) * [3, 2.2, 1.5, 1, 0.5, 0.2] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]
    rows += [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [float("-inf")] + [0.0] * 5), rows[9], rows[9], (None, rows[2][1])]
    random.Random(1).shuffle(rows)
    return rows


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


@pytest.mark.parametrize("blocks", [(4096, 1024), (64, 4)])
def test_equals_brute_force(spark, some, blocks):
    df = vectors(spark, some).withColumns({n: F.lit("clash") for n in ("x", "at", "values", "block", "n")})
    got = {}
    for r in W.whitened(df, rows=blocks[0], cols=blocks[1]).collect():
        assert r.identity_error <= 1e-9
        got.setdefault((r.vec_id, r.component), []).append(r)
    want = brute(some)
    assert len(got) == 4 * len(want)
    signs = [np.sign(got[0, c][0].whitened) * np.sign(want[0][0][2][c - 1]) for c in range(1, 5)]
    for (i, c), rows in got.items():
        assert len(rows) == len(want[i])
        for r, (n, deviation, z, explained) in zip(rows, want[i]):
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened == pytest.approx(signs[c - 1] * z[c - 1], abs=1e-9) and r.explained == pytest.approx(explained[c - 1], rel=1e-9)


def test_scatter_over_many_tasks(spark, some):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(333, 5))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "at long, v array<double>")
    m = W.block_matrix(W.blocked(rows, "v", np.zeros(5), 10), 333, 5, 10, 2)
    assert np.allclose(W.scatter(m, task_blocks=3), x.T @ x)
    by = rng.normal(size=(5, 3))
    got = {r.at: r["values"] for r in W.projected(m, by, spark).collect()}
    assert np.allclose([got[i] for i in range(333)], x @ by)


def test_numbers_have_no_gaps(spark, some):
    from siftwork.llm.common import Scratch

    df, n = W.numbered(spark.range(0, 1001, 1, 7).repartition(5).select("id"), Scratch(spark, "t"))
    assert n == 1001 and sorted(r["at"] for r in df.collect()) == list(range(1001))


def test_little_variance_and_no_rows(spark):
    got = W.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in got)
    got = W.whitened(vectors(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])])).collect()
    assert len(got) == 6
    assert [(r.vec_id, abs(r.whitened)) for r in sorted(got) if r.component == 1] == [(1, pytest.approx(1)), (2, pytest.approx(1))]
    assert all(r.whitened is None and r.explained == 0 for r in got if r.component > 1) and max(r.identity_error for r in got) < 1e-9
    assert W.whitened(vectors(spark, [])).collect() == [] and W.whitened(vectors(spark, [(1, None)])).collect() == []
    with pytest.raises(ValueError):
        W.whitened(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_deviations_beyond_64_bits():
    assert W.deviations(np.array([[5, 0], [0, 0]]), 3, [9, 0]) == [36, 81]
    assert W.deviations(np.array([[1 << 31, 0], [3, 0]]), 4, [12, 0]) == [None, 0]
