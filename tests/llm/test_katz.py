import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_support import docs_of
from siftwork.llm import katz


def tokens_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def grams(tokens, n):
    """(history, word) for each token with n - 1 words or the beginning before it."""
    t = ["<s>", *tokens]
    return [(tuple(t[k - n + 1 : k]), t[k]) for k in range(max(n - 1, 1), len(t))]


def brute(rows, order=3):
    train = [tokens_of(t) for i, t in rows if not is_held(i)]
    one = Counter(w for t in train for w in t)
    many = {n: Counter(g for t in train for g in grams(t, n)) for n in range(2, order + 1)}
    tokens, distinct = sum(one.values()), len(one)
    counts = lambda c: [0] + [sum(v == r for v in c.values()) for r in range(1, 7)]
    d1, d = katz.Discount.of(counts(one)), {n: katz.Discount.of(counts(c)) for n, c in many.items()}
    factor = lambda d, c: d.factors[c - 1] if c <= len(d.factors) else 1.0
    freed = sum(c * (1 - factor(d1, c)) for c in one.values()) / tokens if tokens else 1.0
    scale, unknown = (1.0, freed) if freed > 0 else (tokens / (tokens + 1), 1 / (tokens + 1))
    weights = {}

    def p(h, w):
        if not h:
            return factor(d1, one[w]) * one[w] * scale / tokens if one[w] else unknown
        if h not in weights:
            return p(h[1:], w)
        weight, total = weights[h]
        c = many[len(h) + 1][h, w]
        return factor(d[len(h) + 1], c) * c / total if c else weight * p(h[1:], w)

    for n in range(2, order + 1):
        after = {}
        for (h, w), c in many[n].items():
            after.setdefault(h, {})[w] = c
        for h, seen in after.items():
            total = sum(seen.values())
            give = sum(c * (1 - factor(d[n], c)) for c in seen.values()) / total
            rest = 1 - sum(p(h[1:], w) for w in seen)
            weights[h] = (give / rest, total) if give > 0 else (1 / (total + 1) / rest, total + 1)
        for h in list(after)[:20]:
            assert sum(p(h, w) for w in [*one, "never seen"]) == pytest.approx(1)
    out = []
    for i, text in rows:
        t = tokens_of(text)
        base = sum(math.log10((one[w] + 1) / (tokens + distinct + 1)) for w in t)
        with_begin = ["<s>", *t]
        score = sum(math.log10(p(tuple(with_begin[max(0, k - order + 1) : k]), with_begin[k])) for k in range(1, len(with_begin)))
        out.append((i, is_held(i), len(t), sum(one[w] > 0 for w in t), tokens, base, score))
    return out


def same(df, rows, order=3):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, df.collect()), key=key), sorted(brute(rows, order), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def corpus(n=150, seed=6):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    weight = [1 / (k + 1) for k in range(200)]
    return [(k, " ".join(["The"] * (k % 3) + rng.choices(words, weight, k=rng.randint(0, 60)))) for k in range(n)]


ODD = [(200, None), (201, ""), (202, " \n"), (None, "w1 w2 É"), (203, "w1 " * 30_000), (204, "w1 w2"), (204, "w1 w2"), (205, "only here " * 3)]


def test_equals_brute_force(spark):
    rows = corpus() + ODD
    docs = docs_of(spark, rows)
    for name in ("chunk", "payload", "part", "held_out", "tokens"):
        docs = docs.withColumn(name, F.lit("c"))
    same(katz.scored(docs), rows)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_many_chunks_and_parts(spark, order):
    rows = corpus(seed=9) + ODD
    same(katz.scored(docs_of(spark, rows).repartition(5), chunk_tokens=400, part_tokens=900, order=order), rows, order)


def test_hot_history_over_many_chunks(spark):
    rng = random.Random(4)
    rows = corpus(40, seed=2) + [(1000 + k, " ".join(f"the same {rng.choice('abcdefgh')}{rng.randint(0, 30)}" for _ in range(30))) for k in range(60)]
    same(katz.scored(docs_of(spark, rows).repartition(4), chunk_tokens=300, part_tokens=700, order=4), rows, 4)


def test_settings_are_put_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    katz.scored(docs_of(spark, [(1, "a b c")]))
    assert spark.conf.get(key, None) == before
    with pytest.raises(ValueError):
        katz.scored(docs_of(spark, [(1, "a")]), order=1)


def test_small_inputs(spark):
    assert katz.scored(docs_of(spark, [])).collect() == []
    held = next(i for i in range(100) if is_held(i))
    (row,) = katz.scored(docs_of(spark, [(held, "a b")])).collect()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)
    # All counts alike and large: no discount can be estimated.
    rows = [(i, "a b " * 50) for i in range(30)]
    same(katz.scored(docs_of(spark, rows)), rows)


def test_arrays_survive_packing():
    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.int64), np.array([1.5, -2.0]), np.array([7], np.uint8)]
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, katz.unpack(katz.pack(*arrays))))
