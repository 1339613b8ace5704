import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm_support import docs_of
from siftwork.llm import mixing


def uses(df):
    return df.select("row.doc_id", "row.source", "tokens", "share", "weight", "exponent", "budget", "pass", "block", "place").collect()


def table(spark, sizes, words=10):
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((n, " ".join(["w"] * words), "en", source))
            n += 1
    return docs_of(spark, rows)


def test_exponent_meets_the_entropy(spark):
    sizes = {"a": 600, "b": 100, "c": 60, "d": 20}
    got = uses(mixing.schedule(table(spark, sizes), entropy=0.8, repeats=None, block_tokens=50))
    weight = {r.source: r.weight for r in got}
    assert -sum(w * math.log(w) for w in weight.values()) == pytest.approx(0.8 * math.log(4), abs=1e-5)
    total = sum(sizes.values())
    power = got[0].exponent
    raw = {s: (n / total) ** power for s, n in sizes.items()}
    assert all(weight[s] == pytest.approx(raw[s] / sum(raw.values())) for s in sizes)
    used = defaultdict(int)
    for r in got:
        used[r.source] += r.tokens
    for s in sizes:
        budget = next(r.budget for r in got if r.source == s)
        assert budget <= used[s] < budget + 10
        assert used[s] / used["a"] == pytest.approx(weight[s] / weight["a"], rel=0.05)
    # Every document is used, none more than once in a pass, and passes are full but the last.
    by_pass = Counter((r.source, r["pass"], r.doc_id) for r in got)
    assert max(by_pass.values()) == 1 and {r.doc_id for r in got} == set(range(total))


def test_repetition_limit(spark):
    got = uses(mixing.schedule(table(spark, {"a": 640, "b": 10}), entropy=None, repeats=2.0, block_tokens=40))
    assert max(Counter(r.doc_id for r in got).values()) <= 2
    assert got[0].exponent == pytest.approx(1 - math.log(2) / math.log(64), abs=1e-6)


def test_passes_are_other_permutations(spark):
    got = uses(mixing.schedule(table(spark, {"a": 3000, "b": 300}), entropy=None, repeats=3.0, block_tokens=100))
    place = defaultdict(dict)
    for r in got:
        if r.source == "b":
            place[r["pass"]][r.block] = r.place
    assert sorted(place[0].values()) == list(range(len(place[0]))) and place[0] != place[1]


def test_odd_inputs(spark):
    assert uses(mixing.schedule(docs_of(spark, []))) == []
    docs = docs_of(spark, [(1, None, None, None), (2, "", None, "a"), (3, " \t", None, None), (None, "x y", None, None), (4, "z", None, ""), (4, "z", None, "")])
    for name in ("key", "tokens", "block", "order", "pass", "share", "row", "left"):
        docs = docs.withColumn(name, F.lit("c"))
    got = uses(mixing.schedule(docs))
    first = [r for r in got if r["pass"] == 0]
    assert sorted((r.doc_id or 0, r.tokens) for r in first) == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1)]


def test_no_python_in_the_plan(spark):
    assert "Python" not in mixing.schedule(table(spark, {"a": 3})).drop("x")._jdf.queryExecution().executedPlan().toString()
