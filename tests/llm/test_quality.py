import inspect
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_support import docs_of
from siftwork.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)


CASES = [None, "", " \n\t", "one", "a b c a b c", "la la la la la", "x y\nx y\n\nx y \n", "é ü ñ ß # $$ <b>", "a\x0bb\x0cc\rd", "w " * 100_000, "日本 語 " * 3]


def test_counts_equal_brute_force():
    rng = random.Random(3)
    texts = CASES + ["".join(rng.choice("ab é#\n ") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    got, _ = quality.measures(pa.array(texts, pa.string()))
    assert list(zip(*(got[k].tolist() for k in quality._BASE))) == [brute(t) for t in texts]


def test_tail_is_the_binomial_sum():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.02), (200, 7, 0.05), (5, 5, 0.5)):
        assert quality.tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def corpus(n=3000):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        junk = i % 5 == 0
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(80)]
        rows.append((i, " ".join(w + "%%%" if junk and rng.random() < 0.7 else w for w in words), ("en", "de")[i % 2]))
        labels.append((i, 0 if junk else 1, 0))
    return rows, labels


def test_junk_goes_good_stays(spark):
    rows, labels = corpus()
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality.learn(docs, known)
    assert set(rules.cutoffs) == {"en", "de"}
    got = {r.doc_id: r for r in quality.judged(docs, rules).select("doc_id", "quality.*").collect()}
    assert all(got[i].kept == bool(q) for i, q, _ in labels if not got[i].base_failed)


def test_uncertain_strata_reject_nothing(spark):
    rows, labels = corpus(200)
    docs = docs_of(spark, rows)
    assert quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).cutoffs == {}
    assert quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).cutoffs == {}
    # Labels that disagree and null labels teach nothing.
    odd = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, odd).cutoffs == {}


def test_odd_inputs(spark):
    none = quality.Rules(np.zeros(11), np.ones(11), np.zeros(12), {None: -1.0})
    docs = docs_of(spark, [(1, None), (None, "w%d " * 10), (3, " ".join(f"w{k}" for k in range(60))), (3, " ".join(f"w{k}" for k in range(60)), "en")])
    docs = docs.withColumn("kept", F.lit("c")).withColumn("n_words", F.lit("c"))
    got = quality.judged(docs, none).select("doc_id", "lang", "quality.kept", "quality.base_failed").collect()
    assert sorted((r.doc_id or 0, r.lang or "", r.kept, r.base_failed) for r in got) == [(0, "", False, True), (1, "", False, True), (3, "", False, False), (3, "en", True, False)]
    assert quality.judged(docs_of(spark, []), none).collect() == []


def test_a_stratum_that_the_sample_misses_gets_its_cutoff(spark):
    rows, labels = corpus(4000)
    # The rare language has a good share of the documents and next to none of the sample that fits the score.
    rows = [(i, text, "rare" if i < 1000 else "en") for i, text, _ in rows]
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality.learn(docs, known, fit_rows=20)
    assert set(rules.cutoffs) == {"rare", "en"}
    got = {r.doc_id: r.quality.kept for r in quality.judged(docs, rules).select("doc_id", "quality").collect()}
    junk = [i for i, q, _ in labels if not q and i < 1000]
    assert sum(not got[i] for i in junk) > 0.9 * len(junk)
    assert sum(got[i] for i, q, _ in labels if q) > 0.97 * sum(q for _, q, _ in labels)


def test_strata_that_cannot_pass_cost_the_others_nothing():
    sizes = {"en": 1000, "de": 190, None: 170} | {f"x{k}": 3 for k in range(5000)}
    assert quality.testable(sizes, 0.02, 0.1) == ["en", "de", None]
    assert quality.testable({"en": 113}, 0.02, 0.1) == [] and quality.testable({}, 0.02, 0.1) == []


def test_the_score_is_fitted_on_all_rows(spark):
    assert inspect.signature(quality.learn).parameters["fit_rows"].default is None
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    junk = rng.random(500) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 3]))
    rows = spark.createDataFrame([(v.tolist(), bool(j)) for v, j in zip(x, junk)], "x array<double>, junk boolean").repartition(7)
    mean, scale, w = quality.fit_score(rows)
    assert np.allclose(mean, x.mean(0)) and np.allclose(scale, x.std(0) + 1e-6)
    z = np.hstack([np.ones((500, 1)), np.clip((x - mean) / scale, -8, 8)])
    # At the optimum the gradient of the penalised likelihood over all rows is zero.
    assert np.abs(z.T @ (1 / (1 + np.exp(-z @ w)) - junk) + 0.5 * w).max() < 1e-6
    assert quality.fit_score(rows.filter("junk")) is None and quality.fit_score(rows.limit(0)) is None
