import random
import re

import pytest
from pyspark.sql import functions as F

from llm_support import docs_of
from siftwork.llm import near_dedup


def brute(rows):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    out = []
    for i, s in sets:
        c = None if i is None else root(i)
        out.append((i, len(s), c, i is None or i == c))
    return sorted(out, key=str)


def near_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
    return rows


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rows = near_rows()
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "One two"), (904, "one  TWO"), (905, "É five é six seven"), (905, "É five é six seven")]
    rows += [(None, rows[0][1]), (910, "word " * 30_000), (911, "word " * 29_000)]
    assert found(near_dedup.near_duplicates(docs_of(spark, rows))) == brute(rows)


def test_hot_buckets_and_clusters_in_blocks(spark, monkeypatch):
    rows = near_rows(7)
    base = " ".join(f"x{k}" for k in range(120))
    rows += [(1000 + k, base.replace(f"x{k} ", f"y{k} ")) for k in range(60)]
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "CLUSTER_SHINGLES", 900)
    assert found(near_dedup.near_duplicates(docs_of(spark, rows))) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert found(near_dedup.near_duplicates(docs_of(spark, []))) == []
    docs = docs_of(spark, [(2, "a b c d e f"), (1, "a b c d e f")])
    for name in ("fp", "keys", "sig", "rep", "bucket", "component_id", "kept", "n"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(near_dedup.near_duplicates(docs)) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_estimate_is_corrected(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.9):
        both = int(4000 * 2 * share / (1 + share))
        other = np.concatenate([one[:both], rng.integers(0, 1 << 63, 4000 - both, dtype=np.uint64)])
        a, b = (near_dedup.packed(near_dedup.minima(x)) for x in (one, other))
        assert near_dedup.estimates(a, b[None, :])[0] == pytest.approx(share, abs=0.17)


def test_one_id_with_several_texts(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue pink grey brown", "x y z")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (11, c), (12, d), (12, c), (20, "p q r"), (30, None), (30, a)]
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    parts = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert {i: parts[k] for k in parts for i in [k[0]] if i in (3, 5, 7)} == {3: 3, 5: 3, 7: 3}
    assert {parts[k] for k in parts if k[0] in (9, 11, 12)} == {9} and parts[20, 1] == 20
    assert [r.component_id for r in got if r.doc_id == 30 and r.n_shingles] == [3]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
