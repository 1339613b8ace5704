import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from llm_support import docs_of
from siftwork.llm import simhash
from siftwork.llm.common import Scratch


def brute(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next), fingerprints taken text by text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    one = lambda t: simhash.fingerprints(pa.array([t], pa.large_string()))[0]
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        a, b, c = one(text), one(edited), one(following)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(float(simhash.likeness(a, b)), 9), round(float(simhash.likeness(a, c)), 9)))
    return out


def table(n=200, seed=3):
    rng = random.Random(seed)
    words = [f"wört{k}" for k in range(300)]
    return [(k * 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(n)]


def found(df):
    rows = df.select("doc_id", "n_chars", "edited_sha256", F.round("near_edited", 9), F.round("near_next", 9)).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STRETCH_ROWS", 17)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 500)
    rows = table() + [(None, "no id here at all"), (7, None), (8, ""), (10, "日本語 😀 text " * 20_000), (11, "x")]
    docs = docs_of(spark, random.Random(1).sample(rows, len(rows)))
    for name in ("stretch", "ahead", "tie", "a", "n", "head", "back", "at", "s"):
        docs = docs.withColumn(name, F.lit("c"))
    assert found(simhash.fingerprinted(docs)) == brute(rows)


def test_equal_texts_and_small_tables(spark):
    got = simhash.fingerprinted(docs_of(spark, [(1, "a b c d"), (2, "a b c d"), (2, "a b c d")])).collect()
    assert len({r.fingerprint for r in got}) == 1 and len(got) == 3 and all(len(r.fingerprint) == 32 for r in got)
    assert simhash.fingerprinted(docs_of(spark, [])).collect() == []
    (one,) = simhash.fingerprinted(docs_of(spark, [(5, "abcdefgh")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


def test_edits_are_nearer_than_strangers(spark):
    rows = [(i, t) for i, t in table(300, 8) if len(t) > 150]
    got = simhash.fingerprinted(docs_of(spark, rows)).collect()
    assert np.mean([r.near_edited for r in got]) > 0.6 > 0.3 > np.mean([r.near_next for r in got])
    assert sum(r.near_edited > r.near_next for r in got) > 0.98 * len(got)


def test_search_finds_every_neighbour(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (30, 2), dtype=np.uint64)
    prints = [base]
    for _ in range(6):
        flips = np.zeros((30, 2), np.uint64)
        for i in range(30):
            for bit in rng.choice(128, rng.integers(0, 6), replace=False):
                flips[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        prints.append(base ^ flips)
    prints.append(base[:1] ^ np.array([[np.uint64(1) << np.uint64(k), np.uint64(0)] for k in range(40)], np.uint64).reshape(-1, 2))
    p = np.unique(np.concatenate(prints), axis=0)
    df = spark.createDataFrame([tuple(int(x) for x in r.view(np.int64)) for r in p], "a long, b long")
    want = {}
    for i in range(len(p)):
        n = int((simhash.distance(p[i], p) <= 3).sum()) - 1
        if n:
            want[tuple(int(x) for x in p[i].view(np.int64))] = n
    for block in (2048, 6):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {(r.a, r.b): r.n_near for r in simhash.neighbours(df.union(df), Scratch(spark, "test")).collect()}
        assert got == want


def test_copies_with_changed_words_are_neighbours(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(20_000)]
    rows = []
    for i in range(80):
        text = [rng.choice(words) for _ in range(rng.choice([200, 500]))]
        rows.append((2 * i, " ".join(text)))
        for k in rng.sample(range(len(text)), 1 + i % 3):
            text[k] = rng.choice(words)
        rows.append((2 * i + 1, " ".join(text)))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(200))) for i in range(40)]
    got = {r.doc_id: r.n_near for r in simhash.fingerprinted(docs_of(spark, rows)).collect()}
    assert sum(got[i] == 1 for i in range(160)) >= 154 and not any(got[1000 + i] for i in range(40))


def test_wide_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (25, 2), dtype=np.uint64)
    prints = [base]
    for _ in range(8):
        flips = np.zeros((25, 2), np.uint64)
        for i in range(25):
            for bit in rng.choice(128, rng.integers(0, 15), replace=False):
                flips[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        prints.append(base ^ flips)
    p = np.unique(np.concatenate(prints), axis=0)
    df = spark.createDataFrame([tuple(int(x) for x in r.view(np.int64)) for r in p], "a long, b long")
    near = [int((simhash.distance(x, p) <= 16).sum()) - 1 for x in p]
    want = {tuple(int(v) for v in x.view(np.int64)): n for x, n in zip(p, near) if n}
    for block, deeper in ((2048, (512, 16384)), (2048, (0, 16384)), (7, (0, 1))):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "DEEPER", deeper)
        got = {(r.a, r.b): r.n_near for r in simhash.neighbours(df, Scratch(spark, "test"), 16).collect()}
        assert got == want
