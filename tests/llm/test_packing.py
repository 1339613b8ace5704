import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_support import docs_of
from siftwork.llm import packing

ODD = [None, "", " ", "Don't it's WE'RE x's 'sa", "a\x1cb \x85 c\xa0d", "<|endoftext|> <|startoftext|>", "a<|endoftext|>B<|STARTOFTEXT|>c<|startoftext|>", "<|endoftext|", "É÷é×ÿß.Þþ, x1y22-3é4", "Àéî'L d'Où", "É é ÇA ß İstanbul Σς", "日本語 テキスト", "a_b--c ##1,2.3!", "퟿😀 ok.", "x" * 9000, "é ́e"]


WHOLE = Tokenizer.from_file(packing.TOKENIZER)


def true_ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [2]


def test_word_by_word_equals_whole_texts(monkeypatch):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abÉ é'.,!1 \n\x1fstÀ÷ßK\u212a\u0301<|_") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    want = [true_ids(t)[:-1] for t in texts]
    ids = packing.WordIds(packing.TOKENIZER)
    assert [x.tolist() for x in ids(pa.array(texts, pa.string()))] == want
    monkeypatch.setattr(packing, "_CACHED", 5)
    ids = packing.WordIds(packing.TOKENIZER)
    for _ in range(2):
        assert [x.tolist() for x in ids(pa.array(texts, pa.string()))] == want
    ids = packing.WordIds(packing.TOKENIZER, by_word=False)
    assert [x.tolist() for x in ids(pa.array(texts, pa.string()))] == want


def check(rows, texts, window):
    """Every id lies in one piece, sequences are gapless and no longer than the window."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array(true_ids(text), "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    short = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        short += at < window
    return short


def test_pieces_and_sequences(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioubdfgk") for _ in range(5)) for _ in range(300)]
    texts = {k: " ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for k in range(300)}
    texts[300] = " ".join(rng.choice(words) for _ in range(5000))
    texts.update({400 + k: t for k, t in enumerate(ODD)})
    docs = docs_of(spark, list(texts.items()))
    short = check(packing.pack(docs, window=128, shard_tokens=4000, task_tokens=20_000).collect(), texts, 128)
    assert short <= 25
    assert check(packing.pack(docs).collect(), texts, 4096) == 1


def test_ids_and_repeated_rows(spark):
    docs = docs_of(spark, [(1, "one two three"), (1, "one two three"), (None, "four")])
    for name in ("n", "place", "ids", "start"):
        docs = docs.withColumn(name, F.lit("c"))
    rows = packing.pack(docs, with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == sorted([(1, true_ids("one two three"))] * 2 + [(0, true_ids("four"))])
    assert packing.pack(docs_of(spark, [])).collect() == []


def test_scores_are_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 60, rng.integers(1, 40)).astype("<u4") for _ in range(30)]
    index = packing.Index(docs)
    mean = np.mean([len(d) for d in docs])
    for seed in (0, 7, 29):
        got = index.scores(seed)
        for j, d in enumerate(docs):
            want = 0.0
            for t in set(docs[seed].tolist()):
                df, tf = sum(t in x for x in docs), int((d == t).sum())
                want += max(0.0, np.log((30 - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            assert got[j] == pytest.approx(want)


def test_neighbours_share_a_window():
    docs = [np.arange(a, a + 20, dtype="<u4") for a in (0, 100, 200, 300) for _ in range(3)]
    order = [0, 3, 6, 9, 1, 4, 7, 10, 2, 5, 8, 11]
    docs = [docs[k] for k in order]
    made = packing.packed([len(d) for d in docs], packing.Index(docs), 60)
    assert [len({int(docs[i][0]) for i, _, _ in s}) for s in made] == [1, 1, 1, 1]
