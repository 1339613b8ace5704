import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_support import docs_of
from siftwork.llm import langid

PARTS = {"aa": ["ba", "na", "ka", "to"], "bb": ["ri", "schu", "ez", "li"], "cc": ["ñu", "ós", "qua", "pe"]}


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(PARTS)[i % 3]
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 40))]
        rows.append((i, " ".join(words).title() + ", 12!", lang))
    return rows


def test_held_out_accuracy_and_calls(spark):
    rows = corpus()
    docs = docs_of(spark, rows)
    models = langid.learn(docs, sample=60, calibration=100)
    assert models.langs == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.identified(docs.drop("lang"), models).select("doc_id", "language.*").collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 200 and sum(got[i].lang_pred == lang for i, lang in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) <= 0.05 * len(got)


def test_probabilities_sum_to_one():
    models = langid.build({"x": [("aba", 3), ("abc", 1), ("ca", 2)], "y": [("bb", 5), ("cab", 1)]}, order=4, alphabet=50)
    # All 50 continuations of a history: 3 letters, the end, and 46 characters that no model has seen.
    for history in ("", "a", "ab", "cab", "zz"):
        nexts = [history + c for c in "abc"] + [history + chr(0x4E00 + k) for k in range(46)]
        points = np.array([ord(c) for w in [*nexts, history] for c in w], np.uint32)
        size = np.array([len(w) for w in [*nexts, history]])
        ends = np.cumsum(size)
        gram, ctx, word = langid.grams(points, ends - size, ends, 4)

        def last(keep):
            at = langid.find(models.grams[0], gram[0][keep])
            now = np.where(at[:, None] >= 0, models.logs[0][at], models.floor)
            for n in range(1, 4):
                c, at = langid.find(models.contexts[n], ctx[n][keep]), langid.find(models.grams[n], gram[n][keep])
                now = np.where(at[:, None] >= 0, models.logs[n][at], now + np.where(c[:, None] >= 0, models.backoffs[n][c], 0))
            return np.exp(now)

        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        letters, end = begin[:-1] + len(history), begin[-1:] + len(history)
        assert (last(letters).sum(0) + last(end).sum(0)) == pytest.approx([1.0, 1.0], abs=1e-4)


def test_brute_force_kneser_ney():
    words = {"x": [("aba", 3), ("abc", 1), ("ca", 2), ("b", 1)]}
    models = langid.build(words, order=3, alphabet=50)
    top = {}
    for w, c in words["x"]:
        s = "^^" + w + "$"
        for i in range(2, len(s)):
            top[s[i - 2 : i + 1]] = top.get(s[i - 2 : i + 1], 0) + c
    mid, low = {}, {}
    for g in top:
        mid[g[1:]] = mid.get(g[1:], 0) + 1
    for g in mid:
        low[g[1:]] = low.get(g[1:], 0) + 1

    def p(level, ctx, ch):
        if level < 0:
            return 1 / 50
        table = (low, mid, top)[level]
        ctx = ctx[len(ctx) - level :] if level else ""
        own = {g: n for g, n in table.items() if g[:-1] == ctx}
        if not own:
            return p(level - 1, ctx, ch)
        once, twice = (sum(n == k for n in table.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once else 0.5
        return (max(own.get(ctx + ch, 0) - d, 0) + d * len(own) * p(level - 1, ctx, ch)) / sum(own.values())

    for word in ("aba", "cab", "zz", "abcabc"):
        s = "^^" + word + "$"
        want = sum(math.log(p(2, s[i - 2 : i], s[i])) for i in range(2, len(s)))
        points = np.array([ord(c) for c in word], np.uint32)
        got = models.word_logs(points, np.array([0]), np.array([len(word)]))
        assert got[0, 0] == pytest.approx(want, rel=1e-4)


def test_odd_inputs(spark):
    docs = docs_of(spark, corpus(120) + [(900, None, "aa"), (901, "", "aa"), (902, "12 !?", "bb"), (None, "Bana", "aa"), (903, "Bana" * 50_000, None), (903, "ririri", None)])
    for name in ("rank", "language", "word", "score"):
        docs = docs.withColumn(name, F.lit("c"))
    models = langid.learn(docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.identified(docs, models).select("doc_id", "language.*").collect() if r.doc_id is None or r.doc_id >= 900}
    assert got == {(900, "und"), (901, "und"), (902, "und"), (None, "aa"), (903, "aa"), (903, "bb")}
    empty = langid.learn(docs_of(spark, []))
    assert empty.langs == [] and langid.identified(docs_of(spark, []), empty).collect() == []
    assert {tuple(r) for r in langid.identified(docs, empty).select("language.lang_pred", "language.score").collect()} == {("und", 0.0)}


def test_forgetting_words_changes_nothing(monkeypatch):
    models = langid.build({"x": [("aba", 3), ("abc", 1)], "y": [("bb", 5), ("cab", 1)]}, order=3)
    texts = ["aba bb cab", "xyz abc", "bb", "aba"] * 3
    want = models.entropies(texts)[0]
    monkeypatch.setattr(langid, "_CACHED", 2)
    models.__dict__.pop("cache")
    for _ in range(3):
        assert np.allclose(models.entropies(texts)[0], want)


def test_a_rare_language_rejects_gibberish_and_the_unknown(spark):
    rng = random.Random(4)
    rare = [(10_000 + i, " ".join("".join(rng.choice(["mi", "lo", "fu", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 40))), "dd") for i in range(90)]
    docs = docs_of(spark, corpus(600) + rare)
    models = langid.learn(docs)
    assert models.langs == ["aa", "bb", "cc", "dd"] and all(math.isfinite(x) for x in models.limits)
    odd = [" ".join("".join(rng.choice("miloufha") for _ in range(9)) for _ in range(20)) for _ in range(40)]
    odd += [" ".join("".join(rng.choice(["gd", "xw", "yv"]) for _ in range(4)) for _ in range(20)) for _ in range(40)]
    odd += ["привет мир как дела сегодня"]
    got = langid.identified(docs_of(spark, list(enumerate(odd))), models).select("language.*").collect()
    assert any(r.lang_pred == "dd" for r in got) and all(r.rejected for r in got)
    known = langid.identified(docs_of(spark, rare), models).select("language.*").collect()
    assert all(r.lang_pred == "dd" for r in known) and sum(r.rejected for r in known) <= 1


def test_limits_of_few_documents():
    low = {"few": [0.1 * k for k in range(11)], "one": [2.0], "many": [k / 1000 for k in range(1000)]}
    few, many, none, one = langid.limits_of(low, ["few", "many", "none", "one"], rejected=0.01)
    assert many == low["many"][990 - 1 + 1] and 1.0 < few < 4.0 and 2.0 < one < 6.0 and none == max(few, many, one)
    assert langid.limits_of({}, ["x"], alphabet=50) == [math.log(50)]


def counted_words(rows, lang):
    words = {}
    for i, text, own in rows:
        if own == lang and zlib.crc32(str(i).encode()) % 3 != 1:
            points, starts, ends, _ = langid.letter_runs([text])
            for s, e in zip(starts, ends):
                words[text.lower()[s:e]] = words.get(text.lower()[s:e], 0) + 1
    return sorted(words.items())


def test_all_training_documents_count(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD_GRAMS", 50)
    rows = corpus(600)
    docs = docs_of(spark, rows)
    orders = []
    for most in (langid.MODEL_BYTES, 20 * 120):
        models = langid.learn(docs, sample=2, calibration=3, model_bytes=most)
        orders.append(models.order)
        want = langid.build({lang: counted_words(rows, lang) for lang in PARTS}, models.order)
        assert models.langs == want.langs
        for name in ("grams", "logs", "contexts", "backoffs"):
            assert all(np.allclose(a, b) for a, b in zip(getattr(models, name), getattr(want, name), strict=True))
        assert np.allclose(models.floor, want.floor)
    assert orders[0] == 5 and 1 < orders[1] < 5


def test_limits_count_all_calibration_documents(spark):
    rows = [(i, text if i % 50 else text + " xqwv" * (1 + i // 50), lang) for i, text, lang in corpus(900)]
    docs = docs_of(spark, rows)
    models = langid.learn(docs, sample=2, calibration=3, rejected=0.05)
    part = docs.filter(langid.training_fold(F.col("doc_id"))).withColumn("counts", F.pmod(F.xxhash64("doc_id"), F.lit(5)) < 2).collect()
    first = langid.build({lang: counted_words([tuple(r)[:3] for r in part if r.counts], lang) for lang in PARTS})
    h, chars = first.entropies([r.text for r in part if not r.counts])
    low = {}
    for k, x in zip(h.argmin(1), langid.strangeness(h.min(1), chars)):
        low.setdefault(first.langs[k], []).append(float(x))
    want = langid.limits_of({k: sorted(v) for k, v in low.items()}, models.langs, 0.05)
    assert min(map(len, low.values())) > 100 and models.limits == pytest.approx(want, abs=2 / langid.GRID)


def test_limits_of_repeated_values():
    low = {"a": [0.1, 0.4, 0.9], "b": [1.0]}
    times = {"a": [3, 2, 1], "b": [2]}
    each = {k: [x for x, n in zip(low[k], times[k]) for _ in range(n)] for k in low}
    assert langid.limits_of(low, ["a", "b", "c"], times=times) == pytest.approx(langid.limits_of(each, ["a", "b", "c"]))
    assert langid.limits_of(low, ["a"], rejected=0.5, times=times) == [0.4]


def test_models_beyond_the_budget_keep_their_order_and_results(spark, monkeypatch):
    rows = corpus(600) + [(900, None, "aa"), (901, "Ünï straße", "bb"), (902, "xqwv vvq 12", None)]
    docs = docs_of(spark, rows)
    want = langid.learn(docs)
    monkeypatch.setattr(langid, "MODEL_BYTES", 20 * 120)
    monkeypatch.setattr(langid, "SHARD_ROWS", 300)
    monkeypatch.setattr(langid, "STORED_WORDS", 7)
    monkeypatch.setattr(langid, "_READ", 1)
    got = langid.learn(docs)
    assert isinstance(got, langid.StoredModels) and not hasattr(got, "grams")
    assert got.order == want.order == 5 and got.langs == want.langs and len(got.counts.paths) > 3
    assert got.limits == pytest.approx(want.limits, abs=2 / langid.GRID)
    texts = [t for _, t, _ in rows] + ["", "zz ñó", "bana"]
    h, chars = got.entropies(texts)
    expected, same = want.entropies(texts)
    assert np.allclose(h, expected, atol=1e-5) and (chars == same).all()
    mine, theirs = ([tuple(r) for r in langid.identified(docs, m).select("doc_id", "language.lang_pred", "language.rejected").collect()] for m in (got, want))
    assert sorted(mine, key=str) == sorted(theirs, key=str)


def test_stored_models_give_the_probabilities_of_built_ones(spark):
    words = {"x": [("aba", 3), ("abc", 1), ("ca", 2), ("b", 1)], "y": [("bb", 5), ("cab", 1), ("ñb", 2)]}
    want = langid.build(words, order=3, alphabet=50)
    rows = []
    for lang, each in words.items():
        count = {}
        for w, c in each:
            s = "\1\1" + w + "\2"
            for i in range(2, len(s)):
                count[s[i - 2 : i + 1]] = count.get(s[i - 2 : i + 1], 0) + c
        rows += [(lang, g, c) for g, c in count.items()]
    counted = spark.createDataFrame(rows + [("z", "aaa", 0)], "lang string, gram string, n long")
    got = langid.stored(counted, "n", 3, langid.Scratch(spark, "test"), "all", alphabet=50)
    assert got.langs == ["x", "y"]
    texts = ["aba cab zz", "abcabc", "bb ñb ñ", "кот"]
    assert np.allclose(got.entropies(texts)[0], want.entropies(texts)[0], atol=1e-5)
