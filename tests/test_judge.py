import json
import random
import re

import pytest
from pyspark.sql import functions as F

from siftwork.functions import variants as V
from siftwork.operators import judge as J, phrases as P
from tests.conftest import rows

BASE = {"severity": "P1", "file": "a.py", "line": 3, "title": "SQL injection", "description": "d", "category": "sql", "confidence": 0.95}


def judged(spark, items, **kw):
    data = [("r", i, json.dumps(x)) for i, x in enumerate(items)]
    df = spark.createDataFrame(data, "run_id string, seq long, j string").select("run_id", "seq", V.parse(F.col("j")).alias("raw"))
    cats = spark.createDataFrame([("sql",), ("xss",)], "category string")
    book = spark.createDataFrame([("exclusion", "rate-limit bypass"), ("precedent", "logging urls is safe")], "kind string, phrase string")
    return J.judge(df, cats, book, **kw)


def classes(spark, items, **kw):
    return [r.reject_class for r in judged(spark, items, **kw).orderBy("seq").collect()]


def test_contract_order(spark):
    cases = [
        ({}, None), ({"severity": " p1 "}, None), ({"severity": "HIGH"}, "schema"), ({"severity": "bad", "category": "odd"}, "schema"),
        ({"category": "odd"}, "category"), ({"category": ""}, None), ({"category": " XSS "}, None), ({"confidence": "0.9"}, None),
        ({"confidence": "high"}, "schema"), ({"confidence": None}, "schema"), ({"confidence": [1]}, "schema"), ({"confidence": True}, None),
        ({"confidence": "nan"}, "schema"), ({"confidence": "inf"}, "schema"), ({"confidence": 1.01}, "schema"), ({"confidence": -0.1}, "schema"),
        ({"confidence": 0.79}, "confidence"), ({"confidence": 0.8}, None), ({"severity": "P2", "confidence": 0.84}, "confidence"),
        ({"severity": "P3", "confidence": 0.94}, "confidence"), ({"title": " "}, "schema"), ({"title": "", "confidence": 0.1}, "confidence"),
        ({"title": "Rate-Limit bypass!"}, "exclusion"), ({"title": "rate-limit of bypass"}, None), ({"title": "xrate-limit bypass"}, None),
        ({"description": "Logging URLs is safe"}, "precedent"), ({"title": "logging urls is safe", "description": "rate-limit bypass"}, "exclusion"),
        ({"title": "rate-limit", "description": "bypass"}, "exclusion"),
    ]
    assert classes(spark, [{**BASE, **c} for c, _ in cases]) == [want for _, want in cases]


def test_missing_confidence_and_non_objects(spark):
    bare = {k: v for k, v in BASE.items() if k != "confidence"}
    assert classes(spark, [bare, "text", 5, None, [1]]) == ["confidence", "schema", "schema", "schema", "schema"]


@pytest.mark.parametrize("kw, want", [
    ({"floors": {"P1": 0.97}}, "confidence"), ({"floors": {"P1": 0.1}}, None), ({"global_floor": 0.96}, "confidence"),
    ({"global_floor": 0.99, "floors": {"P1": 0.9}}, None),
])
def test_floors(spark, kw, want):
    assert classes(spark, [BASE], **kw) == [want]


def test_hard_floor_cannot_be_lowered(spark):
    assert classes(spark, [{**BASE, "confidence": 0.5}], floors={"P1": 0.1}, global_floor=0.1) == ["confidence"]


def test_accepted_row(spark):
    items = [
        {**BASE, "line": "x", "rule_id": "", "ruleId": "R" * 130, "recommended_fix": " ", "evidence": " e "},
        {**BASE, "category": "", "line": None},
    ]
    got = rows(J.accepted(judged(spark, items, decision=F.lit("ask"))), "line", "rule_id", "recommended_fix", "evidence", "decision", "gate_id", "tool")
    assert got == [(0, "R" * 120, None, "e", "ask", "llm_judge", "llm"), (0, "llm:unknown", None, None, "ask", "llm_judge", "llm")]


def test_accepted_and_rejected_are_the_input(spark):
    rnd = random.Random(3)
    items = [{**BASE, "confidence": rnd.random() * 1.1, "severity": rnd.choice(["P0", "P3", "x"]), "category": rnd.choice(["sql", "odd"])} for _ in range(200)]
    out = judged(spark, items).cache()
    assert J.accepted(out).count() + J.rejected(out).count() == 200
    c = J.rejection_counts(out).first().asDict()
    assert c["accepted"] == J.accepted(out).count() and sum(c[k] for k in J.REJECT_CLASSES) == J.rejected(out).count()


def test_idle_phrases_change_no_verdict(spark):
    items = [{**BASE, "title": t} for t in ("rate-limit bypass", "a rate-limit  bypass", "logging urls is safe.", "none", "a++b")]
    data = [("r", i % 2, json.dumps(x)) for i, x in enumerate(items)]  # numbers repeat, as with several reports of a run
    df = spark.createDataFrame(data, "run_id string, seq long, j string").select("run_id", "seq", V.parse(F.col("j")).alias("raw"))
    cats = spark.createDataFrame([("sql",)], "category string")
    book = [("exclusion", "rate-limit bypass"), ("precedent", "logging urls is safe"), ("precedent", "++"), ("exclusion", "")]
    for idle in (0, 3, 1500):
        extra = [(k, f"idle phrase {n}") for n in range(idle) for k in ("exclusion", "precedent")]
        out = J.judge(df, cats, spark.createDataFrame(book + extra, "kind string, phrase string"))
        got = {r.title: r.reject_class for r in out.collect()}
        assert got == dict(zip([i["title"] for i in items], ["exclusion", None, "precedent", None, "precedent"]))


@pytest.mark.parametrize("carry", [True, False, None])
def test_phrase_hits_equal_brute_force(spark, carry):
    rnd = random.Random(11)
    words = ["rate", "limit", "café", "été", "x1", "don", "t", "кот", "c"]
    seps = [" ", "-", ". ", "’", " “", "++ ", "_"]
    texts = [(i, "".join(rnd.choice(words).upper() + rnd.choice(seps) for _ in range(12))) for i in range(80)]
    book = {"rate", "rate limit", "limit-rate", "don’t", "café été", "кот", "x1_c", "c++ c", "rate limit x1 don", "t. t", "-", " “", "++ "}
    df = spark.createDataFrame(texts, "id long, t string")
    phrases = spark.createDataFrame([(p,) for p in book], "phrase string")
    want = sorted((i, p) for i, t in texts for p in book if re.search(r"\b" + re.escape(p) + r"\b", t.lower()))
    assert want
    assert sorted(map(tuple, P.phrase_hits(df, phrases, ["id"], "t", carry_text=carry).collect())) == want


def test_large_lists_give_the_same_verdicts(spark, monkeypatch):
    rnd = random.Random(21)
    words = ["rate", "limit", "café", "log", "url", "++", "safe"]
    items = [{**BASE, "title": " ".join(rnd.choices(words, k=3)), "description": " ".join(rnd.choices(words, k=3))} for _ in range(60)]
    df = spark.createDataFrame([("r", i, json.dumps(x)) for i, x in enumerate(items)], "run_id string, seq long, j string").select("run_id", "seq", V.parse(F.col("j")).alias("raw"))
    book = [("exclusion", "rate limit"), ("exclusion", "log sql"), ("precedent", "url safe"), ("precedent", "++"), ("exclusion", "safe sql"), ("odd", "rate")]
    args = df, spark.createDataFrame([("sql",)], "category string"), spark.createDataFrame(book, "kind string, phrase string")
    small = rows(J.judge(*args), "seq", "reject_class")
    assert {c for _, c in small} == {None, "exclusion", "precedent"}
    monkeypatch.setattr(P, "BOOK_ROWS", 3)
    assert P.phrase_book(args[2], ["kind"]) is None
    assert rows(J.judge(*args), "seq", "reject_class") == small


def test_words_without_a_phrase_stay_in_their_partition(spark):
    texts = spark.range(2000).select("id", F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" common "), (F.col("id") % 7).cast("string")).alias("t"))
    book = spark.createDataFrame([("word17",), ("no such thing",)], "phrase string")
    out = P.phrase_hits(texts, book, ["id"], "t", carry_text=True)
    assert rows(out) == [(17, "word17")]
    bits = P._key_set(P._book(book, []))
    kept = texts.select(F.explode(F.filter(P._keys(F.col("t")), lambda k: P._may_be_key(bits, k))).alias("k"))
    assert kept.count() < 30 and kept.filter("k = 'word17'").count() == 1
    plan = P.phrase_hits(texts, book, ["id"], "t")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_inputs_fail_closed(spark):
    conf = [("ok", "f.json", "/r"), ("skip", "", "/r"), ("gone", "g.json", "/r"), ("out", "../x.json", "/r"), ("bad", "b.jsonl", "/r"), ("odd", "o.json", "/r")]
    files = [("ok", "f.json", '{"findings":[{"a":1},{"a":2}]}'), ("out", "../x.json", "[]"), ("bad", "b.jsonl", '{"a":1}\n{"a":'), ("odd", "o.json", '[{"a":1},7]')]
    cand, err = J.judge_inputs(
        spark.createDataFrame(conf, "run_id string, findings_file string, root string"),
        spark.createDataFrame(files, "run_id string, findings_file string, payload string"),
    )
    assert rows(cand.select("run_id", "seq")) == [("ok", 0), ("ok", 1)]
    assert rows(err, "run_id", "severity", "decision", "description") == [
        ("bad", "P1", "deny", "invalid JSONL at line 2"),
        ("gone", "P1", "deny", "LLM judge findings file not found"),
        ("odd", "P1", "deny", "LLM judge finding at index 1 must be an object"),
        ("out", "P1", "deny", "LLM judge findings file must resolve inside the repository root"),
    ]


def test_failed_candidates_do_not_share_a_key(spark, monkeypatch):
    seen = {}
    plain = J.lookup
    monkeypatch.setattr(J, "phrase_book", lambda *a: None)
    monkeypatch.setattr(J, "lookup", lambda many, one, keys, *a, **k: (seen.update({tuple(keys): many}), plain(many, one, keys, *a, **k))[1])
    made = spark.range(40).selectExpr("'r' AS run_id", "id AS seq", """try_parse_json('{"severity":"odd","title":"t' || id || '","confidence":1}') AS raw""")
    out = J.judge(made, spark.createDataFrame([("x",)], "category string"), spark.createDataFrame([("exclusion", "never said")], "kind string, phrase string"))
    assert [r.reject_class for r in out.select("reject_class").collect()] == ["schema"] * 40
    assert seen[("_at",)].select("_at").distinct().count() == 40


def test_long_lists_whose_phrases_do_not_occur_move_no_text(spark, monkeypatch):
    monkeypatch.setattr(P, "BOOK_ROWS", 5)
    monkeypatch.setattr(J, "_flagged_by_join", None)
    items = [{**BASE, "title": t, "description": d} for t, d in (("Idle 7", "phrase rate limit"), ("Rate", "limit-log"), ("idle 8 phrase", "x"), ("ok", "7 phrase"))]
    df = spark.createDataFrame([("r", i, json.dumps(x)) for i, x in enumerate(items)], "run_id string, seq long, j string").select("run_id", "seq", V.parse(F.col("j")).alias("raw"))
    idle = spark.range(10, 300).select(F.lit("exclusion").alias("kind"), F.concat(F.lit("idle "), F.col("id").cast("string"), F.lit(" phrase")).alias("phrase"))
    book = idle.unionByName(spark.createDataFrame([("exclusion", "rate limit"), ("precedent", "limit-log"), ("exclusion", "idle 8 phrase"), ("exclusion", "")], idle.schema))
    out = J.judge(df, spark.createDataFrame([("sql",)], "category string"), book)
    assert rows(out, "seq", "reject_class") == [(0, "exclusion"), (1, "exclusion"), (2, "exclusion"), (3, None)]


def test_phrases_that_occur_are_all_found(spark, monkeypatch):
    rnd = random.Random(12)
    words = ["rate", "limit", "café", "été", "x1", "don", "t", "кот", "c", "ñ"]
    seps = [" ", "-", ". ", "’", " “", "++ ", "_", ""]
    texts = [(i, "".join(rnd.choice(words).upper() + rnd.choice(seps) for _ in range(12))) for i in range(80)] + [(80, None), (81, "")]
    book = {"".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randint(1, 3))) for _ in range(300)} | {"-", " “", "++ ", "limit-", "’t", "never seen"}
    df = spark.createDataFrame(texts, "id long, t string")
    phrases = spark.createDataFrame([(p,) for p in sorted(book)] * 2, "phrase string")
    want = sorted(map(tuple, P.phrase_hits(df, phrases, ["id"], "t", carry_text=True).collect()))
    for most in (3, 250):
        monkeypatch.setattr(P, "BOOK_ROWS", most)
        assert P.phrase_book(phrases) is None
        assert (P.phrase_book(P.occurring(phrases, df, F.col("t"))) is None) == (most == 3)
        assert sorted(map(tuple, P.phrase_hits(df, phrases, ["id"], "t").collect())) == want
    assert len({p for _, p in want}) > 50
    assert {p for _, p in want} <= {r.phrase for r in P.occurring(phrases, df, F.col("t")).collect()} <= book - {"never seen"}
