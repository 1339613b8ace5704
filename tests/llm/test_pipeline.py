import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_near_dedup import brute as near_brute
from test_packing import true_ids
from test_quality import brute as counts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four sources, near and exact copies, junk, short and empty texts, nulls and repeated rows."""
    rng = random.Random(11)
    parts = {"aa": ["ba", "na", "ka", "to", "lu"], "bb": ["ri", "schu", "ez", "li", "gro"]}
    rows, labels = [], []
    for i in range(700):
        lang = sorted(parts)[i % 2]
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(55, 120))]
        rows.append([i, " ".join(words), lang, "hot" if i % 3 else f"s{i % 5}"])
        labels.append((i, 1, 0))
    for i in range(700, 740):
        base = rows[rng.randrange(600)]
        words = base[1].split()
        if i % 2:
            words[rng.randrange(len(words))] = "banana"
        rows.append([i, " ".join(words), base[2], "hot"])
    rows += [[800, None, "aa", "hot"], [801, "", None, None], [802, "too short", "aa", "s1"], [803, "ba na to " * 60, "aa", "s1"], [None, rows[0][1] + " lu lu", "aa", "s2"], rows[5], rows[5]]
    at = tmp_path_factory.mktemp("pipeline")
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([tuple(r) for r in rows], schema).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def stage(spark, folder, k, rows):
    docs = spark.createDataFrame([tuple(r[:4]) + (None,) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    return out, [list(r) for r in out.collect()]


def test_stages_and_run(spark, folder):
    at, rows = folder
    out, kept = stage(spark, at, 0, rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    passed = lambda t: (c := counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]
    # No junk is labelled, so only the base rules reject.
    assert Counter(r[0] for r in kept) == Counter(r[0] for r in rows if passed(r[1]))
    out, known = stage(spark, at, 1, kept)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(known) >= 0.98 * len(kept)
    out, single = stage(spark, at, 2, known)
    want = {i for i, _, _, keep in near_brute([(r[0], r[1]) for r in known]) if keep}
    assert Counter(r[0] for r in single) == Counter(want)
    out, mixed = stage(spark, at, 3, single)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r[0] for r in mixed} == want and max(Counter(r[0] for r in mixed).values()) <= 4
    _, pieces = stage(spark, at, 4, mixed)
    length = defaultdict(int)
    for p in pieces:
        length[p[0]] += p[2]
    uses = Counter(r[0] for r in mixed)
    text = {r[0]: r[1] for r in mixed}
    assert dict(length) == {i: n * len(true_ids(text[i])) for i, n in uses.items()}
    got = corpus_pipeline.run(spark, at).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got).keys() == Counter((p[0], p[4]) for p in pieces).keys()
    assert sum(r.length for r in got) == sum(p[2] for p in pieces)


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns_with_clashing_names_stay(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumns({n: F.lit(n) for n in ("verdict", "_Verdict", "language", "_language", "n", "rank")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        assert out.select("verdict", "_Verdict", "language", "_language", "n", "rank").distinct().collect() == [("verdict", "_Verdict", "language", "_language", "n", "rank")]


def test_documents_outside_the_training_fold_teach_their_language(spark, folder):
    at, _ = folder
    rng = random.Random(5)
    parts = {"aa": ["ba", "na", "ka", "to"], "bb": ["ri", "schu", "ez", "li"], "cc": ["привет", "мир", "ночь"]}
    rows = []
    for i in range(600):
        # All documents of one language are held out of the fold that op8_langid learns from.
        lang = "cc" if zlib.crc32(str(i).encode()) % 3 == 1 else ("aa", "bb")[i % 2]
        rows.append([i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(60)), lang, "s"])
    rows += [[None, "ñuós quape " * 30, "dd", "s"]] * 2
    _, known = stage(spark, at, 1, rows)
    assert {r[2] for r in known} == {"aa", "bb", "cc", "dd"} and len(known) >= 0.98 * len(rows)
