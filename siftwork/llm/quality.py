"""Quality rules with risk-controlled thresholds.

A score of junk is fitted on one half of the labelled documents. On the other half, the holdout, cutoffs are tested per
stratum (language): a cutoff may be used only if an exact binomial bound says that it rejects at most a stated share of the
good documents. Per stratum the cutoffs are tested in a fixed order, from the one that rejects least, until the first that
fails, which needs no correction; over the strata the error probability is divided by their number (Bonferroni), without
those whose holdout is too small for any cutoff.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftwork.llm.common import Texts, blocks, maybe_broadcast, mix, text_session

MOST_REJECTED = 0.02  # of the good documents of a stratum
ERROR = 0.1  # probability that any stratum's limit is broken
BLOCK_BYTES = 512 << 10  # of text that are measured at once
# Shares of the good documents of the fitting half that the tested cutoffs reject there, in the order of the tests.
TRIED = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.008, 0.012, 0.016)
QUANTILES = 20_000  # accuracy of the tried cutoffs' places; exact up to about as many good documents
# A good document that is lost counts as much as so many junk documents that stay.
PRICE = 10.0
# The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
FEATURES = ("symbols", "dup_lines", "repeats", "capitals", "exclaims", "marks", "digits", "word_chars", "log_words", "distinct", "stops")

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _has(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL, _UPPER, _EXCLAIM, _DIGIT, _STOP = (_has(x) for x in (SYMBOLS, bytes(range(65, 91)), b"!", b"0123456789", b"."))
_MARK = _has(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_POINT = np.array([0 if 0x80 <= b < 0xC0 else 1 for b in range(256)])


def measures(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The five counts of each text, and the matrix of its features."""
    t = Texts(column)
    n = len(t.offsets) - 1

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[t.offsets[1:]] - total[t.offsets[:-1]]

    words = np.diff(t.first)
    chars = per_text(_POINT[t.data] * t.word_bytes)
    symbols = per_text(_SYMBOL[t.data])
    h = t.hashes()
    owner = np.repeat(np.arange(n), words)
    # Words that lie in a window of three that the text holds twice or more.
    windows, first = t.windows(h, 3)
    of = np.repeat(np.arange(n), np.diff(first))
    with np.errstate(over="ignore"):
        _, back, count = np.unique(mix(windows + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    begin = (np.arange(len(windows)) - first[:-1][of] + t.first[:-1][of])[count[back] > 1]
    cover = np.zeros(len(h) + 3, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + 3, -1)
    repeat = np.bincount(owner, np.cumsum(cover)[: len(h)] > 0, n).astype(np.int64)
    with np.errstate(over="ignore"):
        distinct = np.unique(mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(owner[distinct], minlength=n)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        filled = [x for x in t.data[t.offsets[i] : t.offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
        lines[i], dup[i] = len(filled), len(filled) - len(set(filled))

    some, size = np.maximum(words, 1), np.maximum(chars, 1)
    features = np.stack(
        [
            symbols / some,
            dup / np.maximum(lines, 1),
            repeat / some,
            per_text(_UPPER[t.data]) / size,
            per_text(_EXCLAIM[t.data]) / some,
            per_text(_MARK[t.data]) / some,
            per_text(_DIGIT[t.data]) / size,
            np.minimum(chars / some, 50),
            np.log1p(words),
            distinct / some,
            per_text(_STOP[t.data]) / some,
        ],
        axis=1,
    )
    return dict(zip(_BASE, (words, chars, symbols, dup, repeat))), features


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


@dataclass(frozen=True)
class Rules:
    """A fitted score and the certified cutoff of each stratum; strata without one reject nothing."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cutoffs: dict[str | None, float]

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        return x @ self.weights[1:] + self.weights[0]


def fit_score(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean, scale and weights of a ridge logistic regression (Newton's method) on all rows (x, junk), or None without rows of
    both kinds. Each step sums the gradient and the second derivatives in the tasks; the driver gets a row of each."""
    x = [F.col("x")[i] for i in range(len(FEATURES))]
    seen = rows.agg(F.count_if("junk"), F.count_if(~F.col("junk")), *map(F.avg, x), *map(F.stddev_pop, x)).first()
    if not seen[0] or not seen[1]:
        return None
    mean, scale = np.array(seen[2 : 2 + len(x)]), np.array(seen[2 + len(x) :]) + 1e-6

    def sums(w: np.ndarray) -> np.ndarray:
        def apply(batches):
            total = np.zeros((len(w), len(w) + 1))
            for b in batches:
                x = b.column("x").flatten().to_numpy().reshape(-1, len(mean))
                x = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)])
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total[:, 0] += x.T @ (p - b.column("junk").to_numpy(zero_copy_only=False))
                total[:, 1:] += (x * (p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["total"])

        parts = rows.select("x", "junk").mapInArrow(apply, "total array<double>").collect()  # one for each task
        return np.array([math.fsum(c) for c in zip(*(r.total for r in parts))]).reshape(len(w), len(w) + 1)

    w = np.zeros(len(mean) + 1)
    for _ in range(30):
        total = sums(w)
        step = np.linalg.solve(total[:, 1:] + 0.5 * np.eye(len(w)), total[:, 0] + 0.5 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def tail(k: int, n: int, share: float) -> float:
    """Probability of at most k hits in n draws at the given share, exactly."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    steps = np.log((n - i[:-1]) / (i[:-1] + 1)) + math.log(share / (1 - share))
    logs = n * math.log1p(-share) + np.concatenate([[0.0], np.cumsum(steps)])
    return float(min(1.0, np.exp(logs).sum()))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, stratum, junk, holdout and features of the documents with one clear label."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    known = known.filter("low = high").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("low") == 0).alias("junk"))

    def apply(batches):
        for b in blocks(batches, "text", BLOCK_BYTES):
            m, x = measures(b.column("text"))
            use = pa.array(~base_failed(m))
            rows = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "stratum", "junk", "holdout")), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "stratum", "junk", "holdout", "x"])
            yield rows.filter(use)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), F.col("text").cast("string").alias("text"))
    rows = rows.join(maybe_broadcast(known, known.count()), "doc_id").withColumn("holdout", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)) == 1)
    return rows.mapInArrow(apply, "doc_id long, stratum string, junk boolean, holdout boolean, x array<double>")


def _score_column(rules: Rules):
    """The score of ``rules`` from the array ``x`` of features."""
    total = F.lit(float(rules.weights[0]))
    for i in range(len(FEATURES)):
        z = (F.col("x")[i] - F.lit(float(rules.mean[i]))) / F.lit(float(rules.scale[i]))
        total = total + F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z)) * F.lit(float(rules.weights[i + 1]))
    return total


def testable(sizes: dict[str | None, int], most: float, error: float) -> list[str | None]:
    """The strata whose holdouts have enough good documents to certify a cutoff when the error is divided among them.

    ``sizes`` are numbers of good documents in the holdout. The choice does not see how many a cutoff rejects, so the bounds
    hold; strata that could never pass take nothing from the others' share of the error.
    """
    order = sorted(sizes, key=lambda s: (-sizes[s], s is not None, s or ""))
    while order and tail(0, sizes[order[-1]], most) > error / len(order):
        order.pop()
    return order


def learn(docs: DataFrame, labels: DataFrame, most: float = MOST_REJECTED, error: float = ERROR, fit_rows: int | None = None) -> Rules:
    """Fit the score and choose the cutoffs. Without labels of both kinds no document is rejected.

    The weights of the score use all labelled documents of the fitting half; only a caller that gives ``fit_rows`` has them
    fitted on so many, the smallest by a hash of their id. Cutoffs to be tried and what they gain count all of the fitting
    half; the tests count all of the holdout.
    """
    from siftwork.llm.common import Scratch

    spark = text_session(docs.sparkSession)
    scratch = Scratch(spark, "quality")
    rows = scratch.keep(labelled(docs, labels), "labelled")
    fit = rows.filter("not holdout")
    if fit_rows is not None:
        fit = scratch.keep(fit.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "fit")
    fitted = fit_score(fit)
    if fitted is None:
        return Rules(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1), {})
    rules = Rules(*fitted, {})
    scored = scratch.keep(rows.select("stratum", "junk", "holdout", _score_column(rules).alias("score")), "scored")
    mine, held = F.col("junk") | F.col("holdout"), ~F.col("junk") & F.col("holdout")
    good = F.when(~mine, F.col("score"))
    strata = scored.groupBy("stratum").agg(
        F.sum(held.cast("long")).alias("held"), F.max(good).alias("top"), F.percentile_approx(good, [1 - f for f in TRIED], QUANTILES).alias("at")
    )
    known = {r.stratum: r for r in strata.filter("held > 0 and top is not null").collect()}
    strata = testable({s: r.held for s, r in known.items()}, most, error)
    if not strata:
        return rules
    # Each cutoff lies between two neighbouring scores of good documents.
    grid = spark.createDataFrame([(s, float(v)) for s in strata for v in sorted(set(known[s].at))], "s string, v double")
    same = F.col("stratum").eqNullSafe(F.col("s"))
    above = scored.filter(~mine).join(F.broadcast(grid), same).groupBy("s", "v").agg(F.min(F.when(F.col("score") > F.col("v"), F.col("score"))).alias("next")).collect()
    tests = {s: sorted({(r.v + r.next) / 2 if r.next is not None else r.v + 0.5 for r in above if r.s == s}, reverse=True) for s in strata}
    pairs = [(s, k, float(c)) for s, cuts in tests.items() for k, c in enumerate(cuts)]
    grid = spark.createDataFrame(pairs, "s string, k int, cut double")
    over = F.col("score") >= F.col("cut")
    counts = scored.join(F.broadcast(grid), same).groupBy("s", "k")
    counts = counts.agg(*(F.sum((what & over).cast("long")).alias(name) for what, name in ((held, "hit"), (F.col("junk") & ~F.col("holdout"), "bad"), (~mine, "good"))))
    counted = {(r.s, r.k): r for r in counts.collect()}
    cutoffs = {}
    for s, cuts in tests.items():
        best = 0.0
        for k, cut in enumerate(cuts):
            r = counted[s, k]
            if tail(r.hit, known[s].held, most) > error / len(tests):
                break
            gain = r.bad - PRICE * r.good
            if gain > best:
                best, cutoffs[s] = gain, float(cut)
    return Rules(rules.mean, rules.scale, rules.weights, cutoffs)


_KINDS_ARROW = pa.struct([*((c, pa.int64()) for c in _BASE), ("score", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
_KINDS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,score:double,base_failed:boolean,kept:boolean>"


def judged(docs: DataFrame, rules: Rules, column: str = "quality") -> DataFrame:
    """All columns of ``docs`` and a struct with the counts, the score and the verdicts.

    A null or empty text has no words, so it fails the base rule and is not kept.
    """
    text_session(docs.sparkSession)

    @F.arrow_udf(_KINDS)
    def judge(text: pa.Array, lang: pa.Array) -> pa.Array:
        out = []
        for b in blocks([pa.RecordBatch.from_arrays([text, lang], ["text", "lang"])], "text", BLOCK_BYTES):
            m, x = measures(b.column("text"))
            score, failed = rules.score(x), base_failed(m)
            cut = np.array([rules.cutoffs.get(s, math.inf) for s in b.column("lang").to_pylist()])
            kept = ~failed & (score < cut)
            out.append(pa.StructArray.from_arrays([*(pa.array(m[c]) for c in _BASE), pa.array(score), pa.array(failed), pa.array(kept)], [*_BASE, "score", "base_failed", "kept"]))
        return pa.concat_arrays(out) if out else pa.array([], _KINDS_ARROW)

    return docs.withColumn(column, judge(F.col("text").cast("string"), F.col("lang").cast("string")))
