"""Vector code compression with exact integer arithmetic.

Vectors become whole numbers and are cut into parts, each part coded by the nearest entry of its codebook. Distances come
from one float64 matrix product per block and pair of limbs: numbers are broken into limbs so small that every sum of
products stays below 2**53, where float64 is exact, and the products are put together in int64. So codes, errors and
codebooks are the same on every machine and for every order of the rows.

Per round each task gives one row per part and used entry (count and sums), which Spark adds up; codebooks, at most
``parts`` times ``entries`` entries, are all that passes the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftwork.llm.common import Scratch, text_session
from siftwork.plans.lookup import lookup

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
BLOCK_ROWS = 4096  # rows whose distances to all entries a task holds at once
EXACT = 53  # bits that a float64 holds


def clean(vector: Column) -> Column:
    """True for a vector of finite components; a null vector or component makes it false."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs of whole numbers, the lowest first: x = sum of limb k times 2**(bits k); only the last is signed."""
    out = []
    while True:
        if not x.size or max(-int(x.min()), int(x.max())) < 1 << bits:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of int64 matrices, exact as long as the results fit in int64."""
    width = max(1, x.shape[1])
    bits = (EXACT - math.ceil(math.log2(width))) // 2
    out = np.zeros((len(x), len(y)), np.int64)
    ys = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(ys):
            product = (a @ b.T).astype(np.int64)
            out += product << (bits * (i + j)) if i + j else product
    return out


def _fits(*largest: int, width: int) -> None:
    """Squared distances must fit in int64."""
    if width * sum(largest) ** 2 >= 1 << 63:
        raise OverflowError(f"components of up to {max(largest)} are too large for exact 64-bit distances over {width} dimensions")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of the nearest entry (the first of equals), and the squared distance."""
    if x.size:
        _fits(int(np.abs(x).max()), int(np.abs(book).max()), width=x.shape[1])
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    size = (book * book).sum(axis=1)
    for at in range(0, len(x), BLOCK_ROWS):
        part = x[at : at + BLOCK_ROWS]
        rest = size[None, :] - 2 * dots(part, book)
        best = rest.argmin(axis=1)
        code[at : at + len(part)] = best
        error[at : at + len(part)] = rest[np.arange(len(part)), best] + (part * part).sum(axis=1)
    return code, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), width).astype(np.int64)


def _batches(batches):
    for b in batches:
        if b.num_rows:
            yield b


def codebooks(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """The final codebooks, of shape (parts, entries, width of a part)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    step = width // parts
    for _ in range(rounds):

        def summed(batches, books=books):
            count = np.zeros(books.shape[:2], np.int64)
            total = np.zeros(books.shape, np.int64)
            for b in _batches(batches):
                x = _matrix(b.column("x"), width)
                for p in range(parts):
                    own = x[:, p * step : (p + 1) * step]
                    code, _ = nearest(own, books[p])
                    count[p] += np.bincount(code, minlength=books.shape[1])
                    order = np.argsort(code, kind="stable")
                    used, begin = np.unique(code[order], return_index=True)
                    total[p, used] += np.add.reduceat(own[order], begin, axis=0)
            p, e = np.nonzero(count)
            if len(p):
                cols = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e])]
                cols += [pa.array(total[p, e][:, k]) for k in range(step)]
                yield pa.RecordBatch.from_arrays(cols, ["part", "entry", "n", *(f"s{k}" for k in range(step))])

        schema = "part int, entry int, n long" + "".join(f", s{k} long" for k in range(step))
        sums = rows.select("x").mapInArrow(summed, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *(f"s{k}" for k in range(step)))])
        books = books.copy()
        for r in sums.collect():  # an entry of a codebook each
            books[r[0], r[1]] = [s // r[2] for s in r[3:]]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each vector of finite components (vec_id, embedding, label).

    Rows whose vector is null or holds a null or non-finite component give nothing. The codebooks start as the first rows by
    vec_id (a null id last, rows of one id in the order of their components), fewer where there are fewer. Of equally near
    entries the first counts. Repeated rows each give a row and each count in the averages. An empty table gives no row.
    All vectors must have one length that ``parts`` divides, else a ValueError says so; components so large that a squared
    distance leaves 64 bits raise an OverflowError. Null labels are one label. Other columns are not read.
    """
    spark = text_session(vectors.sparkSession)
    scratch = Scratch(spark, "codes")
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * scale).cast("long"))
    rows = vectors.filter(clean(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x"))
    rows = scratch.keep(rows, "rows")
    low, high = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if low is None:
        return spark.createDataFrame([], schema)
    if low != high or low % parts or not low:
        raise ValueError(f"vectors of {low} to {high} components cannot be cut into {parts} equal parts")
    width, step = low, low // parts
    books = codebooks(rows, width, parts, entries, rounds)

    def coded(batches):
        digits = np.array([f"{k:02x}" for k in range(max(256, books.shape[1]))])
        for b in _batches(batches):
            own = _matrix(b.column("x"), width)
            codes, total = [], np.zeros(len(own), np.int64)
            for p in range(parts):
                code, error = nearest(own[:, p * step : (p + 1) * step], books[p])
                codes.append(digits[code])
                total += error
            text = ["".join(c) for c in zip(*codes)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text), pa.array(total)], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    found = scratch.keep(rows.select("vec_id", "label", "x").mapInArrow(coded, f"vec_id long, label {label}, code string, error long"), "found")
    # A key that a null label has too.
    found = found.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = found.groupBy("_label").agg(F.sum("error").alias("label_error"))
    out = lookup(found, totals, ["_label"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """One round: the nearest entry of every part, then the new codebook."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, dist * 1024 + entry) AS entry, min(dist) AS dist FROM (
    SELECT v.r, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS dist
    FROM v JOIN book{k} b ON v.part = b.part AND v.pos = b.pos GROUP BY v.r, v.part, b.entry)
  GROUP BY r, part),
book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT v.part, n.entry, v.pos, ((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM v JOIN near{k} n ON v.r = n.r AND v.part = n.part GROUP BY v.part, n.entry, v.pos) m
  ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""


# DuckDB SQL of ``compressed`` over the table ``embeddings``.
SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * {SCALE})::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS MATERIALIZED (
  SELECT r, (i - 1) // (len(x) // {PARTS}) AS part, (i - 1) % (len(x) // {PARTS}) AS pos, x[i] AS x
  FROM (SELECT r, x, unnest(range(1, len(x) + 1)) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, r AS entry, pos, x FROM v WHERE r < {ENTRIES}),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
coded AS (SELECT r, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""
