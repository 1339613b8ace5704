"""Whole-word phrase containment between a text relation and a phrase relation of any size."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftwork.plans.lookup import lookup
from siftwork.plans.pin import exploded, let
from siftwork.plans.session import shared_folder

# Runs of ASCII word characters, and runs of other letters, marks and digits. A phrase with word
# edges has the same runs where it occurs, and ASCII text never pays for Unicode classes.
_WORD = r"[a-z0-9_]+|[\p{L}\p{M}\p{N}&&[^\x00-\x7F]]+"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))


# What lies between two words. A phrase without a word has word edges only where it is all of it.
_BETWEEN = r"[^\p{L}\p{M}\p{N}_]+"


def _key(phrase: Column) -> Column:
    """What a text must hold to hold the phrase: its longest word, or the whole phrase if it has no word."""
    longest = F.array_max(F.transform(_words(phrase), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return F.coalesce(longest["w"], F.concat(F.lit("\0"), phrase))


def _keys(text: Column) -> Column:
    between = F.regexp_extract_all(text, F.lit(_BETWEEN), F.lit(0))
    return F.array_distinct(F.concat(_words(text), F.transform(F.array_distinct(between), lambda r: F.concat(F.lit("\0"), r))))


def contains_phrase(text: Column, phrase: Column) -> Column:
    quoted = F.regexp_replace(phrase, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return text.contains(phrase) & F.rlike(text, F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b")))


# A list of so many phrases and bytes is one literal of the plan, a table of buckets; a larger one is joined.
BOOK_ROWS, BOOK_BYTES = 10_000, 1 << 20


class Book(NamedTuple):
    """A checked, small phrase list: ``table`` holds its entries by bucket of their key."""

    table: Column
    buckets: int
    gaps: bool  # whether some phrase has no word, so that what lies between words counts too

    def candidates(self, text: Column) -> Column:
        """The entries whose key occurs in the lower-cased text: ``array<struct<on, key, phrase>>``."""
        keys = _keys(text) if self.gaps else F.array_distinct(_words(text))

        def of(key: Column) -> Column:
            bucket = F.get(self.table, F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))
            return F.filter(bucket, lambda e: e["key"] == key)

        return F.flatten(F.transform(keys, of))


def phrase_book(phrases: DataFrame, on: Sequence[str] = ()) -> Book | None:
    """The phrase list as a literal, or None where it is too large for that. Its size is counted first."""
    book = _book(phrases, on)
    rows, size = book.limit(BOOK_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    if rows > BOOK_ROWS or size > BOOK_BYTES:
        return None
    buckets = 1 << max(4, (2 * rows).bit_length())
    listed = book.select(*on, F.col("_key").alias("key"), "phrase", F.pmod(F.xxhash64("_key"), F.lit(buckets)).alias("at"))
    entry = T.StructType([f for f in listed.schema if f.name != "at"])
    table: list[list[dict]] = [[] for _ in range(buckets)]
    for r in listed.collect():  # counted above
        table[r["at"]].append({f.name: r[f.name] for f in entry})
    gaps = any(e["key"].startswith("\0") for spot in table for e in spot)
    return Book(F.from_json(F.lit(json.dumps(table)), T.ArrayType(T.ArrayType(entry))), buckets, gaps)


def _book(phrases: DataFrame, on: Sequence[str]) -> DataFrame:
    return phrases.select(*on, "phrase").filter(F.col("phrase") != "").distinct().withColumn("_key", _key(F.col("phrase")))


def _pairs(words: Column) -> Column:
    """Neighbouring words, with a space between them."""
    return let(words, lambda w: F.array_compact(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))))


def _anchor(phrase: Column) -> Column:
    """A hash of what a text must hold to hold the phrase: its longest two neighbouring words, or its key if it has fewer."""
    longest = F.array_max(F.transform(_pairs(_words(phrase)), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    return F.xxhash64(F.coalesce(longest["p"], _key(phrase)))


def _anchors(text: Column) -> Column:
    return F.array_distinct(F.transform(F.concat(_keys(text), _pairs(_words(text))), lambda a: F.xxhash64(a)))


def occurring(phrases: DataFrame, texts: DataFrame, text: Column, on: Sequence[str] = ()) -> DataFrame:
    """The phrases of a large list that some text may hold, written to the shared folder.

    Only hashes of words move, each once per partition of the texts; equal hashes of different words do no harm, as the
    phrases are tested later. Most phrases of a long list occur nowhere, so texts need not meet them.
    """
    spark = phrases.sparkSession
    own = exploded(texts, [], _anchors(F.lower(text)), "_pos", "_anchor").select("_anchor").distinct()
    listed = phrases.select(*on, "phrase").filter(F.col("phrase") != "")
    found = listed.withColumn("_anchor", _anchor(F.col("phrase"))).join(own, "_anchor", "left_semi").drop("_anchor").distinct()
    path = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


# Longs of the bit set that says which keys may be a phrase's; its size does not depend on the list.
SET_LONGS = 4096


def _key_set(book: DataFrame) -> Column:
    """A bit set of the keys' hashes, a literal."""
    bit = F.pmod(F.xxhash64("_key"), F.lit(64 * SET_LONGS))
    own = book.select(F.floor(bit / 64).alias("at"), F.expr("shiftleft(1L, cast(pmod(xxhash64(_key), 64L) as int))").alias("bits"))
    longs = [0] * SET_LONGS
    for r in own.groupBy("at").agg(F.bit_or("bits").alias("bits")).collect():  # SET_LONGS rows at most
        longs[r["at"]] = r["bits"]
    return F.from_json(F.lit(json.dumps(longs)), "array<bigint>")


def _may_be_key(bits: Column, key: Column) -> Column:
    at = F.pmod(F.xxhash64(key), F.lit(64 * SET_LONGS))
    own = F.get(bits, F.floor(at / 64).cast("int"))
    return F.call_function("shiftright", own, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(1) == 1


def phrase_hits(
    texts: DataFrame, phrases: DataFrame, ids: Sequence[str], text: str, on: Sequence[str] = (), carry_text: bool | None = None
) -> DataFrame:
    """Distinct ``(ids, on, phrase)`` where the lower-cased text holds the phrase as whole words.

    A phrase can only match where its longest word occurs, its key; the exact test runs on those candidates alone. A list
    that was counted and is small is part of the plan, so texts stay where they are. Of a larger list the phrases that
    occur are found first; where they are many too, they are joined by key: a bit set of all keys is tested first, so words
    that no phrase is keyed by never leave their partition. ``carry_text`` asks for the join in any case: with it the text
    rides along with its keys, which suits short texts; without it long texts are joined back by ``ids``. Phrases are lower
    case; empty ones match nothing.
    """
    keep = [*ids, *on]
    body = texts.select(*keep, F.lower(F.col(text)).alias("_text"))
    small = phrase_book(phrases, on) if carry_text is None else None
    if carry_text is None and not small and not texts.isStreaming:
        phrases = occurring(phrases, texts, F.col(text), on)
        small = phrase_book(phrases, on)
    if small:
        mine = [F.col(c) for c in on]

        def holds(e: Column) -> Column:
            same = reduce(lambda a, b: a & b, [e[c] == m for c, m in zip(on, mine)], F.lit(True))
            return same & contains_phrase(F.col("_text"), e["phrase"])

        found = F.transform(F.filter(small.candidates(F.col("_text")), holds), lambda e: e["phrase"])
        return exploded(body, keep, found, "_pos", "phrase").drop("_pos").distinct()
    book = _book(phrases, on)
    bits = _key_set(book)
    carried = ["_text"] if carry_text else []
    keyed = exploded(body, [*keep, *carried], F.filter(_keys(F.col("_text")), lambda k: _may_be_key(bits, k)), "_pos", "_key").drop("_pos")
    # A common word is the key of many texts, so its texts go to several tasks.
    near = lookup(keyed, book, [*on, "_key"], "inner")
    if not carry_text:
        near = near.select(*keep, "phrase").distinct().join(body, keep)
    return near.filter(contains_phrase(F.col("_text"), F.col("phrase"))).select(*keep, "phrase").distinct()
