"""Scoring documents with a Katz back-off model of any order that the corpus itself trains.

p(w | h) is the Good-Turing discounted share of the n-gram (h, w) where training has it, else the back-off weight of h times
p(w | h') with h' the history without its first word, and so on down to the discounted share of w; a word that training lacks
has the mass that the discounts of single words free. The weights are such that the probabilities of all words, the unknown
one included, sum to one after every history. A token's history are the words before it in its text, the beginning included,
as far as the order goes.

The corpus is cut into chunks of a bounded number of tokens. A chunk asks, per part of the hash range, for the counts of its
distinct words and n-grams, with its own training counts; a part adds up what all chunks send it and answers each chunk in
the order of its question. So counts are gathered and looked up by the same exchange, no task holds the model, and what moves
grows with the distinct n-grams of the chunks. The chunks are a table bucketed by chunk, so they are not moved.

From order 3 on, most n-grams need no question: one that begins or ends with an n-gram that no other chunk has lies in this
chunk alone, so its count is the chunk's own; one that begins or ends with an n-gram that training lacks has no count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwork.llm.common import Scratch, Texts, blocks, map_runs, mix, settings, text_session

CHUNK_TOKENS = 1_000_000
PART_TOKENS = 1_000_000  # parts: one for so many tokens of the corpus
MOST_DISCOUNTED = 5  # counts above are taken as they are
# A history with more than this share of the training tokens is dealt to several parts, by the words that follow.
HOT = 1 / 512
SALTS = 16
ORDER = 3
ROUNDS = 2  # the questions for n-grams from order 3 on go in so many rounds, which bounds what is shuffled at a time
_END = np.uint64(0xE17A1465D5C7EA8F)
_BEGIN = np.uint64(0xB0B1A5E5C0FFEE11)
_LOW48 = np.uint64((1 << 48) - 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in one compressed block, bytes of equal weight side by side."""
    head, body = [len(arrays)], []
    for a in arrays:
        head += [ord(a.dtype.kind), a.dtype.itemsize, len(a)]
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def unpack(block: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 3 * n)[1:].reshape(n, 3)
    at, out = 8 * (1 + 3 * n), []
    for kind, width, count in head:
        raw = np.frombuffer(data, np.uint8, int(width * count), at).reshape(int(width), int(count)).T
        out.append(np.ascontiguousarray(raw).reshape(-1).view(np.dtype(f"{chr(kind)}{width}")))
        at += int(width * count)
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The numbers in the narrowest unsigned type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are equal stretches of the range of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


@dataclass(frozen=True)
class Discount:
    """Good-Turing factors for the counts 1 to k; larger counts keep theirs."""

    factors: tuple[float, ...]

    @classmethod
    def of(cls, n: list[int]) -> Discount:
        """``n[r]``: how many types occur r times. The largest k up to 5 for which all factors lie between 0 and 1."""
        for k in range(MOST_DISCOUNTED, 0, -1):
            if all(n[r] for r in range(1, k + 2)):
                a = (k + 1) * n[k + 1] / n[1]
                d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)] if a < 1 else [0.0]
                if all(0 < x < 1 for x in d):
                    return cls(tuple(d))
        # Where the counts of counts do not fall as they should, single occurrences alone give mass.
        return cls((n[1] / (n[1] + 2 * n[2]) if n[2] else 0.5,) if n[1] else ())

    def freed(self, n: np.ndarray) -> np.ndarray:
        """Discounted occurrences, from columns of how many types occur 1, 2, ... times."""
        return sum((n[r] * (r + 1) * (1 - d) for r, d in enumerate(self.factors)), np.zeros(n.shape[1:]))

    def counts(self, c: np.ndarray) -> np.ndarray:
        table = np.array([1.0, *self.factors, 1.0])
        return c * table[np.minimum(c, len(self.factors) + 1).astype(np.int64)]


@dataclass(frozen=True)
class Words:
    """The model of single words: tokens, distinct words and discount of the training tokens."""

    tokens: int
    distinct: int
    discount: Discount
    scale: float
    unknown: float

    @classmethod
    def of(cls, tokens: int, distinct: int, n: list[int]) -> Words:
        d = Discount.of(n)
        freed = float(d.freed(np.array(n[1:])[:, None])[0]) / tokens if tokens else 1.0
        if freed > 0:
            return cls(tokens, distinct, d, 1.0, freed)
        return cls(tokens, distinct, d, tokens / (tokens + 1), 1 / (tokens + 1))

    def share(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discount.counts(c) * self.scale / max(self.tokens, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))


class Chunk:
    """Documents with their tokens as numbers into the chunk's words, the most frequent first."""

    def __init__(self, block: bytes):
        self.doc_id, self.no_id, self.length, self.held, self.local, self.words = unpack(block)
        self.local = self.local.astype(np.int64)
        self.end = np.cumsum(self.length.astype(np.int64))
        self.begin = self.end - self.length
        self.train = np.repeat(self.held == 0, self.length)
        self.within = np.arange(len(self.local)) - np.repeat(self.begin, self.length)
        self.by_hash = np.argsort(self.words)
        self.low_rank = _ranks(self.words & _LOW48)

    def word_asks(self, parts: int) -> Iterator[tuple[int, bytes]]:
        h = self.words[self.by_hash]
        count = np.bincount(self.local, self.train, len(self.words)).astype(np.int64)[self.by_hash]
        for p, a, b in _stretches(part_of(h, parts)):
            yield p, pack(h[a:b], small(count[a:b]))

    def word_counts(self, answers: list[bytes]) -> np.ndarray:
        """Training count of each word, from the answers in the order of the parts."""
        out = np.zeros(len(self.words), np.int64)
        out[self.by_hash] = np.concatenate([unpack(x)[0].astype(np.int64) for x in answers])
        return out

    def histories(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and of the beginning, sorted, and each one's number."""
        h = np.append(self.words, _BEGIN)
        order = np.argsort(h)
        return h[order], order

    def history_asks(self, parts: int) -> Iterator[tuple[int, bytes]]:
        h, _ = self.histories()
        for p, a, b in _stretches(part_of(h, parts)):
            yield p, pack(h[a:b])

    def pairs(self, counts: np.ndarray, tokens: int) -> None:
        """Find the distinct pairs; ``order`` sorts them by the part that knows them."""
        n = len(self.words)
        before = np.empty(len(self.local), np.int64)
        before[1:] = self.local[:-1]
        before[self.begin] = n
        self.before = before
        self.keys, self.back = np.unique(before * (n + 1) + self.local, return_inverse=True)
        first, second = self.keys // (n + 1), self.keys % (n + 1)
        h = np.append(self.words, _BEGIN)
        hot = np.append(counts > HOT * tokens, True)
        low = self.words[second] & _LOW48
        # A place per history, or per history and salt; one sort of whole numbers orders the pairs by route and word.
        places, salt = np.flatnonzero(hot), (self.words & _LOW48) % np.uint64(SALTS)
        at = np.arange(n + 1)
        at[places] = n + 1 + SALTS * np.arange(len(places))
        with np.errstate(over="ignore"):
            salted = mix(np.repeat(h[places], SALTS) + np.tile(np.arange(1, SALTS + 1, dtype=np.uint64), len(places)) * np.uint64(0x9E3779B97F4A7C15))
        routes = np.append(h, salted)
        at = at[first] + np.where(hot[first], salt.astype(np.int64)[second], 0)
        self.order = np.argsort(_ranks(routes)[at] * max(n, 1) + self.low_rank[second])
        self.first, self.second, self.low, self.route, self.h = first, second, low, routes[at], h

    def pair_asks(self, counts: np.ndarray, tokens: int, parts: int) -> Iterator[tuple[int, bytes]]:
        self.pairs(counts, tokens)
        train = np.bincount(self.back, self.train, len(self.keys)).astype(np.int64)[self.order]
        first, second, low, route = (x[self.order] for x in (self.first, self.second, self.low, self.route))
        for p, a, b in _stretches(part_of(route, parts)):
            cuts = np.flatnonzero(np.diff(first[a:b], prepend=-1))
            six = low[a:b].view(np.uint8).reshape(-1, 8)[:, :6]
            yield p, pack(self.h[first[a:b][cuts]], small(np.diff(np.append(cuts, b - a))), np.ascontiguousarray(six).reshape(-1), small(train[a:b]), small(counts[second[a:b]]))

    def level_two(self, words: Words, pairs: Discount, answers: dict[int, list[bytes]]) -> Level:
        self.counts = self.word_counts(answers[1])
        self.pairs(self.counts, words.tokens)
        c, alone = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), bool)
        got = [unpack(x) for x in answers[2]]
        c[self.order], alone[self.order] = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        _, order = self.histories()
        got = [unpack(x) for x in answers[3]]
        seen, weight = np.zeros(len(order), np.int64), np.zeros(len(order))
        seen[order], weight[order] = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        # A history all of whose counts are large gives up one occurrence.
        of = np.maximum(seen + (weight < 0), 1)
        share = words.share(self.counts)[self.second]
        p = np.where(c > 0, pairs.counts(c) / of[self.first], np.where(seen[self.first] > 0, np.abs(weight[self.first]), 1.0) * share)
        return Level(self.back, self.second, self.second, mix(self.h[self.first] ^ mix(self.words[self.second])), c, alone, p, of)

    def levels(self, model: Model, answers: dict[int, list[bytes]]) -> list[Level]:
        """The chunk's n-grams of each order, as far as the model knows them."""
        out = [self.level_two(model.words, model.discounts[0], answers)]
        for k in range(1, len(model.discounts)):
            out.append(Grams(self, out[-1], k + 2, model).level(model.discounts[k], model.hot[k - 1], answers.get(k + 3, [])))
        return out

    def gram_asks(self, model: Model, row: dict, parts: int, turn: int = 0, rounds: int = 1) -> Iterator[tuple[int, bytes]]:
        """Questions for the n-grams of the first order that the model does not know yet, to every ``rounds``-th part."""
        levels = self.levels(model, sorted_answers(row))
        grams = Grams(self, levels[-1], len(levels) + 2, model)
        if not turn:
            yield row["chunk"] % parts, pack(np.array(_stats(grams.own[grams.known]), np.int64))
        yield from grams.asks(parts, turn, rounds)

    def scores(self, model: Model, answers: dict[int, list[bytes]]) -> tuple[np.ndarray, ...]:
        """Per document: tokens, known tokens, base score, score."""
        p = np.ones(len(self.local))
        for level in self.levels(model, answers):
            # The highest order whose history the text has decides.
            p = np.where(level.back >= 0, level.share[level.back] if len(level.share) else 1.0, p)
        log, base, known = np.log10(p), model.words.base(self.counts)[self.local], (self.counts > 0)[self.local]
        return self.length, *(np.add.reduceat(x, self.begin) for x in (known.astype(np.int64), base, log))


@dataclass(frozen=True)
class Level:
    """Distinct n-grams of one order in a chunk, and what training says of them."""

    back: np.ndarray  # of each token: the n-gram that it ends, -1 where its text is too short
    suffix: np.ndarray  # the n-gram without its first word, one order below
    last: np.ndarray  # the last word
    hash: np.ndarray
    count: np.ndarray  # in all training documents
    alone: np.ndarray  # no other chunk has it
    share: np.ndarray  # p(last word | the words before)
    of: np.ndarray  # of each n-gram one order below: occurrences that it has to give as a history


@dataclass(frozen=True)
class Model:
    """What all chunks need: the words, a discount per order from 2 on, the sums of hot histories per order from 3 on."""

    words: Words
    discounts: tuple[Discount, ...]
    hot: tuple[tuple[np.ndarray, ...], ...] = ()


class Grams:
    """A chunk's distinct n-grams of an order from 3 on: which of them must be asked for, and where.

    The counts of an n-gram whose first or last n - 1 words no other chunk has are the chunk's own. Of those that lie in a
    history that other chunks have too, the chunk sends their sums per history.
    """

    def __init__(self, chunk: Chunk, lower: Level, order: int, model: Model):
        self.lower, self.discount, n = lower, model.discounts[order - 3], max(len(lower.count), 1)
        at = np.flatnonzero(chunk.within >= order - 2)
        keys, back = np.unique(lower.back[at - 1] * n + lower.back[at], return_inverse=True)
        self.back = np.full(len(chunk.local), -1, np.int64)
        self.back[at] = back
        self.prefix, self.suffix = keys // n, keys % n
        self.last = lower.last[self.suffix]
        self.words = chunk.words
        self.own = np.bincount(back, chunk.train[at], len(keys)).astype(np.int64)
        self.hot = (lower.count > HOT * model.words.tokens) & ~lower.alone
        there, self.home, hot = lower.count[self.prefix] > 0, lower.alone[self.prefix], self.hot[self.prefix]
        self.known = self.home | (lower.alone[self.suffix] & ~hot)
        asked = there & (lower.count[self.suffix] > 0) & ~self.known
        # A row per history; the n-grams of a hot one are dealt to several rows by their last word.
        g = np.flatnonzero(there & ~self.home & (~hot | asked))
        low = self.words[self.last[g]] & _LOW48
        salt = np.where(hot[g], 1 + (low % np.uint64(SALTS)).astype(np.int64), 0)
        code = self.prefix[g] * (SALTS + 1) + salt
        first, row = _distinct(code, "stable")  # they come almost sorted
        rows = code[first]
        self.history, salt = rows // (SALTS + 1), rows % (SALTS + 1)
        h = lower.hash[self.history]
        with np.errstate(over="ignore"):
            route = np.where(salt > 0, mix(h + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)
        by_route = np.argsort(route)
        row, self.history, self.route = _ranks(route, by_route)[row], self.history[by_route], route[by_route]
        a = np.flatnonzero(asked[g])
        a = a[np.argsort(row[a] * max(len(self.words), 1) + chunk.low_rank[self.last[g[a]]])]
        self.asked, self.low, self.per_row = g[a], low[a], np.bincount(row[a], minlength=len(rows))
        # Rows that will need a back-off weight: an n-gram of theirs may be one that training lacks.
        self.need = np.bincount(row, self.own[g] == 0, len(rows)) > 0
        self.g, self.row = g, row

    def kept(self, at: np.ndarray) -> np.ndarray:
        """Discounted counts, one order below, of the last words of these n-grams."""
        return self.discount.counts(self.lower.count[self.suffix[at]])

    def asks(self, parts: int, turn: int, rounds: int) -> Iterator[tuple[int, bytes]]:
        n = len(self.history)
        own = np.flatnonzero(self.known[self.g] & (self.own[self.g] > 0))
        g, row = self.g[own], self.row[own]
        sums = [np.bincount(row, self.own[g] == r, n).astype(np.int64) for r in range(1, MOST_DISCOUNTED + 1)]
        kept = np.bincount(row, self.kept(g), n)
        of, hot = self.lower.of[self.lower.suffix[self.history]], self.hot[self.history]
        h, end = self.lower.hash[self.history], np.concatenate([[0], np.cumsum(self.per_row)])
        count, low = self.own[self.asked], self.lower.count[self.suffix[self.asked]]
        for p, a, b in _stretches(part_of(self.route, parts)):
            if p % rounds != turn:
                continue
            x, y = end[a], end[b]
            six = self.low[x:y].view(np.uint8).reshape(-1, 8)[:, :6]
            per_row = [h[a:b], small(self.per_row[a:b]), small(of[a:b]), hot[a:b], self.need[a:b], *(small(s[a:b]) for s in sums), kept[a:b]]
            yield p, pack(*per_row, np.ascontiguousarray(six).reshape(-1), small(count[x:y]), small(low[x:y]))

    def level(self, discount: Discount, hot: tuple[np.ndarray, ...], answers: list[bytes]) -> Level:
        """The n-grams with the answers to their questions."""
        lower, n = self.lower, len(self.lower.count)
        got = [unpack(x) for x in answers]
        count, alone = np.where(self.known, self.own, 0), self.known.copy()
        freed, share, least = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        of_lower = lower.of[lower.suffix] if n else np.zeros(0, np.int64)
        g = np.flatnonzero(self.home & (self.own > 0))
        freed[:] = np.bincount(self.prefix[g], self.own[g] - discount.counts(self.own[g]), n)
        share[:] = np.bincount(self.prefix[g], self.kept(g), n) / np.maximum(of_lower, 1)
        gives = freed > 0
        if got:
            count[self.asked], alone[self.asked], least = (np.concatenate([x[k] for x in got]) for k in (0, 1, 2))
            gives[self.history] = least <= len(discount.factors)
            needy = self.history[self.need]
            freed[needy] = discount.freed(np.array([np.concatenate([x[k] for x in got]) for k in range(3, 3 + MOST_DISCOUNTED)], np.float64))
            share[needy] = np.concatenate([x[3 + MOST_DISCOUNTED] for x in got])
        if len(hot[0]):
            mine = np.flatnonzero(self.hot)
            at = np.minimum(np.searchsorted(hot[0], lower.hash[mine]), len(hot[0]) - 1)
            mine, at = (x[hot[0][at] == lower.hash[mine]] for x in (mine, at))
            freed[mine], share[mine] = discount.freed(np.array([x[at] for x in hot[1:-1]])), hot[-1][at]
            gives[mine] = freed[mine] > 0
        of = np.maximum(lower.count + ~gives, 1)
        rest = np.maximum(1 - share, 1e-300)
        weight = np.where(lower.count > 0, np.where(gives, freed, 1 / of * lower.count) / (np.maximum(lower.count, 1) * rest), 1.0)
        p = np.where(count > 0, discount.counts(count) / of[self.prefix], weight[self.prefix] * lower.share[self.suffix])
        return Level(self.back, self.suffix, self.last, mix(lower.hash[self.prefix] ^ mix(self.words[self.last])), count, alone, p, of)


def _stats(c: np.ndarray) -> list[int]:
    """Occurrences, distinct ones, and how many occur 1, 2, ... times."""
    return [int(c.sum()), int((c > 0).sum()), *_of_counts(c)]


def sorted_answers(row: dict) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for a in sorted(row["answers"], key=lambda a: (a["level"], a["part"])):
        out.setdefault(a["level"], []).append(a["block"])
    return out


def _ranks(x: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    out[np.argsort(x) if order is None else order] = np.arange(len(x))
    return out


def _distinct(x: np.ndarray, kind: str = "quicksort") -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, in their order, and of each value its number."""
    order = np.argsort(x, kind=kind)
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def _stretches(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(part))):
        yield int(part[a]), int(a), int(b)


def chunked(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """chunk, tokens, payload: the documents' tokens. A document that is longer than a chunk is a chunk of its own."""

    def apply(batches):
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []
        size = 0

        def row():
            nonlocal held, size, made
            tokens = np.concatenate([t for _, _, t in held])
            words, back, count = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ids = np.array([i or 0 for i, _, _ in held], np.int64)
            none = np.array([i is None for i, _, _ in held], np.uint8)
            length = np.array([len(t) for _, _, t in held], np.int64)
            out = np.array([h for _, h, _ in held], np.uint8)
            block = pack(ids, none, length, out, small(rank[back]), words[order])
            made += 1
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([block], pa.binary())], ["chunk", "tokens", "payload"])

        for b in blocks(batches, "text"):
            t = Texts(b.column("text"), lower=True)
            h = t.hashes()
            for k, (i, out) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist())):
                tokens = np.append(h[t.first[k] : t.first[k + 1]], _END)
                if held and size + len(tokens) > chunk_tokens:
                    yield row()
                held.append((i, out, tokens))
                size += len(tokens)
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, "chunk long, tokens long, payload binary")


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 7, is 2. A row without id is a training document."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


_ANSWERS = "kind int, chunk long, part long, block binary, stats array<long>"


def _answer(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _ANSWERS.split(", ")])


def _of_counts(c: np.ndarray) -> list[int]:
    """How many types occur 1, 2, ... times, as far as the discounts ask."""
    return np.bincount(np.minimum(c, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[1 : MOST_DISCOUNTED + 2].tolist()


def _count_words(run: pa.Table) -> pa.Table:
    part = run.column("part")[0].as_py()
    asks = [unpack(x) for x in run.column("block").to_pylist()]
    _, back = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
    c = np.bincount(back, np.concatenate([a[1] for a in asks])).astype(np.int64)
    rows = [(1, -1, part, None, _stats(c))]
    return _answer(rows + _replies(run, asks, part, lambda a, b: (small(c[back[a:b]]),)))


def _replies(run: pa.Table, asks: list, part: int, answer) -> list[tuple]:
    at, rows = 0, []
    for chunk, ask in zip(run.column("chunk").to_pylist(), asks):
        rows.append((0, chunk, part, pack(*answer(at, at + len(ask[-1]))), None))
        at += len(ask[-1])
    return rows


def _count_pairs(words: Words, parts: int):
    def work(run: pa.Table) -> pa.Table:
        part = run.column("part")[0].as_py()
        asks = [unpack(x) for x in run.column("block").to_pylist()]
        first = np.concatenate([np.repeat(a[0], a[1]) for a in asks])
        low = np.zeros((len(first), 8), np.uint8)
        low[:, :6] = np.concatenate([a[2] for a in asks]).reshape(-1, 6)
        at, back = _distinct(mix(first ^ mix(low.reshape(-1).view(np.uint64))))
        c = np.bincount(back, np.concatenate([a[3] for a in asks])).astype(np.int64)
        of_word = np.concatenate([a[4] for a in asks])[at].astype(np.int64)
        seen = c > 0
        rows = [(1, -1, part, None, _stats(c))]
        # What each history needs for its weight; the parts of a hot history send theirs to the part of its hash.
        h, where = np.unique(first[at][seen], return_inverse=True)
        c, share = c[seen], words.share(of_word[seen])
        sums = [h, np.bincount(where, c).astype(np.int64), np.bincount(where, share)] + [np.bincount(where, c == r).astype(np.int64) for r in range(1, MOST_DISCOUNTED + 1)]
        home = part_of(h, parts)
        by_home = np.argsort(home, kind="stable")
        for p, a, b in _stretches(home[by_home]):
            rows.append((2, -1, p, pack(*(x[by_home[a:b]] for x in sums)), None))
        c = np.bincount(back, np.concatenate([a[3] for a in asks])).astype(np.int64)
        alone = np.bincount(back) == 1
        return _answer(rows + _replies(run, asks, part, lambda a, b: (small(c[back[a:b]]), alone[back[a:b]])))

    return work


def _weigh(pairs: Discount):
    """Back-off weights of a part's histories. A negative weight marks a history whose seen words give up one occurrence."""

    def work(run: pa.Table) -> pa.Table | None:
        part = run.column("part")[0].as_py()
        chunks, blocks_ = run.column("chunk").to_pylist(), [unpack(x) for x in run.column("block").to_pylist()]
        sums = [b for k, b in zip(chunks, blocks_) if k < 0]
        asks = [(k, b) for k, b in zip(chunks, blocks_) if k >= 0]
        if not asks:
            return None
        h, total, weight = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        if sums:
            h, back = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
            add = [np.bincount(back, np.concatenate([s[k] for s in sums])) for k in range(1, len(sums[0]))]
            total = np.rint(add[0]).astype(np.int64)
            freed = pairs.freed(np.array(add[2:])) / total
            rest = np.maximum(1 - add[1], 1e-300)
            weight = np.where(freed > 0, freed / rest, -1 / ((total + 1) * rest))
        rows = []
        for chunk, (ask,) in asks:
            at = np.minimum(np.searchsorted(h, ask), max(len(h) - 1, 0))
            hit = h[at] == ask if len(h) else np.zeros(len(ask), bool)
            seen, w = np.zeros(len(ask), np.int64), np.zeros(len(ask))
            seen[hit], w[hit] = total[at[hit]], weight[at[hit]]
            rows.append((0, chunk, part, pack(small(seen), w), None))
        return _answer(rows)

    return work


def _count_grams(lower: Discount):
    """Counts of the n-grams of a part and sums of their histories; the sums of hot histories are parts of a whole."""

    def work(run: pa.Table) -> pa.Table:
        part = run.column("part")[0].as_py()
        got = [(k, unpack(x)) for k, x in zip(run.column("chunk").to_pylist(), run.column("block").to_pylist())]
        rows = [(1, -1, part, None, a[0].tolist()) for _, a in got if len(a) == 1]
        chunks, asks = [k for k, a in got if len(a) > 1], [a for _, a in got if len(a) > 1]
        if not asks:
            return _answer(rows)
        h, per_row, of, hot, need, *sums, kept, six, own, low_count = (np.concatenate(x) for x in zip(*asks))
        history, row = np.unique(h, return_inverse=True)
        n = len(history)
        low = np.zeros((len(own), 8), np.uint8)
        low[:, :6] = six.reshape(-1, 6)
        mine = np.repeat(row, per_row.astype(np.int64))
        at, back = _distinct(mix(history[mine] ^ mix(low.reshape(-1).view(np.uint64))))
        c, alone = np.bincount(back, own, len(at)).astype(np.int64), np.bincount(back, minlength=len(at)) == 1
        rows.append((1, -1, part, None, _stats(c)))
        seen = np.flatnonzero(c)
        owner, c_seen = mine[at[seen]], c[seen]
        of_history = np.ones(n)
        of_history[row] = of
        share = (np.bincount(owner, lower.counts(low_count[at[seen]].astype(np.int64)), n) + np.bincount(row, kept, n)) / of_history
        sums = np.array([np.bincount(owner, c_seen == r, n) + np.bincount(row, s, n) for r, s in enumerate(sums, 1)]).astype(np.int64)
        least = np.where(sums.any(axis=0), sums.astype(bool).argmax(axis=0) + 1, MOST_DISCOUNTED + 1).astype(np.uint8)
        is_hot = np.zeros(n, bool)
        is_hot[row[hot]] = True
        if is_hot.any():
            rows.append((2, -1, part, pack(history[is_hot], *sums[:, is_hot], share[is_hot]), None))
        x = y = 0
        for chunk, ask in zip(chunks, asks):
            grams, mine = back[x : x + len(ask[-1])], row[y : y + len(ask[0])]
            needy = mine[ask[4]]
            reply = pack(small(c[grams]), alone[grams], least[mine], *(small(s[needy]) for s in sums), share[needy])
            rows.append((0, chunk, part, reply, None))
            x, y = x + len(grams), y + len(mine)
        return _answer(rows)

    return work


def _hot_sums(answers: DataFrame) -> tuple[np.ndarray, ...]:
    """Hashes, counts of counts and shares of the hot histories. Fewer than 1 / HOT histories are hot, each in SALTS rows at most."""
    got = [unpack(r.block) for r in answers.filter("kind = 2").select("block").collect()]
    if not got:
        return tuple(np.zeros(0, np.uint64) for _ in range(MOST_DISCOUNTED + 2))
    h, *sums = (np.concatenate(x) for x in zip(*got))
    h, back = np.unique(h, return_inverse=True)
    return h, *(np.bincount(back, s) for s in sums)


def _totals(answers: DataFrame) -> list[int]:
    n = MOST_DISCOUNTED + 3
    row = answers.filter("kind = 1").agg(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()
    return [int(x or 0) for x in row]


def scored(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, part_tokens: int = PART_TOKENS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row (doc_id, text).

    ``order``: words of the longest n-grams, 2 at least. A null or empty text is its end alone. Without training documents every token is unknown and has probability 1. Rows of
    one id are scored apart. An empty table gives an empty table.
    """
    spark = text_session(docs.sparkSession)
    if order < 2:
        raise ValueError("the order is 2 at least")
    # What a step shuffled is of no use once its table is written.
    with settings(spark, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        return _scored(spark, docs, chunk_tokens, part_tokens, order)


def _scored(spark: SparkSession, docs: DataFrame, chunk_tokens: int, part_tokens: int, order: int) -> DataFrame:
    scratch = Scratch(spark, "katz")
    name = f"llm_katz_{uuid.uuid4().hex}"
    scratch.paths["chunks"] = scratch.path("chunks")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunked(docs, chunk_tokens).write.bucketBy(buckets, "chunk").option("path", scratch.path("chunks")).format("parquet").saveAsTable(name)
    chunks = spark.table(name)
    total = chunks.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, -(-total // part_tokens))

    def asking(df: DataFrame, ask) -> DataFrame:
        def apply(batches):
            for b in batches:
                for row in b.to_pylist():
                    got = list(ask(Chunk(row["payload"]), row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p for p, _ in got], pa.int64()), pa.array([row["chunk"]] * len(got), pa.int64()), pa.array([x for _, x in got], pa.binary())], ["part", "chunk", "block"]
                    )

        return df.mapInArrow(apply, "part long, chunk long, block binary")

    def answered(*tables: DataFrame) -> DataFrame:
        """Chunks with the answers that they got, by the exchange that they came from."""
        every = None
        for k, t in enumerate(tables, 1):
            t = t.filter("kind = 0").select("chunk", F.struct(F.lit(k).alias("level"), "part", "block").alias("answer"))
            every = t if every is None else every.union(t)
        return chunks.join(every.groupBy("chunk").agg(F.collect_list("answer").alias("answers")), "chunk")

    asks = asking(chunks, lambda c, _: c.word_asks(parts))
    first = scratch.keep(map_runs(asks, ["part"], _count_words, _ANSWERS), "words")
    tokens, distinct, *n = _totals(first)
    words = Words.of(tokens, distinct, [0, *n])

    asks = asking(answered(first), lambda c, row: c.pair_asks(c.word_counts(sorted_answers(row)[1]), tokens, parts))
    second = scratch.keep(map_runs(asks, ["part"], _count_pairs(words, parts), _ANSWERS), "pairs")
    pairs = Discount.of([0, *_totals(second)[2:]])

    asks = asking(chunks, lambda c, _: c.history_asks(parts)).union(second.filter("kind = 2").select("part", "chunk", "block"))
    third = scratch.keep(map_runs(asks, ["part"], _weigh(pairs), _ANSWERS), "weights")

    model, tables = Model(words, (pairs,)), [first, second, third]
    for k in range(3, order + 1):
        made = None
        for turn in range(ROUNDS):
            asks = asking(answered(*tables), lambda c, row, model=model, turn=turn: c.gram_asks(model, row, parts, turn, ROUNDS))
            counted = scratch.keep(map_runs(asks, ["part"], _count_grams(model.discounts[-1]), _ANSWERS), f"grams-{k}-{turn}")
            made = counted if made is None else made.union(counted)
        tables.append(made)
        model = Model(words, (*model.discounts, Discount.of([0, *_totals(tables[-1])[2:]])), (*model.hot, _hot_sums(tables[-1])))

    def score(batches):
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row["payload"])
                n, known, base, log = c.scores(model, sorted_answers(row))
                ids = pa.array(c.doc_id, pa.int64(), mask=c.no_id.astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(c.held.astype(bool)), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array(log)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = scratch.keep(answered(*tables).mapInArrow(score, schema), "scores")
    spark.sql(f"DROP TABLE {name}")
    scratch.drop("chunks", "words", "pairs", "weights", *[f"grams-{k}-{turn}" for k in range(3, order + 1) for turn in range(ROUNDS)])
    return out
