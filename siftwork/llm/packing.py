"""Packing documents into training sequences by lexical retrieval.

Documents are tokenised, sorted by a min-hash of their token pairs, so that documents that share passages are close, and
cut into shards of a bounded number of tokens. Each shard gets an inverted index with BM25 weights. A document's full
windows are sequences of their own; for what is left, a seed document's window is filled with its best unused neighbours.
The last neighbour is cut where the window ends and its rest is the next seed, so only a shard's last sequence has padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from siftwork.llm.common import Scratch, Texts, blocks, gathered, mix, span_hashes, text_session

WINDOW = 4096
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
SHARD_TOKENS = 1_000_000
TASK_TOKENS = 6_000_000
K1, B = 1.2, 0.75
GATHERED = 2 << 20  # bytes of text whose groups are looked up at once
_CACHED = 1_000_000  # groups that a worker remembers; about 30 bytes each
_JOINED = 1 << 14  # bytes of new groups that one call of the tokenizer gets

# Kinds of bytes. Runs of letters, single digits and runs of marks are one token group each by the vocabulary's rule.
_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[list(range(65, 91)) + list(range(97, 123))] = _LETTER
_KIND[48:58] = _DIGIT
# An apostrophe may begin a group of its own, so words with one are odd, as are words with control characters.
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK
# The letters of Latin-1 are the byte C3 and one of these.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def token_groups(t: Texts, added: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, the start and end of each token group, and whether a group is a whole odd word.

    A word that holds anything but ASCII letters, digits and marks and Latin-1 letters is one group in its own spelling,
    as is one that may hold one of the ``added`` tokens.
    """
    data, n = t.data, len(t.data)
    kind = _KIND[data]
    pair = np.zeros(n, bool)
    if n > 1:
        pair[:-1] = (data[:-1] == 0xC3) & _SECOND[data[1:]]
        second = np.flatnonzero(pair) + 1
        kind[pair] = _LETTER
        kind[second] = _LETTER
        for a, b in {tuple(token.encode()[:2]) for token in added}:
            kind[:-1][(data[:-1] == a) & (data[1:] == b)] = _ODD
    kind[~t.word_bytes] = 0
    total = np.concatenate([[0], np.cumsum(kind == _ODD)])
    odd = total[t.ends] > total[t.starts]
    small = _SMALL[data]
    if n > 1:
        large = second[data[second] < 0x9F]
        small[large] = data[large] + 32
    if odd.any():
        turn = np.zeros(n + 1, np.int8)
        turn[t.starts[odd]] += 1
        turn[t.ends[odd]] -= 1
        inside = np.cumsum(turn[:-1], dtype=np.int8).astype(bool)
        kind[inside] = _ODD
        small[inside] = data[inside]
    new = kind == _DIGIT
    new[1:] |= kind[1:] != kind[:-1]
    new[:1] = True
    new &= t.word_bytes
    new[t.starts] = True
    last = t.word_bytes.copy()
    last[:-1] &= new[1:] | ~t.word_bytes[1:]
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    return small, starts, ends, kind[starts] == _ODD


class _Known:
    """Lists of ids under 64-bit hashes: two sorted arrays of hashes, the newer one merged when it has grown, and a pool of ids."""

    def __init__(self, kind: np.dtype):
        self.count = 0
        self.levels = [self._level(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.pool, self.used = np.zeros(1 << 16, kind), 0

    @staticmethod
    def _level(keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], at[order], size[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each key begin in the pool (-1: unknown), and how many they are."""
        at, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for own, where, many in self.levels:
            if len(own):
                place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[place] == keys
                at[hit], size[hit] = where[place[hit]], many[place[hit]]
        return at, size

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Keys that are missing, with their ids one behind the other."""
        end = self.used + len(ids)
        if end > len(self.pool):
            pool = np.zeros(max(end, 2 * len(self.pool)), self.pool.dtype)
            pool[: self.used] = self.pool[: self.used]
            self.pool = pool
        self.pool[self.used : end] = ids
        fresh = (keys, self.used + np.cumsum(size) - size, size)
        self.used, self.count = end, self.count + len(keys)
        old, new = self.levels[0], tuple(np.concatenate(x) for x in zip(self.levels[1], fresh))
        if len(new[0]) * 4 > len(old[0]):
            old, new = tuple(np.concatenate(x) for x in zip(old, new)), tuple(x[:0] for x in new)
            old = self._level(*old)
        self.levels = [old, self._level(*new)]


class WordIds:
    """Token ids of texts, group by group: groups of a kind end at other kinds and at white space, so each is tokenised once
    and remembered under a 64-bit hash.

    Give ``by_word=False`` for a tokenizer whose tokens may reach over white space or over kinds of characters.
    """

    def __init__(self, path: str, by_word: bool = True):
        self.path, self.by_word = path, by_word
        self.tokenizer = None

    def __getstate__(self):
        return {"path": self.path, "by_word": self.by_word, "tokenizer": None}

    def load(self) -> None:
        if self.tokenizer is None:
            # Spark's tasks are the parallelism; the library's own threads would compete with them.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            vocabulary = self.tokenizer.get_vocab()
            self.type = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
            self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
            # A group's last token says so.
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            self.known = _Known(self.type)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and how many each has."""
        flat, size = [np.zeros(0, self.type)], [np.zeros(0, np.int64)]
        # The tokenizer's result for a text is far larger than its ids, so few are alive at a time.
        for k in range(0, len(texts), 2000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + 2000], add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(ids), self.type))
            size.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        return np.concatenate(flat), np.concatenate(size)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Groups that are not odd, many in one text with spaces between them."""
        length = ends - starts + 1
        behind = np.cumsum(length)
        joined = np.append(data, np.uint8(32))[np.minimum(np.arange(behind[-1]) + np.repeat(starts - behind + length, length), len(data))]
        joined[behind - 1] = 32
        at = 0
        while at < len(keys):
            begin = behind[at] - length[at]
            end = max(at + 1, int(np.searchsorted(behind, begin + _JOINED, "right")))
            ids = np.array(self.tokenizer.encode(joined[begin : behind[end - 1]].tobytes().decode(), add_special_tokens=False).ids, self.type)
            last = np.flatnonzero(self.closes[ids])
            if len(last) != end - at or not len(ids) or last[-1] != len(ids) - 1:
                # A vocabulary that does not close its groups.
                text = joined.tobytes()
                ids, size = self._encode([text[b - n : b - 1].decode() for b, n in zip(behind[at:end], length[at:end])])
            else:
                size = np.diff(last, prepend=-1)
            self.known.add(keys[at:end], ids, size)
            at = end

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        self.load()
        if not self.by_word:
            ids, size = self._encode([t or "" for t in column.to_pylist()])
            return np.split(ids, np.cumsum(size)[:-1])
        t = Texts(column)
        data, starts, ends, odd = token_groups(t, self.added)
        # An odd word's hash is of its own kind: "K" is not "k".
        back, keys = pd.factorize(span_hashes(data, starts, ends) ^ odd.astype(np.uint64))
        order = np.argsort(keys)  # a search in order is several times faster
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        keys, back = keys[order], rank[back]
        at, size = self.known.find(keys)
        new = at < 0
        if new.any():
            if self.known.count + int(new.sum()) > _CACHED:
                self.known = _Known(self.type)
                new[:] = True
            first = np.zeros(len(keys), np.int64)
            first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
            plain, strange = (np.flatnonzero(new & x) for x in (~odd[first], odd[first]))
            if len(plain):
                plain = plain[np.argsort(first[plain])]
                self._learn(keys[plain], data, starts[first[plain]], ends[first[plain]])
            if len(strange):
                self.known.add(keys[strange], *self._encode([data[a:b].tobytes().decode() for a, b in zip(starts[first[strange]], ends[first[strange]])]))
            at, size = self.known.find(keys)
        at, size = at[back], size[back]
        behind = np.cumsum(size)
        total = int(behind[-1]) if len(behind) else 0
        tokens = self.known.pool[np.arange(total) + np.repeat(at - behind + size, size)]
        cuts = np.concatenate([[0], behind])[np.searchsorted(starts, t.offsets)]
        return [tokens[a:b] for a, b in zip(cuts, cuts[1:])]


def tokenised(docs: DataFrame, ids_of: WordIds, end_id: int = END_ID) -> DataFrame:
    """doc_id, n (tokens, the end included), place (the min-hash that sorts), ids (compressed)."""

    def apply(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in blocks(gathered(batches, "text", GATHERED), "text", GATHERED):
            n, place, ids = [], [], []
            for got in ids_of(b.column("text")):
                tokens = np.append(got, ids_of.type.type(end_id))
                n.append(len(tokens))
                pairs = tokens.astype(np.uint64)
                pairs = pairs[:-1] << np.uint64(32) | pairs[1:] if len(pairs) > 1 else pairs
                place.append(int(mix(pairs).min() >> np.uint64(1)))
                ids.append(pack.compress(tokens.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(place, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "place", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, n long, place long, ids binary")


class Index:
    """Inverted index of a shard's documents: postings by term, each with its BM25 weight."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        size = np.array([len(d) for d in docs])
        terms, flat = np.unique(np.concatenate(docs), return_inverse=True)
        key, tf = np.unique(flat.astype(np.int64) * n + np.repeat(np.arange(n), size), return_counts=True)
        term, self.doc = key // n, key % n
        df = np.bincount(term, minlength=len(terms))
        # The weight of a term that half of the documents have is 0 in BM25, so such postings are not needed.
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / size.mean()))
        use = weight > 0
        term, self.doc, self.weight = term[use], self.doc[use], weight[use]
        self.begin = np.searchsorted(term, np.arange(len(terms) + 1))
        by_doc = np.argsort(self.doc, kind="stable")
        self.terms, self.of = term[by_doc], np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for the distinct terms of the seed."""
        terms = self.terms[self.of[seed] : self.of[seed + 1]]
        low, count = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        at = np.arange(int(count.sum())) + np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(terms) else np.zeros(0, np.int64)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def packed(sizes: list[int], rests: Index | None, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length). ``rests`` indexes what is left of the documents behind their full windows."""
    out = []
    start = np.zeros(len(sizes), np.int64)
    for i, n in enumerate(sizes):
        for k in range(n // window):
            out.append([(i, k * window, window)])
        start[i] = n // window * window
    left = np.array(sizes, np.int64) - start
    seed = None
    following = 0
    while True:
        if seed is None:
            while following < len(left) and not left[following]:
                following += 1
            if following == len(left):
                return out
            seed = following
        ranked = np.where(left > 0, rests.scores(seed), -1.0)
        ranked[seed] = np.inf
        sequence, room = [], window
        cut = None
        order = np.argsort(-ranked, kind="stable")
        # Enough of the ranking to fill the window.
        order = order[: np.searchsorted(np.cumsum(left[order]), window) + 1]
        for i in order[left[order] > 0]:
            n = int(min(left[i], room))
            sequence.append((int(i), int(start[i]), n))
            start[i] += n
            left[i] -= n
            room -= n
            if left[i]:
                cut = int(i)
            if not room:
                break
        out.append(sequence)
        seed = cut


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    task_tokens: int = TASK_TOKENS,
    with_ids: bool = False,
    by_word: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked).

    A document is its tokens and the end id; a null or empty text is the end id alone. Every row of ``docs`` is packed,
    repeated ones too. Of a shard's sequences only the last is shorter than the window. An empty table gives no piece.
    """
    spark = text_session(docs.sparkSession)
    scratch = Scratch(spark, "pack")
    ids_of = WordIds(tokenizer, by_word)
    tokens = scratch.keep(tokenised(docs, ids_of, end_id), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0

    def fill(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        unpack = zstandard.ZstdDecompressor()
        ids_of.load()
        sequences = 0
        held, size = [], 0

        def shard():
            nonlocal sequences
            docs = [np.frombuffer(unpack.decompress(x), ids_of.type).astype("<u4") for _, _, x in held]
            rests = [d[len(d) // window * window :] for d in docs]
            made = packed([len(d) for d in docs], Index(rests) if sum(map(len, rests)) else None, window)
            rows = []
            for sequence in made:
                offset = 0
                for i, start, n in sequence:
                    ids = docs[i][start : start + n]
                    rows.append((held[i][0], start, n, zlib.crc32(ids.tobytes()), len(docs[i]), first + sequences, offset, *([ids.astype(np.int32)] if with_ids else [])))
                    offset += n
                sequences += 1
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        types = [pa.int64()] * 7 + [pa.list_(pa.int32())]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if with_ids else [])
        for b in batches:
            for row in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist()):
                if held and size + row[1] > shard_tokens:
                    yield shard()
                    held, size = [], 0
                held.append(row)
                size += row[1]
        if held:
            yield shard()

    parts = max(1, -(-total // task_tokens))
    # The id splits a hash that very many documents share.
    rows = tokens.repartitionByRange(parts, "place", "doc_id").sortWithinPartitions("place", "doc_id")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(fill, schema + (", ids array<int>" if with_ids else ""))
