"""Language identification by interpolated Kneser-Ney character models.

The models count the words (runs of letters, lower-cased) of all labelled documents: tasks count n-grams and a shuffle adds
them up. Where the distinct n-grams fit a budget, the driver builds the models: sorted arrays of 64-bit hashes, one array per
order for all languages together, with a row of log probabilities per n-gram. Where they do not, tasks write the counts of all
orders in sorted files of the shared folder, which the scoring tasks map into memory. A text's language is the one with the lowest cross-entropy per character; a text whose entropy is
out of line with that of known texts of the language is marked as rejected, at a calibrated rate.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from siftwork.llm.common import Scratch, _tables, blocks, mix, text_session

ORDER = 5
# The training documents are split in this proportion for the rejection: models of the one part score the other.
COUNTED_PARTS, CALIBRATION_PARTS = 2, 3
MODEL_BYTES = 32 << 20  # of the n-grams of the highest order, a row of all languages each; larger models lie in files
SHARD_ROWS = 1_000_000  # rows of a file, 28 bytes each
STORED_WORDS = 10_000  # words that are looked up in files at once
_READ = 4  # files that a worker keeps where it cannot map them
GRID = 4096  # steps per nat that the strangeness of calibration documents is rounded up to
HELD_GRAMS = 100_000  # n-grams that a task adds up before they are shuffled
BLOCK_BYTES = 512 << 10  # of text that are worked on at once
REJECTED = 0.002  # share of a language's documents that may be rejected
ALPHABET = 5000  # characters over which the lowest order is spread
EVIDENCE = 40  # characters that the confidence takes as independent, at most
_BEGIN, _END = 1, 2  # code points that stand for a word's edges
_CACHED = 400_000  # words whose scores a worker remembers

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTERS


def letter_runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, begin and end of each word, and number of the first word of each text (total at the end)."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le"), np.uint32)
    letter = np.zeros(len(points) + 2, bool)
    letter[1:-1] = _letters()[points]
    change = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = change[::2], change[1::2]
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    return points, starts, ends, np.searchsorted(starts, at)


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            end = max(at + 1, int(np.searchsorted(ends, low + (1 << 19), "right")))
            high = ends[end - 1]
            up, down = _tables(int(high - low) + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum((points[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
            s, e = starts[at:end] - low, ends[at:end] - low
            out[at:end] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            at = end
    return mix(out)


def sequences(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with begin marks before and an end mark behind, the places of the predicted characters (a word's letters
    and its end), and the number of each one's word."""
    size = ends - starts
    length = size + order  # order - 1 begin marks, the word, an end mark
    first = np.concatenate([[0], np.cumsum(length)])
    seq = np.full(first[-1], _BEGIN, np.uint32)
    inside = np.arange(int(size.sum())) + np.repeat(first[:-1] + order - 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    source = np.arange(int(size.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    seq[inside] = points[source]
    seq[first[1:] - 1] = _END
    predicted = np.arange(int((size + 1).sum())) + np.repeat(first[:-1] + order - 1 - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1)
    return seq, predicted, np.repeat(np.arange(len(size)), size + 1)


def _hashes(seq: np.ndarray, predicted: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the n-grams that end at each place and of their contexts, for n from 1 to ``order``."""
    spread = mix(seq.astype(np.uint64) + np.uint64(7))
    gram, context = [], []
    with np.errstate(over="ignore"):
        h, c = np.zeros(len(predicted), np.uint64), np.zeros(len(predicted), np.uint64)
        step = np.uint64(1)
        for n in range(order):
            context.append(c + np.uint64(n))
            h = h + spread[predicted - n] * step
            gram.append(mix(h + np.uint64(n)))
            if n + 1 < order:
                c = mix(c + spread[predicted - n - 1] * np.uint64(2 * n + 3))
                step = step * np.uint64(0x9E3779B97F4A7C15)
    return gram, context


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each predicted character: hashes of the n-grams that end with it, of their contexts, and the number of the word."""
    seq, predicted, word = sequences(points, starts, ends, order)
    return *_hashes(seq, predicted, order), word


def gram_hashes(points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same hashes of n-grams that are given as rows of code points."""
    count, order = points.shape
    return _hashes(points.ravel(), np.arange(count) * order + order - 1, order)


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted array, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Models:
    """Sorted hashes and, per hash, a row with a column per language."""

    langs: list[str]
    order: int
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    floor: np.ndarray
    limits: list[float]

    def word_logs(self, points, starts, ends) -> np.ndarray:
        """Natural log probability of each word, its end included, in each language."""
        gram, context, word = grams(points, starts, ends, self.order)
        at = find(self.grams[0], gram[0])
        now = np.where(at[:, None] >= 0, self.logs[0][at], self.floor)
        for n in range(1, self.order):
            ctx, at = find(self.contexts[n], context[n]), find(self.grams[n], gram[n])
            now = np.where(at[:, None] >= 0, self.logs[n][at], now + np.where(ctx[:, None] >= 0, self.backoffs[n][ctx], 0))
        begin = np.concatenate([[0], np.cumsum(ends - starts + 1)[:-1]])
        return np.add.reduceat(now, begin, axis=0).astype(np.float32) if len(begin) else np.zeros((0, len(self.langs)), np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language, and the number of characters (0: no letter)."""
        points, starts, ends, first = letter_runs(texts)
        out = np.zeros((len(texts), len(self.langs)))
        chars = np.concatenate([[0], np.cumsum(ends - starts + 1)])[first]
        chars = np.diff(chars)
        if len(starts):
            known, index, back = np.unique(word_hashes(points, starts, ends), return_index=True, return_inverse=True)
            logs = self._remembered(known, points, starts[index], ends[index])
            total = np.zeros((len(starts) + 1, len(self.langs)))
            np.cumsum(logs[back], axis=0, dtype=np.float64, out=total[1:])
            out = -(total[first[1:]] - total[first[:-1]]) / np.maximum(chars, 1)[:, None]
        return out, chars

    def _remembered(self, keys, points, starts, ends) -> np.ndarray:
        cache = self.__dict__.setdefault("cache", (np.zeros(0, np.uint64), np.zeros((0, len(self.langs)), np.float32)))
        at = find(cache[0], keys)
        new = np.flatnonzero(at < 0)
        out = np.empty((len(keys), len(self.langs)), np.float32)
        out[at >= 0] = cache[1][at[at >= 0]]
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            out[part] = self.word_logs(points, starts[part], ends[part])
        if len(new):
            if len(cache[0]) + len(new) > _CACHED:
                cache = (keys[new], out[new]) if len(new) <= _CACHED else (keys[:0], out[:0])
            else:
                place = np.searchsorted(cache[0], keys[new])
                cache = (np.insert(cache[0], place, keys[new]), np.insert(cache[1], place, out[new], axis=0))
            self.__dict__["cache"] = cache
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence and rejection of each text; ``und`` without a letter or without any model."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, chars = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h.min(axis=1)
        share = np.exp(-(h - low[:, None]) * np.minimum(chars, EVIDENCE)[:, None])
        score = np.where(chars > 0, 1 / share.sum(axis=1), 0.0)
        limit = np.array(self.limits)[best]
        rejected = (chars == 0) | (strangeness(low, chars) > limit)
        return ["und" if c == 0 else self.langs[b] for b, c in zip(best, chars)], score, rejected


def _key(h: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of n-grams or contexts of one order as keys of the files that hold all of them."""
    with np.errstate(over="ignore"):
        return mix(h + np.uint64(kind + 1) * np.uint64(0x9E3779B97F4A7C15))


class Counts:
    """Rows (key, language, two numbers) in files of the shared folder, sorted by key; a key's rows are in one file."""

    def __init__(self, paths: list[str], lows: list[int]):
        self.paths, self.lows, self.open = paths, np.array(lows, np.uint64), {}

    def __getstate__(self):
        return {"paths": self.paths, "lows": self.lows, "open": {}}

    def file(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if k not in self.open:
            fs, at = pyarrow.fs.FileSystem.from_uri(self.paths[k])
            if isinstance(fs, pyarrow.fs.LocalFileSystem):
                data = np.memmap(at, np.uint8, "r")
            else:
                while len(self.open) >= _READ:
                    del self.open[next(iter(self.open))]
                with fs.open_input_file(at) as f:
                    data = np.frombuffer(f.readall(), np.uint8)
            n = int(data[:8].view(np.uint64)[0])
            parts = data[8 : 8 + 8 * n].view(np.uint64), data[8 + 24 * n :].view(np.int32), data[8 + 8 * n : 8 + 16 * n].view(np.int64), data[8 + 16 * n : 8 + 24 * n].view(np.int64)
            self.open[k] = parts
        return self.open[k]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows of all keys: number of the key, language, and the two numbers."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        of = np.searchsorted(self.lows, keys, "right") - 1
        for k in np.unique(of[of >= 0]):
            mine = np.flatnonzero(of == k)
            key, lang, a, b = self.file(int(k))
            begin, end = np.searchsorted(key, keys[mine]), np.searchsorted(key, keys[mine], "right")
            at = np.arange((end - begin).sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin)
            out.append((np.repeat(mine, end - begin), lang[at], a[at], b[at]))
        return tuple(np.concatenate(x) for x in zip(*out))


class StoredModels(Models):
    """The same models without tables in memory: probabilities come from the counts of the n-grams and of their contexts."""

    def __init__(self, langs: list[str], order: int, discounts: np.ndarray, counts: Counts, alphabet: int):
        self.langs, self.order, self.limits = langs, order, [math.inf] * len(langs)
        self.discounts, self.counts, self.alphabet = discounts, counts, alphabet

    def _numbers(self, h: np.ndarray, kind: int) -> np.ndarray:
        """Both numbers of each hash in each language, 0 where it does not occur."""
        keys, back = np.unique(_key(h, kind), return_inverse=True)
        key, lang, a, b = self.counts.find(keys)
        out = np.zeros((2, len(keys), len(self.langs)))
        out[0, key, lang], out[1, key, lang] = a, b
        return out[:, back]

    def word_logs(self, points, starts, ends) -> np.ndarray:
        out = [np.zeros((0, len(self.langs)), np.float32)]
        for a in range(0, len(starts), STORED_WORDS):
            some, till = starts[a : a + STORED_WORDS], ends[a : a + STORED_WORDS]
            gram, context, word = grams(points, some, till, self.order)
            p = np.full((len(word), len(self.langs)), 1 / self.alphabet)
            for n, d in enumerate(self.discounts):
                times, (total, types) = self._numbers(gram[n], 2 * n)[0], self._numbers(context[n], 2 * n + 1)
                p = np.where(total > 0, (np.maximum(times - d, 0) + d * types * p) / np.maximum(total, 1), p)
            out.append(np.add.reduceat(np.log(p), np.concatenate([[0], np.cumsum(till - some + 1)[:-1]]), axis=0).astype(np.float32))
        return np.concatenate(out)


def strangeness(entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Entropy less what short texts may have more; comparable between lengths."""
    return entropy - 3.0 / np.sqrt(np.maximum(chars, 1))


def _levels(gram: list[np.ndarray], context: list[np.ndarray], count: np.ndarray) -> list[tuple]:
    """Per order the sorted n-grams of one language, with discounted probabilities, contexts and back-off weights."""
    order = len(gram)
    levels: list = [None] * order
    key, at, back = np.unique(gram[-1], return_index=True, return_inverse=True)
    times = np.bincount(back, count)
    for n in range(order - 1, -1, -1):
        ctx, where = np.unique(context[n][at], return_inverse=True)
        total, types = np.bincount(where, times), np.bincount(where)
        once, twice = (times == 1).sum(), (times == 2).sum()
        d = once / (once + 2 * twice) if once else 0.5
        levels[n] = (key, context[n][at], gram[n - 1][at] if n else None, np.maximum(times - d, 0) / total[where], ctx, d * types / total)
        if n:
            # Below the top an n-gram counts once for each character seen before it.
            key, first, times = np.unique(gram[n - 1][at], return_index=True, return_counts=True)
            at, times = at[first], times.astype(np.float64)
    return levels


def build(words: dict[str, list[tuple[str, int]]], order: int = ORDER, alphabet: int = ALPHABET) -> Models:
    """Models of the languages' words and their counts."""
    each = {}
    for lang in words:
        texts, count = [w for w, _ in words[lang]], np.array([c for _, c in words[lang]], np.float64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(w) for w in texts])
        gram, context, word = grams(points, ends - np.array([len(w) for w in texts]), ends, order)
        each[lang] = _levels(gram, context, count[word])
    return merged(each, order, alphabet)


def build_grams(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, alphabet: int = ALPHABET) -> Models:
    """Models of the languages' distinct n-grams (rows of ``order`` code points) and their counts."""
    each = {lang: _levels(*gram_hashes(points), times.astype(np.float64)) for lang, (points, times) in counts.items()}
    return merged(each, order, alphabet)


def merged(models: dict[str, list[tuple]], order: int, alphabet: int) -> Models:
    """The levels of all languages in tables with a column per language."""
    langs = sorted(models)
    if not langs:
        return Models([], order, [], [], [], [], np.zeros(0), [])
    each = [models[lang] for lang in langs]
    out_grams, out_logs, out_ctx, out_back = [], [], [], []
    floor = np.array([math.log(levels[0][5][0] / alphabet) for levels in each])
    for n in range(order):
        every = np.concatenate([levels[n][0] for levels in each])
        keys, index = np.unique(every, return_index=True)
        ctx = np.concatenate([levels[n][1] for levels in each])[index]
        contexts = np.unique(np.concatenate([levels[n][4] for levels in each]))
        backs = np.zeros((len(contexts), len(langs)))
        for k, levels in enumerate(each):
            backs[np.searchsorted(contexts, levels[n][4]), k] = np.log(np.maximum(levels[n][5], 1e-12))
        if n:
            below = np.concatenate([levels[n][2] for levels in each])[index]
            lower = np.exp(out_logs[-1][np.searchsorted(out_grams[-1], below)])
        else:
            lower = np.full((len(keys), len(langs)), 1 / alphabet)
        p = np.exp(backs[np.searchsorted(contexts, ctx)]) * lower
        for k, levels in enumerate(each):
            p[np.searchsorted(keys, levels[n][0]), k] += levels[n][3]
        out_grams.append(keys), out_logs.append(np.log(p)), out_ctx.append(contexts), out_back.append(backs)
    return Models(langs, order, out_grams, [x.astype(np.float32) for x in out_logs], out_ctx, [x.astype(np.float32) for x in out_back], floor, [math.inf] * len(langs))


def training_fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def limits_of(low: dict[str, list[float]], langs: list[str], rejected: float = REJECTED, alphabet: int = ALPHABET, times: dict[str, list[int]] | None = None) -> list[float]:
    """The highest strangeness that each language accepts, from the sorted ones of its calibration documents.

    ``times`` says how often each value occurs; without it, once. Of n + 1 exchangeable documents the new one ranks above a
    place with a known probability. A language with too few documents for the stated one takes its largest and a margin: the
    rest of the way down an exponential tail, whose scale is the mean excess over the median in the language or in all
    languages, whichever is larger. A language without calibration documents has the highest limit of the others, or the
    entropy of a blind guess.
    """
    values = {lang: np.array(x, np.float64) for lang, x in low.items() if len(x)}
    behind = {lang: np.cumsum(times[lang]) if times else np.arange(1, len(x) + 1) for lang, x in values.items()}
    size = {lang: int(b[-1]) for lang, b in behind.items()}

    def ranked(lang: str, rank: int) -> float:
        """The value of a rank from 1."""
        return float(values[lang][np.searchsorted(behind[lang], rank)])

    excess = {}  # its sum in each language
    for lang, x in values.items():
        median = (ranked(lang, (size[lang] + 1) // 2) + ranked(lang, size[lang] // 2 + 1)) / 2
        excess[lang] = float((np.maximum(x - median, 0) * np.diff(behind[lang], prepend=0)).sum())
    # Half of the documents have no excess over the median.
    pooled = 2 * sum(excess.values()) / sum(size.values()) if values else 0.0
    out = {}
    for lang, n in size.items():
        place = math.ceil((n + 1) * (1 - rejected))
        if place <= n:
            out[lang] = ranked(lang, place)
        else:
            out[lang] = ranked(lang, n) + max(2 * excess[lang] / n, pooled) * max(math.log(1 / ((n + 1) * rejected)), 0.0)
    other = max(out.values(), default=math.log(alphabet))
    return [out.get(lang, other) for lang in langs]


def _counted(order: int):
    """Batches of (lang, counts, text) to n-grams of the words with their numbers: in all texts, and in those of the
    counts' part. What a task holds of them is bounded; the same n-gram may come several times."""

    def added(held: list[tuple]) -> tuple:
        """Equal n-grams of equal languages as one."""
        key, points, name, n, first = (np.concatenate(x) for x in zip(*held))
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        return key[at], points[at], name[at], np.bincount(back, n).astype(np.int64), np.bincount(back, first).astype(np.int64)

    def rows(part: tuple, names: list[str]) -> pa.RecordBatch:
        _, points, name, n, first = part
        flat = points.astype("<u4").tobytes().decode("utf-32-le")
        gram = [flat[i : i + order] for i in range(0, len(flat), order)]
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in name], pa.string()), pa.array(gram, pa.string()), pa.array(n), pa.array(first)], ["lang", "gram", "n", "first"])

    def apply(batches):
        names: list[str] = []
        number: dict[str, int] = {}
        held, size = [], 0
        for b in blocks(batches, "text", BLOCK_BYTES):
            points, starts, ends, first = letter_runs(b.column("text").to_pylist())
            if not len(starts):
                continue
            for lang in b.column("lang").unique().to_pylist():
                if lang not in number:
                    number[lang] = len(names)
                    names.append(lang)
            lang = np.array([number[x] for x in b.column("lang").to_pylist()])
            of = np.repeat(np.arange(len(lang)), np.diff(first))
            kind = 2 * lang[of] + b.column("counts").to_numpy(zero_copy_only=False)[of]
            with np.errstate(over="ignore"):
                h = mix(word_hashes(points, starts, ends) + kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, at, times = np.unique(h, return_index=True, return_counts=True)
            seq, predicted, word = sequences(points, starts[at], ends[at], order)
            gram = _hashes(seq, predicted, order)[0][-1]
            kind, times = kind[at][word], times[word]
            with np.errstate(over="ignore"):
                key = mix(gram + (kind // 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            held.append(added([(key, seq[predicted[:, None] + np.arange(1 - order, 1)], kind // 2, times, times * (kind % 2))]))
            size += len(held[-1][0])
            if size > HELD_GRAMS:
                held = [added(held)]
                size = len(held[0][0])
                if size > HELD_GRAMS // 2:
                    yield rows(held[0], names)
                    held, size = [], 0
        if held:
            yield rows(added(held), names)

    return apply


def _points(grams: pa.Array, order: int) -> np.ndarray:
    return np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, order)


def stored(counted: DataFrame, times: str, order: int, scratch: Scratch, label: str, alphabet: int = ALPHABET) -> StoredModels:
    """Models of any number of distinct n-grams (lang, gram, ``times``), built by tasks: each order's n-grams are counted in
    those of the next, and all of them and their contexts go to files by ranges of their hash."""
    spark = scratch.spark
    level = counted.filter(F.col(times) > 0).select("lang", "gram", F.col(times).alias("n"))
    langs = sorted(r.lang for r in level.select("lang").distinct().collect())
    numbers = spark.createDataFrame(list(enumerate(langs)), "lang_no int, lang string")
    level = level.join(F.broadcast(numbers), "lang").select("lang_no", "gram", "n")

    def hashed(n: int):
        def apply(batches):
            for b in batches:
                gram, context = gram_hashes(_points(b.column("gram"), n))
                keys = [pa.array(_key(h, kind).view(np.int64)) for h, kind in ((gram[-1], 2 * n - 2), (context[-1], 2 * n - 1))]
                yield pa.RecordBatch.from_arrays([b.column("lang_no"), *keys, b.column("n")], ["lang_no", "gram", "context", "n"])

        return apply

    discounts, names = np.zeros((order, len(langs))), []
    for n in range(order, 0, -1):
        for r in level.groupBy("lang_no").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
            discounts[n - 1, r.lang_no] = r.once / (r.once + 2 * r.twice) if r.once else 0.5
        keys = level.mapInArrow(hashed(n), "lang_no int, gram long, context long, n long")
        own = keys.select(F.col("gram").alias("key"), "lang_no", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
        contexts = keys.groupBy(F.col("context").alias("key"), "lang_no").agg(F.sum("n").alias("a"), F.count("*").alias("b"))
        names.append(f"{label}-rows-{n}")
        rows = scratch.keep(own.union(contexts), names[-1])
        every = rows if n == order else every.union(rows)
        if n > 1:
            # Below the top an n-gram counts once for each character seen before it.
            level = scratch.keep(level.groupBy("lang_no", F.substring("gram", 2, n - 1).alias("gram")).agg(F.count("*").alias("n")), f"{label}-{n - 1}")
    root = scratch.path(f"{label}-files")

    def write(batches):
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        key, lang, a, b = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("at", "lang_no", "a", "b"))
        key = key.view(np.uint64) ^ np.uint64(1 << 63)
        task = TaskContext.get()
        to = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        fs, at = pyarrow.fs.FileSystem.from_uri(to)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(at) as f:
            f.write(struct.pack("<Q", len(key)) + key.tobytes())
            f.write(a.tobytes() + b.tobytes() + lang.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([str(int(key[0]))])], ["path", "low"])

    # Sorting signed numbers with the top bit turned sorts the hashes.
    turned = every.select(F.col("key").bitwiseXOR(F.lit(-(1 << 63))).alias("at"), "lang_no", "a", "b")
    turned = turned.repartitionByRange(max(1, -(-every.count() // SHARD_ROWS)), "at").sortWithinPartitions("at")
    # One row per file; only the files that this table names belong to the models.
    files = scratch.keep(turned.mapInArrow(write, "path string, low string"), f"{label}-manifest").collect()
    files = sorted((int(r.low), r.path) for r in files)
    scratch.drop(*names, *(f"{label}-{n}" for n in range(1, order)))
    return StoredModels(langs, order, discounts, Counts([p for _, p in files], [low for low, _ in files]), alphabet)


def learn(docs: DataFrame, sample: int = COUNTED_PARTS, calibration: int = CALIBRATION_PARTS, order: int = ORDER, rejected: float = REJECTED, model_bytes: int | None = None, whole: bool = False) -> Models:
    """Models of all languages of the training fold (doc_id, text, lang), or of the whole table.

    All documents of the fold give the counts; with ``whole`` all rows do, those without id too. For the rejection they are
    split by a hash of their id in the proportion of ``sample`` to ``calibration``: models of the one part score all of the
    other. These models know less than the final ones, so the limits are on the lenient side. All n-grams of the order
    count, however many they are; only a caller that gives ``model_bytes`` gets the highest order up to ``order`` whose
    n-grams fit them, with counts that are sums of those of the higher one. Rows without text or language teach nothing,
    nor without ``whole`` those without id.
    """
    spark = text_session(docs.sparkSession)
    scratch = Scratch(spark, "langid")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("lang is not null and text is not null")
    if not whole:
        rows = rows.filter("doc_id is not null").filter(training_fold(F.col("doc_id")))
    texts = rows.select("lang", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(sample + calibration)) < sample).alias("counts"))

    counted = texts.mapInArrow(_counted(order), "lang string, gram string, n long, first long")
    counted = scratch.keep(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("first").alias("first")), f"grams-{order}")
    size, langs = counted.agg(F.count("*"), F.count_distinct("lang")).first()
    while model_bytes is not None and order > 1 and size * (8 + 4 * langs) > model_bytes:
        order -= 1
        counted = counted.groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
        counted = scratch.keep(counted, f"grams-{order}")
        size = counted.count()
    if size * (8 + 4 * langs) > MODEL_BYTES:
        models = stored(counted, "n", order, scratch, "all")
        some = counted.filter("first > 0").limit(1).count()
        shared = spark.sparkContext.broadcast(stored(counted, "first", order, scratch, "part") if some else models)
    else:
        found = counted.toArrow()  # bounded by MODEL_BYTES
        each = {lang: found.filter(pc.equal(found.column("lang"), lang)) for lang in found.column("lang").unique().to_pylist()}
        grams_of = {lang: _points(t.column("gram"), order) for lang, t in each.items()}
        models = build_grams({lang: (grams_of[lang], t.column("n").to_numpy()) for lang, t in each.items()}, order)
        if not models.langs:
            return models
        first = {lang: (grams_of[lang][n > 0], n[n > 0]) for lang, n in ((lang, t.column("first").to_numpy()) for lang, t in each.items()) if n.any()}
        shared = spark.sparkContext.broadcast(build_grams(first, order) if first else models)

    def strange(batches):
        for b in blocks(batches, "text", BLOCK_BYTES):
            h, chars = shared.value.entropies(b.column("text").to_pylist())
            low = np.ceil(strangeness(h.min(axis=1), chars) * GRID).astype(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array([shared.value.langs[k] for k in h.argmin(axis=1)]), pa.array(low)], ["lang", "low"])
            yield out.filter(pa.array(chars > 0))

    held = texts.filter(~F.col("counts")).mapInArrow(strange, "lang string, low long").groupBy("lang", "low").agg(F.count("*").alias("n")).orderBy("lang", "low")
    low: dict[str, list[float]] = {}
    times: dict[str, list[int]] = {}
    for r in held.collect():  # the steps of the grid that are in use
        low.setdefault(r.lang, []).append(r.low / GRID)
        times.setdefault(r.lang, []).append(r.n)
    models.limits = limits_of(low, models.langs, rejected, times=times)
    return models


def identified(docs: DataFrame, models: Models, column: str = "language") -> DataFrame:
    """All columns of ``docs`` and a struct of the language, its confidence and whether the text is rejected.

    A null text, or one without a letter, is ``und`` with confidence 0 and rejected.
    """
    spark = text_session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(models)

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(text: pa.Array) -> pa.Array:
        out = []
        for b in blocks([pa.RecordBatch.from_arrays([text], ["text"])], "text", BLOCK_BYTES):
            lang, score, rejected = shared.value.predict(b.column("text").to_pylist())
            out.append(pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["lang_pred", "score", "rejected"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    return docs.withColumn(column, predict(F.col("text").cast("string")))
