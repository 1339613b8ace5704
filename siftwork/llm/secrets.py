"""Secret scan by dictionary-primed zstandard novelty.

Three fixed patterns find the plain cases. Beyond them, strings in sensitive contexts (behind words such as ``credential`` or
``private key``) are candidates. What a candidate adds to the compressed size of its surroundings is measured with a
dictionary of identifiers, the commonest words around sensitive contexts in the whole corpus: a name or a word costs little,
a string that nothing around it explains costs about a byte per character and is reported.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from siftwork.llm.common import blocks, text_session

# The three patterns and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "novel")

# Words that make what follows them sensitive.
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|bearer|authorization|signature|webhook|(?:api|access|private|secret|signing|encryption|auth|ssh|master)[ _-]?key|client[ _-]?secret)s?(?![a-z])",
    re.ASCII | re.IGNORECASE,
)
REACH = 64  # characters behind such a word in which a candidate begins, on the same line
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~!@#$%^&*.-]{12,}")
SURROUND = 1024  # characters on either side that may explain a candidate
# A candidate is novel from so many added bytes per character on; words of the corpus's languages add about two thirds of a byte.
NOVELTY = 0.85
LEAST_BYTES = 12
# Whole words only: a piece of a longer string is no identifier.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z_]{2,32}(?![A-Za-z0-9_+/=-])")
# The dictionary holds so many bytes of identifiers; each must occur around the contexts of so many different documents.
DICTIONARY_BYTES = 64 << 10
LEAST_CONTEXTS = 3


# What every match of the patterns above begins with, in lower case, and a quick test of whole columns for any of it.
_ASSIGN_STEMS = ("passw", "secret", "token", "api")
_CONTEXT_STEMS = ("pass", "pwd", "secret", "token", "credential", "bearer", "authorization", "signature", "webhook", "api", "access", "private", "signing", "encryption", "auth", "ssh", "master", "client")
_ANY_CONTEXT = r"(?i)pass|pwd|secret|token|credential|bearer|authorization|signature|webhook|key"
_ANY_BASE = r"AKIA[A-Z0-9]|[0-9a-f]{32}"
_NAME = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[_.-])+")


def _matches(pattern: re.Pattern, stems: Sequence[str], text: str) -> Iterator[re.Match]:
    """``pattern.finditer(text)``, trying only the places where one of the stems begins."""
    low = text.lower()
    if len(low) != len(text):
        yield from pattern.finditer(text)
        return
    places = []
    for stem in stems:
        at = low.find(stem)
        while at >= 0:
            places.append(at)
            at = low.find(stem, at + 1)
    end = 0
    for at in sorted(places):
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            yield m


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind. A match that holds too little is dropped, its text used up."""
    out = [(m.start(), 0, m.end()) for m in _matches(ASSIGN, _ASSIGN_STEMS, text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS] if "AKIA" in text else []
    # A run of hex digits is taken whole, so the shorter ones need not be matched first.
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


def contexts(text: str) -> Iterator[tuple[int, int]]:
    """Where something sensitive may begin: from behind a sensitive word to ``REACH`` characters on or the line's end."""
    for m in _matches(CONTEXT, _CONTEXT_STEMS, text):
        line = text.find("\n", m.end(), m.end() + REACH)
        yield m.end(), line if line >= 0 else min(len(text), m.end() + REACH)


def _some(column: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, pattern), False).to_numpy(zero_copy_only=False)


def candidates(text: str, taken: Sequence[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Strings that begin in a sensitive context and overlap no span that is taken, in order."""
    starts, reach = [a for a, _, _ in taken], []
    for a, b, _ in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    found: dict[int, int] = {}
    for low, high in contexts(text):
        for m in CANDIDATE.finditer(text, low):
            if m.start() >= high:
                break
            # A string that began before its context is judged whole.
            begin, end = m.start(), m.end()
            while end - begin >= 12 and text[end - 1] in ".=":
                end -= 1
            k = bisect.bisect_left(starts, end)
            if end - begin >= 12 and not (k and reach[k - 1] > begin):
                found[begin] = end
    out: list[tuple[int, int]] = []
    for begin, end in sorted(found.items()):
        if not out or begin >= out[-1][1]:
            out.append((begin, end))
    return out


class Novelty:
    """Added bytes of a string beside its surroundings and a dictionary of identifiers."""

    def __init__(self, identifiers: Sequence[str]):
        self.identifiers = list(identifiers)
        self.compressor = None

    def __getstate__(self):
        return {"identifiers": self.identifiers, "compressor": None}

    def _size(self, text: str) -> int:
        if self.compressor is None:
            # The commonest identifiers come last, where they are nearest.
            content = " ".join(reversed(self.identifiers)).encode()
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.compressor = zstandard.ZstdCompressor(level=6, **options) if made is None else zstandard.ZstdCompressor(level=6, dict_data=made, **options)
        return len(self.compressor.compress(text.encode()))

    def added(self, text: str, begin: int, end: int) -> int:
        """How many bytes the string adds; its other occurrences nearby explain nothing."""
        own = text[begin:end]
        before = text[max(0, begin - SURROUND) : begin].replace(own, " ")
        after = text[end : end + SURROUND].replace(own, " ")
        around = f"{after} {before}"
        return self._size(around + own) - self._size(around)

    def novel(self, text: str, begin: int, end: int) -> bool:
        """Words of letters, and names put together of them, are no secrets, whatever they cost."""
        if _NAME.fullmatch(text, begin, end):
            return False
        added = self.added(text, begin, end)
        return added >= LEAST_BYTES and added >= NOVELTY * (end - begin)


def spans_of(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The fixed patterns' spans, and all spans."""
    base = base_spans(text)
    more = [(a, b, "novel") for a, b in candidates(text, base) if novelty.novel(text, a, b)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def joined(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def identifiers(docs: DataFrame, size: int = DICTIONARY_BYTES, least: int = LEAST_CONTEXTS) -> list[str]:
    """The commonest words around sensitive contexts, the commonest first, ``size`` bytes at most.

    All documents are read. A word counts once for each document, and documents are told apart by the smallest hash of the
    neighbourhoods of their contexts, so copies of a document add nothing and a secret that is copied with its surroundings
    does not become an identifier.
    """

    def found(batches):
        for b in blocks(batches, "text"):
            rows: set[tuple[str, int]] = set()
            for text in b.column("text").filter(pa.array(_some(b.column("text"), _ANY_CONTEXT))).to_pylist():
                places = [low for low, _ in contexts(text)]
                if places:
                    key = min(xxhash.xxh3_64_intdigest(text[max(0, low - REACH) : low + REACH].encode()) >> 1 for low in places)
                    rows.update((w, key) for low in places for w in IDENTIFIER.findall(text, max(0, low - 2 * REACH), low + 2 * REACH))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([k for _, k in rows], pa.int64())], ["word", "document"])

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(found, "word string, document long")
    counted = words.distinct().groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    top = counted.orderBy(F.desc("n"), "word").limit(size // 3).collect()  # a word has two letters and a space at least
    out, used = [], 0
    for r in top:
        used += len(r.word) + 1
        if used > size:
            break
        out.append(r.word)
    return out


def scanned(docs: DataFrame, size: int = DICTIONARY_BYTES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel for each row of ``docs`` (doc_id, text).

    Spans are ``kind:start:end`` in code points, the end exclusive, ordered by start and kind. A null or empty text has none;
    the digest is that of the empty string then. Texts are scanned whole, whatever their length. Rows without id and repeated
    rows each give a row; an empty table gives none. Other columns are not read.
    """
    text_session(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    novelty = Novelty(identifiers(rows, size))

    def scan(batches):
        for b in blocks(batches, "text"):
            counts = np.zeros((len(KINDS), b.num_rows), np.int64)
            digests, spans = [hashlib.sha256(b"").hexdigest()] * b.num_rows, [""] * b.num_rows
            column = b.column("text")
            some = np.flatnonzero(_some(column, _ANY_CONTEXT) | _some(column, _ANY_BASE))
            for i, text in zip(some, column.take(pa.array(some)).to_pylist()):
                base, every = spans_of(text, novelty)
                kinds = [k for _, _, k in every]
                counts[:, i] = [kinds.count(k) for k in KINDS]
                digests[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(every)
            cols = [pa.array(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *cols, pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    out = rows.mapInArrow(scan, "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")
