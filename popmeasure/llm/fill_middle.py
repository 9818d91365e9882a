"""Fill-in-the-middle transformation with content-defined chunks.

A document of n lines is cut after two line ends that a hash of its id chooses, and its three parts are put in another
order behind markers. To find the cuts the text is not split into lines: a rolling hash over its bytes cuts it into
chunks wherever the hash of the last 32 bytes ends in zeros, so a passage that documents share is cut alike in all of
them, whatever stands before it. What a chunk contributes is its summary: its bytes, code points, line ends, where the
line ends are, and whether it ends with one. Summaries are kept in a cache of the worker. The cache is keyed by the
chunk itself, so a hit is verified by content and no two chunks are ever taken for each other. The summaries of a
document's chunks add up (a line may reach over chunks; only line ends are counted, and the last chunk tells whether an
unfinished line follows), so running totals name the chunk of a cut, and its list of line ends gives the byte.

Nothing is shuffled and no state leaves a task; a repeated task gives the same rows. The cache is bounded by bytes and
forgets the older half of what it holds; results do not depend on it.

Nulls and edges: a null text counts as empty; an empty text, and one that holds a marker, keeps its plain form, with
null character counts; a null id counts as the empty text in the hash; texts are cut whole, however long; equal rows
give equal results. The transformation is one column, so a table may have any other columns; an empty table works.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW = 32
MASK_BITS = 11  # chunks of about 2 KB
LONGEST = 1 << 16
CACHE_BYTES = 32 << 20

RESULT = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


class Chunk(NamedTuple):
    """What a chunk adds to a document."""

    size: int
    chars: int
    ends: tuple[int, ...]  # one past each line end
    closed: bool


def _gear() -> np.ndarray:
    """256 fixed pseudo-random words for the rolling hash."""
    words = (hashlib.sha256(b"gear %d" % i).digest()[:4] for i in range(256))
    return np.frombuffer(b"".join(words), "<u4").copy()


GEAR = _gear()


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the WINDOW bytes up to it: sum of gear[b[i - j]] << j, by doubling the window."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def cut_points(data: np.ndarray, starts: np.ndarray, mask_bits: int = MASK_BITS) -> np.ndarray:
    """Ends of chunks, one past their last byte, for texts laid end to end from `starts` on.

    A window must lie within its text, so that a text is cut alike wherever it stands. The upper bits decide: they
    depend on all bytes of the window.
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(rolling_hash(data) >> np.uint32(32 - mask_bits) == 0)
    return at[at - starts[np.searchsorted(starts, at, side="right") - 1] >= WINDOW - 1] + 1


def summarise(chunk: bytes) -> Chunk:
    """A code point is counted where it starts, so chunks may cut through one."""
    data = np.frombuffer(chunk, np.uint8)
    ends = tuple((np.flatnonzero(data == 10) + 1).tolist())
    return Chunk(len(chunk), int(np.count_nonzero((data & 0xC0) != 0x80)), ends, chunk.endswith(b"\n"))


class ChunkCache:
    """Summaries by chunk, in two generations of up to `most` / 2 bytes: what is not asked for again is forgotten."""

    def __init__(self, most: int = CACHE_BYTES):
        self.half = most // 2
        self.new: dict[bytes, Chunk] = {}
        self.old: dict[bytes, Chunk] = {}
        self.held = self.hits = self.misses = 0

    def get(self, chunk: bytes) -> Chunk:
        found = self.new.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        found = self.old.get(chunk)
        if found is None:
            self.misses += 1
            found = summarise(chunk)
        else:
            self.hits += 1
        self.held += found.size + 8 * len(found.ends) + 200
        if self.held > self.half:
            self.old, self.new, self.held = self.new, {}, found.size
        self.new[chunk] = found
        return found


def chunks_of(text: bytes, points: list[int]) -> list[bytes]:
    """`text` cut at the points (ends within the text) and wherever a chunk would be longer than LONGEST."""
    out, at = [], 0
    for end in [*points, len(text)]:
        while end - at > LONGEST:
            out.append(text[at : at + LONGEST])
            at += LONGEST
        if end > at:
            out.append(text[at:end])
            at = end
    return out


class Located(NamedTuple):
    """The totals of a text's chunks."""

    pieces: list[bytes]
    found: list[Chunk]
    lines: list[int]  # line ends up to and with each chunk
    sizes: list[int]  # bytes before each chunk, and all
    chars: list[int]

    @property
    def n(self) -> int:
        """Lines: line ends, and an unfinished line."""
        return (self.lines[-1] if self.lines else 0) + (1 if self.found and not self.found[-1].closed else 0)

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first `k` lines."""
        if k == 0:
            return 0, 0
        if not self.lines or k > self.lines[-1]:
            return self.sizes[-1], self.chars[-1]
        c = bisect_left(self.lines, k)
        inside = self.found[c].ends[k - (self.lines[c - 1] if c else 0) - 1]
        head = np.frombuffer(self.pieces[c], np.uint8, inside)
        return self.sizes[c] + inside, self.chars[c] + int(np.count_nonzero((head & 0xC0) != 0x80))


def locate(text: bytes, points: list[int], cache: ChunkCache) -> Located:
    pieces = chunks_of(text, points)
    found = [cache.get(p) for p in pieces]
    return Located(
        pieces,
        found,
        list(accumulate(len(c.ends) for c in found)),
        list(accumulate((c.size for c in found), initial=0)),
        list(accumulate((c.chars for c in found), initial=0)),
    )


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))  # type: ignore[return-value]


def transform_one(
    text: bytes, points: list[int], doc_id: object, seed: int, rate: int, spm_rate: int, cache: ChunkCache
) -> tuple[int, str, int | None, int | None, bytes]:
    """(lines, form, code points of prefix and middle, output) of one text; the rates are per cent."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    where = locate(text, points, cache)
    n = where.n
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or h3 % 100 >= rate or p in text or s in text or m in text:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_chars), (b, b_chars) = where.cut(first), where.cut(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        form, out = "spm", b"".join((s, suffix, p, prefix, m, middle))
    else:
        form, out = "psm", b"".join((p, prefix, s, suffix, m, middle))
    return n, form, a_chars, b_chars - a_chars, out


_caches: list[ChunkCache] = []


def _transform_batch(ids: pa.Array, texts: pa.Array, seed: int, rate: int, spm_rate: int) -> pa.Array:
    if not _caches:
        _caches.append(ChunkCache())
    raw = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
    ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(raw) else np.zeros(0, dtype=np.int64)
    filled = np.flatnonzero(ends > starts)  # of texts that start at one place only the last one is not empty
    points = cut_points(np.frombuffer(b"".join(raw), np.uint8), starts[filled])
    low, high = np.searchsorted(points, starts, side="right"), np.searchsorted(points, ends, side="left")
    rows = [
        transform_one(text, (points[a:b] - start).tolist(), doc_id, seed, rate, spm_rate, _caches[0])
        for text, doc_id, start, a, b in zip(raw, ids.to_pylist(), starts.tolist(), low, high, strict=True)
    ]
    n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.StructArray.from_arrays(
        [
            pa.array(n, pa.int64()),
            pa.array(form, pa.string()),
            pa.array(prefix, pa.int64()),
            pa.array(middle, pa.int64()),
            pa.array(output, pa.binary()).view(pa.string()),
        ],
        names=["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fim_column(
    doc_id: Column | str, text: Column | str, seed: int = 7, rate: int = 100, spm_rate: int = 50
) -> Column:
    """A struct of RESULT: lines, form (plain, psm or spm), code points of prefix and middle, and the new text.

    `rate` per cent of the documents are transformed, `spm_rate` per cent of these with the suffix first.
    """
    if not (0 <= rate <= 100 and 0 <= spm_rate <= 100):
        raise ValueError("rates are per cent")

    @F.arrow_udf(RESULT)
    def transform(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return _transform_batch(ids, texts, seed, rate, spm_rate)

    return transform(doc_id, text)


def restored_column(output: Column, form: Column) -> Column:
    """The text from its output and form alone, with built-in functions.

    No part holds a marker, and a marker's last character is none of its first two, so its first occurrence is its own.
    """

    def after(marker: str) -> Column:
        return F.instr(output, marker) + F.lit(3)

    def before(marker: str) -> Column:
        return F.instr(output, marker)

    def between(start: Column, end: Column) -> Column:
        return F.substring(output, start, F.greatest(end - start, F.lit(0)))

    end = F.length(output) + F.lit(1)
    middle = between(after(MIDDLE), end)
    psm = F.concat(between(after(PREFIX), before(SUFFIX)), middle, between(after(SUFFIX), before(MIDDLE)))
    spm = F.concat(between(after(PREFIX), before(MIDDLE)), middle, between(after(SUFFIX), before(PREFIX)))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
