"""SentencePiece encoding and decoding as a best path, in parallel within giant documents.

The vocabulary file is given by its path and never trained here. The best segmentation is the path with the highest sum
of piece scores (unigram model). A file whose pieces carry merge ranks instead of log-probabilities gets Zipf's: the
piece of rank r scores -ln((r + 1) H) with H the harmonic number of the vocabulary's size. A character that no piece
covers is one step of the lowest score less ten, written as its UTF-8 bytes. Scores are whole multiples of 2 ** -12 and
are added as integers, so that sums do not depend on how a text is cut. Of equal paths the one with the longer last
piece wins, then the one with the longer piece before it, and so on; the ids do not depend on how a text is cut.

A document of more than `chunk` characters is cut into chunks, spread over the tasks. The state at a cut is the number
of characters by which a piece reaches over it. Every chunk yields its transfer matrix (best score from each state at
its start to each state at its end); the matrices of a document are combined by an associative max-plus scan, which
gives the best score of each state at each cut. With these every chunk finds, for each state at its end, the state at
its start from which the winning path comes; these maps are composed from the document's end, and every chunk is then
traced back on its own between its two states. A cell holds at most 2 GB, so a document has at most 2 ** 31 / `chunk`
matrices of a few KB: that bounds the one group that meets in a task.

Where no piece reaches over a place (in front of a space that follows another character, around a line feed), paths
separate. Such units are solved once per worker and remembered, in two generations of about `_MEMO` entries; what is
used again moves to the younger one. The new units of a batch are solved together: all walk down the tree of pieces
one character at a time, and the best paths of all advance place by place.

Defined results: null and empty texts have no pieces. Characters U+2581 in a text read back as spaces, as in the
original library. Repeated documents each keep their row; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popmeasure.llm.common import free, written
from popmeasure.llm.words import texts

SPACE = "▁"
SCALE = 4096
_MEMO = 180_000
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_LOW = -(1 << 60)
_CODE_BITS = 21  # a code point
_NO_CODE = (1 << _CODE_BITS) - 1
_WIDTHS = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64)
_WIDTH_OF = [next(w for w in _WIDTHS if n <= w) for n in range(65)]
_KEPT: dict[str, dict] = {}


class Trie(NamedTuple):
    """Pieces as a tree in arrays: (node, code point) to node, sorted; score and id of the piece that a node ends."""

    keys: np.ndarray
    children: np.ndarray
    score: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, scores: dict[str, int], ids: dict[str, int]) -> Trie:
        edges: dict[int, int] = {}
        score, piece = [_LOW], [-1]
        for text, value in scores.items():
            node = 0
            for c in text:
                node = edges.setdefault(node << _CODE_BITS | ord(c), len(score))
                if node == len(score):
                    score.append(_LOW)
                    piece.append(-1)
            score[node], piece[node] = value, ids[text]
        keys = np.array(list(edges), dtype=np.int64)
        order = np.argsort(keys)
        children = np.array(list(edges.values()), dtype=np.int64)
        return cls(keys[order], children[order], np.array(score), np.array(piece, dtype=np.int32))


@dataclass
class Pieces:
    """A vocabulary: scores by piece, ids, and the bytes of each id."""

    scores: dict[str, int]
    ids: dict[str, int]
    byte_ids: list[int]
    surface: list[bytes]
    unknown: int
    longest: int
    separable: bool
    memo: dict[str, tuple[int, tuple[int, ...]]] = field(default_factory=dict, repr=False)

    older: dict[str, tuple[int, tuple[int, ...]]] = field(default_factory=dict, repr=False)
    solved: dict[str, bytes] = field(default_factory=dict, repr=False)
    solved_before: dict[str, bytes] = field(default_factory=dict, repr=False)
    tree: dict = field(default_factory=dict, repr=False)
    trie: Trie | None = field(default=None, repr=False)
    pairs: frozenset[str] = frozenset()

    identity: str = ""

    def __getstate__(self) -> dict:
        own = {"memo": {}, "older": {}, "solved": {}, "solved_before": {}, "tree": {}, "trie": None}
        return {**self.__dict__, **own}

    def __setstate__(self, state: dict) -> None:
        """What a worker has solved and built for this vocabulary outlives the task."""
        if self.__dict__ is not (kept := _KEPT.setdefault(state["identity"], {})):
            self.__dict__ = kept
        if not kept:
            kept.update(state)

    def _tree(self) -> dict:
        """Pieces as a tree: character to (score or None, the characters that may follow)."""
        if not self.tree:
            for piece, score in self.scores.items():
                node = self.tree
                for c in piece[:-1]:
                    node = node.setdefault(c, (None, {}))[1]
                node[piece[-1]] = (score, node.get(piece[-1], (None, {}))[1])
        return self.tree

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        byte_ids, surface, stored = [-1] * 256, [b""] * n, {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                byte_ids[value], surface[i] = i, bytes([value])
            elif not special[i]:
                stored[piece], surface[i] = (i, model.get_score(i)), piece.replace(SPACE, " ").encode()
        values = [s for _, s in stored.values()]
        ranked = min(values) < -1000  # log-probabilities do not get that low, merge ranks do
        harmonic = np.log(max(len(stored), 2)) + 0.5772156649
        scored = {
            p: round(SCALE * float(-np.log((1 - s) * harmonic) if ranked else s)) for p, (_, s) in stored.items()
        }
        return cls.of(scored, {p: i for p, (i, _) in stored.items()}, byte_ids, surface)

    @classmethod
    def of(cls, scored: dict[str, int], ids: dict[str, int], byte_ids: list[int], surface: list[bytes]) -> Pieces:
        bare = [p.lstrip(SPACE) for p in scored]
        return cls(
            scores=scored,
            ids=ids,
            byte_ids=byte_ids,
            surface=surface,
            unknown=min(scored.values()) - 10 * SCALE,
            longest=max(map(len, scored)),
            identity=hashlib.sha256(repr(sorted(scored.items())).encode()).hexdigest(),
            pairs=frozenset(p[k : k + 2] for p in scored for k in range(len(p) - 1)),
            separable=not any(SPACE in p or "\n" in p for p in bare),
        )

    def forward(
        self, text: str, entry: int, stop: int, reached: np.ndarray | None = None
    ) -> tuple[list[int], list[int]]:
        """Best score and last start at every place of `text`; pieces begin before `stop`.

        Paths come from `entry`, or from the first places with the scores that they are `reached` with.
        """
        size, root, unknown = len(text), self._tree(), self.unknown
        best, came = [_LOW] * (size + 1), [-1] * (size + 1)
        if reached is None:
            best[entry] = 0
        else:
            best[: len(reached)] = [max(int(x), _LOW) if x > _LOW // 2 else _LOW for x in reached[: size + 1]]
        for start in range(entry, stop):
            here = best[start]
            if here == _LOW:
                continue
            node = root.get(text[start])
            end = start + 1
            if (node is None or node[0] is None) and here + unknown > best[end]:
                best[end], came[end] = here + unknown, start
            while node is not None:
                score, children = node
                if score is not None and here + score > best[end]:
                    best[end], came[end] = here + score, start
                if end == size or not children:
                    break
                node = children.get(text[end])
                end += 1
        return best, came

    def traced(self, text: str, came: list[int], end: int, entry: int) -> list[int]:
        found: list[list[int]] = []
        while end > entry:
            start = came[end]
            piece = text[start:end]
            one = self.ids.get(piece)
            found.append([self.byte_ids[b] for b in piece.encode("utf-8", "replace")] if one is None else [one])
            end = start
        return [i for part in reversed(found) for i in part]

    def unit(self, unit: str) -> tuple[int, tuple[int, ...]]:
        """(score, ids) of a text that no piece leaves."""
        known = self.memo.get(unit) or self.older.get(unit)
        if known is None:
            cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.pairs]
            if cuts:
                parts = [self.unit(unit[i:j]) for i, j in zip([0, *cuts], [*cuts, len(unit)], strict=True)]
                known = (sum(p[0] for p in parts), tuple(i for p in parts for i in p[1]))
            else:
                best, came = self.forward(unit, 0, len(unit))
                known = (best[-1], tuple(self.traced(unit, came, len(unit), 0)))
        if len(unit) <= 64:
            self.memo[unit] = known
        return known

    def _age(self) -> None:
        """Between two texts: a full younger generation becomes the older one."""
        if len(self.memo) > _MEMO // 4:
            self.memo, self.older = {}, self.memo
        if len(self.solved) > _MEMO:
            self.solved, self.solved_before = {}, self.solved

    def solve(self, units: list[str]) -> dict[str, bytes]:
        """Ids (as int32 bytes) of units of up to 64 characters, all at once; longer ones one by one."""
        by_width: dict[int, list[str]] = {}
        for unit in units:
            by_width.setdefault(_WIDTH_OF[len(unit)] if len(unit) <= 64 else 0, []).append(unit)
        out = {u: np.array(self.unit(u)[1], np.int32).tobytes() for u in by_width.pop(0, [])}
        for width, some in by_width.items():
            for lo in range(0, len(some), 4096):
                out.update(self._solve(some[lo : lo + 4096], width))
        return out

    def _solve(self, units: list[str], width: int) -> Iterator[tuple[str, bytes]]:
        if self.trie is None:
            self.trie = Trie.of(self.scores, self.ids)
        trie, n = self.trie, len(units)
        sizes = np.array([len(u) for u in units])
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.full((n, width), _NO_CODE, np.int64)
        codes[np.arange(width) < sizes[:, None]] = flat
        codes = np.ascontiguousarray(codes.T).reshape(-1)  # places first, so that the next character is n further
        # every place walks down the tree as far as pieces reach
        scores, pieces = [], []
        at, node = np.arange(width * n), np.zeros(width * n, np.int64)
        for size in range(1, min(self.longest, width) + 1):
            ahead = at + (size - 1) * n
            inside = ahead < width * n
            at, key = at[inside], node[inside] << _CODE_BITS | codes[ahead[inside]]
            edge = np.minimum(np.searchsorted(trie.keys, key), len(trie.keys) - 1)
            met = trie.keys[edge] == key
            at, node = at[met], trie.children[edge[met]]
            found = np.full(width * n, _LOW)
            found[at] = trie.score[node]
            named = np.full(width * n, -1, np.int32)
            named[at] = trie.piece[node]
            if size == 1:
                found[found == _LOW] = self.unknown
            scores.append(found.reshape(width, n))
            pieces.append(named.reshape(width, n))
            if not len(at):
                break
        # best score at every place; the longest last piece comes first and stays on a tie
        best = np.zeros((width + 1, n), np.int64)
        step = np.zeros((width + 1, n), np.int64)
        for end in range(1, width + 1):
            top = np.full(n, 2 * _LOW)
            for size in range(min(len(scores), end), 0, -1):
                value = best[end - size] + scores[size - 1][end - size]
                better = value > top
                top = np.where(better, value, top)
                step[end][better] = size
            best[end] = top
        traced = np.full((n, width), -1, np.int32)
        unknown = np.zeros(n, bool)
        pieces_of, left = np.stack(pieces), np.full(n, width)
        place, live = sizes.copy(), np.flatnonzero(sizes)
        while len(live):
            size = step[place[live], live]
            place[live] -= size
            left[live] -= 1
            one = pieces_of[size - 1, place[live], live]
            traced[live, left[live]] = one
            unknown[live] |= one < 0
            live = live[place[live] > 0]
        for k, unit in enumerate(units):
            if unknown[k]:
                yield unit, np.array(self.unit(unit)[1], np.int32).tobytes()
            else:
                yield unit, traced[k, left[k] :].tobytes()

    def encode_many(self, values: list[str | None]) -> list[bytes]:
        """Ids (as int32 bytes) of texts, each in one piece of work."""
        return self.joined([self.units(prepared(v)) if v else [] for v in values])

    def joined(self, split: list[list[str]]) -> list[bytes]:
        """Ids (as int32 bytes) of each list of units."""
        self._age()
        known, before, new = self.solved, self.solved_before, []
        for unit in set().union(*split):
            if unit not in known:
                if unit in before:
                    known[unit] = before[unit]
                else:
                    new.append(unit)
        known.update(self.solve(new))
        out = [b"".join(map(known.__getitem__, units)) for units in split]
        for unit in new:
            if len(unit) > 64:
                del known[unit]
        return out

    def units(self, text: str) -> list[str]:
        return _UNITS.findall(text) if self.separable else [text]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text in one piece of work."""
        return np.frombuffer(self.encode_many([text])[0], np.int32).tolist()

    def decode(self, ids) -> str:
        joined = b"".join(map(self.surface.__getitem__, ids))
        return (joined[1:] if joined.startswith(b" ") else joined).decode("utf-8", "replace")

    # --- chunks of a giant document ---

    def _ends(self, chunk: str, size: int) -> tuple[int, int]:
        """First and last place of the chunk where paths separate; (size, size) when there is none."""
        if not self.separable:
            return size, size
        first = next((m.start() for m in _UNITS.finditer(chunk) if m.start() >= self.longest), size)
        if first >= size:
            return size, size
        last = first
        for m in _UNITS.finditer(chunk, max(first, size - 4096)):
            if m.start() >= size:
                break
            if first < m.start() and _splits(chunk, m.start()):
                last = m.start()
        return first, last

    def transfer(self, chunk: str, size: int) -> np.ndarray:
        """Matrix [state at the start, state at the end] of a chunk of `size` characters and what follows it.

        Between the first and the last place where paths separate all paths are one; its score is left out, as it adds
        the same to every path.
        """
        states = self.longest
        out = np.full((states, states), _LOW, np.int64)
        first, last = self._ends(chunk, size)
        self._age()
        if first == size:
            for a in range(min(states, size + 1)):
                best, _ = self.forward(chunk, a, size)
                row = best[size : size + states]
                out[a, : len(row)] = row
            return out
        head = np.array([self.forward(chunk[:first], a, first)[0][first] for a in range(states)], np.int64)
        best, _ = self.forward(chunk[last:], 0, size - last)
        row = best[size - last : size - last + states]
        tail = np.full(states, _LOW, np.int64)
        tail[: len(row)] = row
        total = head[:, None] + tail[None, :]
        return np.where((head[:, None] <= _LOW // 2) | (tail[None, :] <= _LOW // 2), _LOW, total)

    def entries(self, chunk: str, size: int, reached: np.ndarray) -> np.ndarray:
        """For each state at the chunk's end the state at its start that the winning path to it comes from.

        `reached` has the best score of each state at the start; -1 marks a state at the end that cannot be reached.
        A path that reaches a place from before the chunk has the longer last piece there, so it stays on a tie.
        """
        states = self.longest
        first, last = self._ends(chunk, size)
        self._age()
        head = chunk if first == size else chunk[:first]
        best, came = self.forward(head, 0, min(first, size), reached)
        if first < size:  # all paths meet at `first`, whatever follows
            return np.full(states, _entry(came, first))
        ends = [_entry(came, size + a) if size + a < len(best) and best[size + a] > _LOW // 2 else -1 for a in range(states)]
        return np.array(ends)

    def between(self, chunks: list[tuple[str, int, int, int]]) -> list[np.ndarray]:
        """Ids of chunks (text, size, state at the start, state at the end)."""
        heads, middles, tails = [], [], []
        for chunk, size, entry, leave in chunks:
            first, last = self._ends(chunk, size)
            _, came = self.forward(chunk if first == size else chunk[:first], entry, min(first, size))
            heads.append(self.traced(chunk, came, size + leave if first == size else first, entry))
            middles.append(self.units(chunk[first:last]) if last > first else [])
            if first == size:
                tails.append([])
            else:
                _, came = self.forward(chunk[last:], 0, size - last)
                tails.append(self.traced(chunk[last:], came, size + leave - last, 0))
        parts = zip(heads, self.joined(middles), tails, strict=True)
        return [np.concatenate([np.array(h, np.int32), np.frombuffer(m, np.int32), np.array(t, np.int32)]) for h, m, t in parts]


def _splits(text: str, place: int) -> bool:
    """No piece of a separable vocabulary reaches over this place."""
    return text[place] == "\n" or text[place - 1] == "\n" or (text[place] == SPACE and text[place - 1] != SPACE)


def prepared(text: str) -> str:
    """The text as the pieces are written: a space in front, spaces as U+2581."""
    return SPACE + text.replace(" ", SPACE)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of stacks of matrices."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(axis=-2), _LOW)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, 3 ... matrices, each step combining twice as many."""
    out, step = matrices.copy(), 1
    while step < len(out):
        for lo in range(len(out) - 1, step - 1, -1024):  # in blocks, from the back, so that inputs are still the old ones
            at = np.arange(max(step, lo - 1023), lo + 1)
            out[at] = times(out[at - step], out[at])
        step *= 2
    return out


def _entry(came: list[int], place: int) -> int:
    while came[place] >= 0:
        place = came[place]
    return place


def reached_before(matrices: np.ndarray) -> np.ndarray:
    """Best score from the document's start to each state in front of each chunk; the document starts in state 0."""
    start = np.full((1, matrices.shape[1]), _LOW, np.int64)
    start[0, 0] = 0
    return np.concatenate([start, scan(matrices)[:-1, 0, :]])


def states_of(entries: list[np.ndarray]) -> list[int]:
    """The state at the start and behind every chunk; the maps are followed from the document's end, in state 0."""
    states = [0]
    for back in reversed(entries):
        states.append(int(back[states[-1]]))
    return states[::-1]


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, k, size, part): the chunks of the texts, each with the characters that pieces may reach over to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["key"], texts(frame), strict=True):
                whole = prepared(text or "")
                starts = list(range(0, max(len(whole) - overlap, 1), chunk))
                ends = [*starts[1:], len(whole)]
                for lo in range(0, len(starts), 64):
                    some = list(zip(starts[lo : lo + 64], ends[lo : lo + 64], strict=True))
                    yield pd.DataFrame(
                        {
                            "key": key,
                            "k": range(lo, lo + len(some)),
                            "size": [b - a for a, b in some],
                            "part": [whole[a : b + overlap] for a, b in some],
                        }
                    )

    return docs.mapInPandas(run, "key string, k int, size int, part string")


def _encode_giants(giants: DataFrame, model: Pieces, chunk: int) -> DataFrame:
    """(key, ids) of texts given as (key, text), worked on chunk by chunk."""
    parts = written(_chunks(giants, chunk, model.longest).dropDuplicates(["key", "k"]))

    def transfer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [model.transfer(p, n).tobytes() for p, n in zip(frame["part"], frame["size"], strict=True)]
            yield pd.DataFrame({"key": frame["key"], "k": frame["k"], "matrix": made})

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        shape = (-1, model.longest, model.longest)
        rows = reached_before(np.frombuffer(b"".join(frame["matrix"]), np.int64).reshape(shape))
        return pd.DataFrame({"key": frame["key"], "k": frame["k"], "reached": [r.tobytes() for r in rows]})

    def lead_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            given = zip(frame["part"], frame["size"], frame["reached"], strict=True)
            maps = [model.entries(p, n, np.frombuffer(r, np.int64)).astype("<i8").tobytes() for p, n, r in given]
            yield pd.DataFrame({"key": frame["key"], "k": frame["k"], "back": maps})

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        states = states_of([np.frombuffer(b, "<i8") for b in frame["back"]])
        return pd.DataFrame({"key": frame["key"], "k": frame["k"], "entry": states[:-1], "leave": states[1:]})

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 50):  # the ids take more room than the text
                some = frame.iloc[lo : lo + 50]
                rows = zip(some["part"], some["size"], some["entry"], some["leave"], strict=True)
                ids = model.between(list(rows))
                yield pd.DataFrame({"key": some["key"].to_numpy(), "k": some["k"].to_numpy(), "ids": ids})

    matrices = parts.mapInPandas(transfer, "key string, k int, matrix binary")
    reached = matrices.groupBy("key").applyInPandas(combine, "key string, k int, reached binary")
    maps = parts.join(reached, ["key", "k"]).mapInPandas(lead_back, "key string, k int, back binary")
    states = maps.groupBy("key").applyInPandas(compose, "key string, k int, entry int, leave int")
    traced = parts.join(states, ["key", "k"]).mapInPandas(trace, "key string, k int, ids array<int>")
    whole = traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return whole.select("key", F.flatten(F.col("parts.ids")).alias("ids"))


def ids_column(model: Pieces, text: Column | str) -> Column:
    """Ids of texts that are worked on in one piece."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in _some(batches):
            found = iter(model.encode_many([v if isinstance(v, str) else None for values in some for v in values]))
            for values in some:
                yield pd.Series([np.frombuffer(next(found), np.int32) for _ in range(len(values))])

    return encode(text)


def _some(batches: Iterator[pd.Series], characters: int = 1 << 20) -> Iterator[list[pd.Series]]:
    """Batches together, for work that gains from many texts at once, until they hold so many characters."""
    held: list[pd.Series] = []
    size = 0
    for values in batches:
        held.append(values)
        size += sum(len(v) for v in values if isinstance(v, str))
        if size >= characters:
            yield held
            held, size = [], 0
    if held:
        yield held


def text_column(model: Pieces, ids: Column | str) -> Column:
    """Text of a column of ids."""

    @F.pandas_udf(T.StringType())
    def decode(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else model.decode(v.tolist()) for v in values], dtype=object)

    return decode(ids)


def encode(docs: DataFrame, model: Pieces, text: str = "text", chunk: int = 1 << 15, name: str = "ids") -> DataFrame:
    """`docs` with a column of piece ids."""
    (name,) = free(docs, name)
    key, own = free(docs, "key", "own")
    long = F.coalesce(F.length(text) > chunk, F.lit(False))
    plain = docs.filter(~long).withColumn(name, ids_column(model, F.col(text)))
    giants = docs.filter(long).withColumn(key, F.sha2(F.col(text), 256))
    found = _encode_giants(giants.select(F.col(key).alias("key"), F.col(text).alias("text")), model, chunk)
    found = found.select(F.col("key").alias(own), F.col("ids").alias(name))
    with_ids = giants.join(found, F.col(key) == F.col(own), "left").select(*docs.columns, name)
    return plain.unionByName(with_ids)
