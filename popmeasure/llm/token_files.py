"""Token ids of documents as binary files of patched frame-of-reference blocks.

Documents are dealt to tasks by ranges of their id, each task encodes its documents in order and writes files of
`ids_per_file` ids or a little more (a document lies in one file). What the tasks report, one row a file, is stored as
the manifest; only files that it names belong to the result. Every attempt of a task writes under names of its own, so
a lost executor or a repeated task leaves orphans that nobody reads, never half a file. The texts are shuffled once.

File, little-endian throughout:

    header      magic, block length, number of ids, of blocks and of documents; where index and documents start
    blocks      minimum, width, number of exceptions; the ids less the minimum in `width` bits each; for each id that
                does not fit, its place in the block and its whole value less the minimum
    index       where each block starts
    documents   id, whether it is null, and number of ids of each document

The width of a block holds `percentile` of its values, so one rare id does not widen the rest. A document's ids follow
from the documents table (where it starts) and from the index: `FileReader.ids(start, end)` unpacks the blocks it
touches and no others.

Nulls and edges: a null text counts as empty and is its end id alone; a null document id comes first; documents of one
id stand in the order of the input, repeated rows included; an empty table gives no file. Texts are encoded whole.
Only the id and the text are read, so other columns may have any name. The id must be a whole number.

Words between blanks, tabs and line ends are encoded once and remembered (the tokenizer drops white space and never
joins across it, so its ids of a text are those of its words in a row; a test compares them with whole texts).
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popmeasure.llm.common import shared_dir, ship, written

MAGIC = b"PFORIDS1"
_HEADER = struct.Struct("<8sIQQQQQ")
_BLOCK = struct.Struct("<IBI")
BLOCK = 1024
#: Marks that never join the letters before them; the apostrophe and the brackets of special tokens can.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
LANES = 32  # values that share whole words: 32 values of w bits are w words


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of a multiple of 32 uint32 values, each below 2**width, as rows of words."""
    rows, n = values.shape
    groups = values.reshape(rows, n // LANES, LANES)
    out = np.zeros((rows, n // LANES, width), dtype=np.uint32)
    for lane in range(LANES if width else 0):
        word, shift = divmod(lane * width, 32)
        out[:, :, word] |= groups[:, :, lane] << np.uint32(shift)
        if shift + width > 32:
            out[:, :, word + 1] |= groups[:, :, lane] >> np.uint32(32 - shift)
    return out.reshape(rows, -1)


def unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """The inverse of `pack`: rows of `n` values."""
    rows = len(words)
    out = np.zeros((rows, n // LANES, LANES), dtype=np.uint32)
    if width:
        groups = words.reshape(rows, n // LANES, width)
        mask = np.uint32((1 << width) - 1)
        for lane in range(LANES):
            word, shift = divmod(lane * width, 32)
            value = groups[:, :, word] >> np.uint32(shift)
            if shift + width > 32:
                value = value | (groups[:, :, word + 1] << np.uint32(32 - shift))
            out[:, :, lane] = value & mask
    return out.reshape(rows, n)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that hold each value; 0 for 0."""
    return np.frexp(values.astype(np.float64))[1]


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = 0.9) -> list[bytes]:
    """The ids in blocks of `block`, a multiple of 32; a short last block is filled up with its minimum."""
    n_blocks = -(-len(ids) // block)
    if not n_blocks:
        return []
    full = np.full(n_blocks * block, ids[(n_blocks - 1) * block :].min(), dtype=np.uint32)
    full[: len(ids)] = ids
    grid = full.reshape(n_blocks, block)
    low = grid.min(axis=1)
    deltas = grid - low[:, None]
    held = max(0, min(block - 1, int(np.ceil(percentile * block)) - 1))
    widths = _bits(np.partition(deltas, held, axis=1)[:, held])
    out: list[bytes] = [b""] * n_blocks
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        part = deltas[rows]
        over = part >> np.uint32(width) != 0 if width < 32 else np.zeros(part.shape, dtype=bool)
        words = pack(np.where(over, np.uint32(0), part), width)
        for k, row in enumerate(rows.tolist()):
            at = np.flatnonzero(over[k]).astype("<u4")
            out[row] = b"".join(
                (_BLOCK.pack(int(low[row]), width, len(at)), words[k].tobytes(), at.tobytes(), part[k, at].tobytes())
            )
    return out


def unpack_blocks(data: bytes, starts: list[int], block: int) -> np.ndarray:
    """The ids of the blocks that start there, one after the other; blocks of one width are unpacked together."""
    heads = [_BLOCK.unpack_from(data, at) for at in starts]
    out = np.empty((len(starts), block), dtype=np.uint32)
    by_width: dict[int, list[int]] = {}
    for k, (_, width, _) in enumerate(heads):
        by_width.setdefault(width, []).append(k)
    for width, rows in by_width.items():
        n_words = block // LANES * width
        words = [np.frombuffer(data, "<u4", n_words, starts[k] + _BLOCK.size) for k in rows]
        out[rows] = unpack(np.stack(words), width, block)
    for k, (low, width, n_over) in enumerate(heads):
        at = starts[k] + _BLOCK.size + 4 * (block // LANES * width)
        if n_over:
            out[k, np.frombuffer(data, "<u4", n_over, at)] = np.frombuffer(data, "<u4", n_over, at + 4 * n_over)
        out[k] += np.uint32(low)
    return out.reshape(-1)


def file_bytes(
    doc_ids: list[int | None], counts: list[int], ids: np.ndarray, block: int = BLOCK, percentile: float = 0.9
) -> bytes:
    blocks = pack_blocks(ids, block, percentile)
    starts = np.array(list(accumulate(map(len, blocks), initial=_HEADER.size)), dtype="<u8")
    index_at = int(starts[-1])
    docs_at = index_at + 8 * len(blocks)
    header = _HEADER.pack(MAGIC, block, len(ids), len(blocks), len(doc_ids), index_at, docs_at)
    return b"".join(
        (
            header,
            *blocks,
            starts[:-1].tobytes(),
            np.array([0 if i is None else i for i in doc_ids], dtype="<i8").tobytes(),
            np.array([i is None for i in doc_ids], dtype=np.uint8).tobytes(),
            np.array(counts, dtype="<u8").tobytes(),
        )
    )


class FileReader:
    """A file of this format in memory; blocks are unpacked when they are asked for."""

    def __init__(self, data: bytes):
        self.data = data
        magic, self.block, self.n_ids, n_blocks, n_docs, index_at, at = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.starts = np.frombuffer(data, "<u8", n_blocks, index_at)
        numbers = np.frombuffer(data, "<i8", n_docs, at).tolist()
        null = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs).tolist()
        self.doc_ids = [None if gone else i for i, gone in zip(numbers, null, strict=True)]
        self.counts = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self._first, self._held = 0, np.zeros(0, dtype=np.uint32)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids `start` to `end` of the file; the blocks unpacked last are kept, as documents share blocks."""
        first, last = start // self.block, -(-end // self.block)
        if first < self._first or last * self.block > self._first * self.block + len(self._held):
            self._first = first
            self._held = unpack_blocks(self.data, self.starts[first:last].tolist(), self.block)
        base = self._first * self.block
        return self._held[start - base : end - base]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's document `k`."""
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1]))


class StaysLetter(dict[str, bool]):
    """Whether a letter still ends with a letter when it is normalised; some become a letter and a mark."""

    def __init__(self, normalizer: object):
        self.normalizer = normalizer

    def __missing__(self, letter: str) -> bool:
        out = self.normalizer.normalize_str(letter) if self.normalizer else letter
        self[letter] = out[-1:].isalpha()
        return self[letter]


class WordEncoder:
    """Texts to ids as little-endian uint32 bytes, by words that are remembered.

    Up to `most` words of up to `longest` characters, in two generations: a word of the older half that occurs again
    moves to the newer one, the rest is forgotten when that one is full. A tokenizer that does not drop the blank
    between two words gets whole texts.
    """

    def __init__(self, tokenizer_path: str, most: int = 1 << 20, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.half, self.longest = most // 2, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        both, one, two = (self._ids([t])[0] for t in ("a b", "a", "b"))
        self.by_words = both == one + two
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a run of letters
        self.stays_letter = StaysLetter(self.tokenizer.normalizer)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only, encoded as one text: each is one run of letters, and ends with its only closing token.

        Every word has such a token, so as many as there are words means one each; else (letters that normalisation
        splits) the words are encoded one by one.
        """
        (joined,) = self._ids([" ".join(words)])
        ends = np.flatnonzero(self.closes[np.frombuffer(joined, "<u4")]) + 1
        if len(ends) != len(words):
            return self._ids(words)
        ends = (4 * ends).tolist()
        return [joined[a:b] for a, b in zip([0, *ends], ends)]

    def _encode_new(self, words: list[str]) -> dict[str, bytes]:
        """A run of marks behind a letter is a run of its own, so it is encoded apart."""
        stems = [w.rstrip(MARKS) for w in words]
        plain = list({s for s in stems if s.isalpha() and self.stays_letter[s[-1]]})
        marks = list({w[len(s) :] for w, s in zip(words, stems, strict=True)})
        letters = dict(zip(plain, self._letters(plain), strict=True)) if plain else {}
        tails = dict(zip(marks, self._ids(marks), strict=True))
        rest = [w for w, s in zip(words, stems, strict=True) if s not in letters]
        out = dict(zip(rest, self._ids(rest), strict=True))
        out.update((w, letters[s] + tails[w[len(s) :]]) for w, s in zip(words, stems, strict=True) if s in letters)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return self._ids([t or "" for t in texts])
        split = [(t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") for t in texts]
        known, older = self.known, self.older
        new = []
        for w in set().union(*split):
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        if new:
            known.update(self._encode_new(new))
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > self.longest:
                del self.known[w]
        if len(self.known) > self.half:
            self.older, self.known = self.known, {}
        return out


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _write(
    batches: Iterable[pa.RecordBatch], folder: str, tokenizer_path: str, end_id: int, ids_per_file: int, block: int, percentile: float
) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder, files = _encoder(tokenizer_path), None
    part, number = TaskContext.get().partitionId(), 0
    end = np.array([end_id], dtype="<u4").tobytes()
    doc_ids: list[int | None] = []
    counts: list[int] = []
    held: list[bytes] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal files, number, size, doc_ids, counts, held
        store, root = files = files or fs.FileSystem.from_uri(folder)
        if not number:
            store.create_dir(root, recursive=True)
        name = f"ids-{part:06d}-{number:05d}-{uuid.uuid4().hex}.pfor"
        data = file_bytes(doc_ids, counts, np.frombuffer(b"".join(held), "<u4"), block, percentile)
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
        row = {"part": part, "number": number, "file": name, "n_docs": len(doc_ids), "n_ids": size, "n_bytes": len(data)}
        number, size, doc_ids, counts, held = number + 1, 0, [], [], []
        return pa.RecordBatch.from_pylist([row], MANIFEST_ARROW)

    for batch in batches:
        for doc, found in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
            n = len(found) // 4 + 1
            doc_ids.append(doc)
            counts.append(n)
            held += (found, end)
            size += n
            if size >= ids_per_file:
                yield close()
    if doc_ids:
        yield close()


MANIFEST = "part int, number int, file string, n_docs long, n_ids long, n_bytes long"
MANIFEST_ARROW = pa.schema(
    [("part", pa.int32()), ("number", pa.int32()), ("file", pa.string())]
    + [(c, pa.int64()) for c in ("n_docs", "n_ids", "n_bytes")]
)


def write(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 1,
    ids_per_file: int = 1 << 23,
    block: int = BLOCK,
    percentile: float = 0.9,
) -> DataFrame:
    """Write the ids of `docs`, in ascending order of their id, and return the manifest with the folder of the files.

    `folder` is a path or URI that all executors reach (by default a new one below `spark.checkpoint.dir`).
    `tokenizer_path` must be there on all of them. A document longer than a file stays whole. A task holds the ids of
    one file.
    """
    spark = docs.sparkSession
    ship(spark)
    if docs.schema[id_column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("document ids must be whole numbers")
    if block % LANES or block <= 0:
        raise ValueError(f"a block holds a multiple of {LANES} ids")
    folder = folder or f"{shared_dir(spark).rstrip('/')}/llm-ids-{uuid.uuid4().hex}"
    own = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{text_column}`").alias("text"),
        F.monotonically_increasing_id().alias("tie"),  # keeps repeated ids in order, and splits a hot one
    )
    order = [F.col("id").asc_nulls_first(), F.col("tie").asc()]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    rows = dealt.mapInArrow(
        lambda batches: _write(batches, folder, tokenizer_path, end_id, ids_per_file, block, percentile), MANIFEST
    )
    return with_starts(written(rows), folder)


def with_starts(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with `path` and `start`, the ids in all files before. One small row a file passes the driver."""
    rows = sorted(tuple(r) for r in manifest.collect())
    starts = accumulate((r[4] for r in rows), initial=0)
    full = [(*r, f"{folder}/{r[2]}", start) for r, start in zip(rows, starts)]
    return manifest.sparkSession.createDataFrame(full, f"{MANIFEST}, path string, start long")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name) as data:
                reader = FileReader(data.read())
            for first in range(0, len(reader.doc_ids), 200):
                some = range(first, min(first + 200, len(reader.doc_ids)))
                reader.ids(int(reader.offsets[some.start]), int(reader.offsets[some.stop]))  # their blocks at once
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([reader.doc_ids[k] for k in some], pa.int64()),
                        pa.array([start + int(reader.offsets[k]) for k in some], pa.int64()),
                        pa.array([reader.document(k).astype("<u4").tobytes() for k in some], pa.binary()),
                    ],
                    names=["doc_id", "start", "ids"],
                )


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document of the files: its place among all ids, and its ids as uint32 bytes."""
    ship(manifest.sparkSession)
    files = manifest.select("path", "start")
    n = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism * 64))
    return files.repartitionByRange(n, "path").mapInArrow(_read, "doc_id long, start long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options: int) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens (with the end id), and the CRC-32 of its ids' bytes."""
    back = read(write(docs, tokenizer_path, **options))
    return back.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
