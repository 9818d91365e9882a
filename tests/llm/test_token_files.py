"""Token files: packing, random access, exact round trips, and ids equal to those of whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from popmeasure.llm import token_files as tf
from popmeasure.llm.common import table
from popmeasure.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("width", range(33))
def test_pack_and_unpack(width):
    values = np.random.default_rng(width).integers(0, 1 << width, (3, 64), dtype=np.uint64).astype(np.uint32)
    packed = tf.pack(values, width)
    assert packed.shape == (3, 2 * width) and (tf.unpack(packed, width, 64) == values).all()


def ids_of(kind, n, rng):
    if kind == "small":
        return rng.integers(40_000, 40_050, n)
    if kind == "outliers":
        return np.where(rng.random(n) < 0.05, rng.integers(0, 1 << 32, n), rng.integers(100, 200, n))
    return rng.integers(0, 1 << 32, n) if kind == "any" else np.full(n, 7)


@pytest.mark.parametrize("kind", ["small", "outliers", "any", "constant"])
@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 64, 1000])
def test_file_round_trip_and_random_access(kind, n):
    rng = np.random.default_rng(n)
    ids = ids_of(kind, n, rng).astype(np.uint32)
    cuts = sorted(rng.integers(0, n + 1, 3).tolist())
    counts = np.diff([0, *cuts, n]).tolist()
    reader = tf.FileReader(tf.file_bytes([3, None, -5, 3], counts, ids, block=32))
    assert reader.doc_ids == [3, None, -5, 3] and reader.n_ids == n
    assert (reader.ids(0, n) == ids).all()
    start = 0
    for k, count in enumerate(counts):
        assert (reader.document(k) == ids[start : start + count]).all()
        start += count
    for k in (2, 0, 3, 1):  # documents in any order
        assert len(reader.document(k)) == counts[k]


def test_outliers_do_not_widen_a_block():
    ids = np.full(1024, 1000, dtype=np.uint32) + np.arange(1024, dtype=np.uint32) % 16
    plain = len(tf.pack_blocks(ids)[0])
    ids[::50] = 4_000_000_000
    assert len(tf.pack_blocks(ids)[0]) == plain + 8 * 21  # 21 exceptions of two words each
    low, width, n = tf._BLOCK.unpack_from(tf.pack_blocks(ids)[0])
    assert (low, width, n) == (1000, 4, 21)


def test_random_access_unpacks_only_its_blocks(monkeypatch):
    ids = np.arange(32 * 50, dtype=np.uint32)
    reader, seen = tf.FileReader(tf.file_bytes([1], [len(ids)], ids, block=32)), []
    plain = tf.unpack_blocks
    monkeypatch.setattr(tf, "unpack_blocks", lambda d, starts, b: seen.append(len(starts)) or plain(d, starts, b))
    assert reader.ids(1000, 1040).tolist() == list(range(1000, 1040)) and seen == [2]
    with pytest.raises(ValueError, match="not a token file"):
        tf.FileReader(b"\0" * 100)


AWKWARD = "abXZ .,;:!?#*%'<|>012 \t\n\r\x0b\x0c\x1c\x85\xa0  éèß́क़ΣςİﬁDž龘🙂‍क्가𐐀²Ⅷ"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(AWKWARD), max_size=60) | st.text(max_size=30), max_size=8))
def test_words_give_the_ids_of_whole_texts(texts):
    encoder = _encoder_of_a_test()
    got = encoder.encode(texts)
    for text, found in zip(texts, got, strict=True):
        assert np.frombuffer(found, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


_made = []


def _encoder_of_a_test():
    if not _made:
        _made.append(tf.WordEncoder(PATH, most=200, longest=10))  # forgets all the time
    return _made[0]


def test_corpus_texts_give_the_ids_of_whole_texts(spark, sf, whole):
    encoder = tf.WordEncoder(PATH)
    texts = [r.text for r in table(spark, sf, "documents").select("text").collect()]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [whole(t) for t in texts]


def test_a_tokenizer_that_keeps_blanks_gets_whole_texts():
    encoder = tf.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.by_words
    text = "two words\n and\tmore"
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text).ids


def expected(rows, whole, end=1):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*whole(text), end], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("ids_per_file", [1, 500, 1 << 22])
def test_files_hold_all_documents_in_order(spark, whole, ids_per_file):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["one", "Two,", "drei", ""]) for _ in range(rng.randrange(80)))) for i in range(-40, 80)]
    rows += [(500, None), (501, ""), (None, "no id"), (502, "long " * 20_000), (503, " \n\t")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, start string").repartition(5)
    manifest = tf.write(df, PATH, ids_per_file=ids_per_file, block=64)
    back = tf.read(manifest).collect()
    got = sorted((r.start, r.doc_id, len(r.ids) // 4, zlib.crc32(r.ids)) for r in back)
    assert [(d, s, n, c) for s, d, n, c in got] == expected(rows, whole)
    files = manifest.orderBy("start").collect()
    assert sum(f.n_docs for f in files) == len(rows)
    assert [f.start for f in files] == [sum(g.n_ids for g in files[:k]) for k in range(len(files))]
    assert len(files) == len(rows) if ids_per_file == 1 else len(files) < 20


def test_repeated_ids_and_rows_stay(spark, whole):
    rows = [(7, "same text")] * 300 + [(7, "other"), (8, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = tf.round_trip(spark, df, PATH).collect()
    assert len(got) == 302 and [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [7] * 301 + [8]
    assert sorted(r.ids_crc32 for r in got) == sorted(x[3] for x in expected(rows, whole))


def test_orphans_of_repeated_tasks_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    manifest = tf.write(df, PATH, folder=str(tmp_path / "ids"))
    (tmp_path / "ids" / "ids-000000-00000-orphan.pfor").write_bytes(b"half a file")
    assert sorted(r.doc_id for r in tf.read(manifest).collect()) == [1, 2]


def test_empty_table_and_bad_arguments(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tf.round_trip(spark, empty, PATH).collect() == []
    with pytest.raises(ValueError, match="whole numbers"):
        tf.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH)
    with pytest.raises(ValueError, match="multiple of 32"):
        tf.write(empty, PATH, block=100)


def test_query_equals_whole_texts(spark, sf, whole):
    got = QUERIES["op12_token_files"](spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows, whole))
