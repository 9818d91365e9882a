"""Fill-in-the-middle against splitting into lines, for texts that chunks, caches and batches cut in any way."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare, duck
from popmeasure.llm import fill_middle as fm
from popmeasure.llm.queries import QUERIES


def plain_fim(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or h[2] % 100 >= rate or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(seed, n):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé\n 龘🙂") for _ in range(rng.randrange(9000))) for _ in range(4)]
    out = [None, "", "\n", "\n\n", "a", "a\n", "\r\n ", "<P>", "a<S>b", "<M", "<", ">\n<", "P>\nS>\nM>\n<\n<"]
    for _ in range(n):
        body = [rng.choice(shared) if rng.random() < 0.5 else "x" * rng.randrange(40) for _ in range(rng.randrange(5))]
        out.append("\n".join(body) + rng.choice(["", "\n"]))
    return out + ["y" * 200_000 + "\n" + "z" * 70_000, "\n" * 70_000]


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 0), (100, 100), (0, 50)])
def test_equals_splitting_into_lines(spark, rate, spm_rate):
    rows = [(i if i % 11 else None, t, "x", "y") for i, t in enumerate(texts(rate, 60))]
    # columns named like the result's fields do no harm
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, output string").repartition(3)
    got = df.withColumn("fim", fm.fim_column("doc_id", "text", 7, rate, spm_rate))
    got = got.withColumn("back", fm.restored_column(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r.fim) == plain_fim(r.doc_id, r.text, 7, rate, spm_rate)
        assert r.back == (r.text or "") and (r.n, r.output) == ("x", "y")


def test_empty_table_and_rates(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert empty.select(fm.fim_column("doc_id", "text")).collect() == []
    with pytest.raises(ValueError, match="per cent"):
        fm.fim_column("doc_id", "text", rate=101)


def test_string_ids(spark):
    df = spark.createDataFrame([("a-1", "x\ny\nz")], "k string, t string")
    assert tuple(df.select(fm.fim_column("k", "t").alias("f")).first().f) == plain_fim("a-1", "x\ny\nz")


def chunks(text, bits=6):
    data = text.encode()
    points = fm.cut_points(np.frombuffer(data, np.uint8), np.array([0]), bits)
    return fm.chunks_of(data, [p for p in points.tolist() if p < len(data)])


def test_shared_passages_are_cut_alike():
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh \n") for _ in range(20_000))
    first, second = chunks("one " + passage), chunks("quite another start\n" + passage + "end")
    assert b"".join(first).decode() == "one " + passage and len(first) > 50
    assert len(set(first) & set(second)) >= len(first) - 3


def test_a_window_stays_within_its_text():
    data = np.frombuffer(b"a" * 50 + b"b" * 50, np.uint8)
    starts = np.array([0, 50])
    apart = [fm.cut_points(data[s : s + 50], np.array([0]), 1) + s for s in (0, 50)]
    assert fm.cut_points(data, starts, 1).tolist() == np.concatenate(apart).tolist()


def test_rolling_hash_is_the_sum_over_its_window():
    data = np.frombuffer(random.Random(2).randbytes(200), np.uint8)
    for i in range(fm.WINDOW - 1, 200, 7):
        want = sum(int(fm.GEAR[data[i - j]]) << j for j in range(fm.WINDOW)) & 0xFFFFFFFF
        assert int(fm.rolling_hash(data)[i]) == want


def test_cache_is_bounded_and_verified_by_content():
    cache = fm.ChunkCache(most=20_000)
    for i in range(1000):
        piece = b"%d\n" % i * 20
        assert cache.get(piece) == fm.summarise(piece) == cache.get(piece)
    assert sum(map(len, [*cache.new, *cache.old])) <= 20_000 and cache.hits >= 1000


def test_shared_chunks_are_summarised_once():
    passage = "".join(random.Random(9).choice("abcdefgh \n") for _ in range(20_000))
    cache = fm.ChunkCache()
    for start in ("a", "bb", "ccc"):
        where = fm.locate((start + passage).encode(), [], cache)
        assert where.n == (start + passage).count("\n") + (not passage.endswith("\n"))
    for start in ("a", "bb", "ccc"):
        text = (start + passage).encode()
        points = fm.cut_points(np.frombuffer(text, np.uint8), np.array([0]))
        fm.locate(text, points.tolist(), cache)
    assert cache.hits > cache.misses / 2


def test_query_equals_sql(spark, sf):
    assert compare(spark, duck(sf), "op11_fill_in_middle", sf) is None
    assert QUERIES["op11_fill_in_middle"](spark, sf).columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256",
    ]
