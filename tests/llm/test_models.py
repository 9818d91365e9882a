"""URL filter, nearest vectors, pieces and language-model scores on small tables against brute force."""

import math
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from popmeasure.llm import neighbours, pieces, pitman_yor, url_filter
from popmeasure.llm.common import table
from popmeasure.llm.queries import RULES, VOCABULARY
from popmeasure.llm.words import spaced_words

# --- URL filter ------------------------------------------------------------------------------------------------------


def test_rules_and_odd_urls(spark):
    urls = [
        (1, "http://a.example.NET/en/1", "allow", "example.net/en/"),
        (2, "https://example.net/fr/1?q", "block", "net/"),
        (3, "http://x.example.com/de/", "block", "example.com/de/"),
        (4, "http://org/fr/x", "allow", "org/fr/"),
        (5, "http://notexample.com/de/", None, None),
        (6, "http://a.net", None, None),
        (7, None, "allow", None),
        (8, "no scheme", "allow", None),
        (8, "no scheme", "allow", None),
        (9, "http://b.org#frag", None, None),
    ]
    pages = spark.createDataFrame([(a, b, "own") for a, b, *_ in urls], "page_id long, url string, score string")
    got = {(r["page_id"]): r for r in url_filter.judge(pages, RULES).collect()}
    for i, _, verdict, rule in urls:
        assert got[i]["rule"] == rule and got[i]["verdict"] in ([verdict] if verdict else ["allow", "block"])
    assert (got[1]["host"], got[1]["path"]) == ("a.example.net", "/en/1")
    assert (got[9]["host"], got[9]["path"], got[7]["host"], got[7]["path"]) == ("b.org", "", "", "")
    assert got[1]["score"] == "own" and isinstance(got[1]["_score"], float)
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def brute_delta(texts, text, order, share):
    """Mean log ratio with the same smoothing, from plain dictionaries."""
    sign = lambda c: url_filter.ALPHABET.find(c)
    counts = [[Counter() for _ in range(order + 1)] for _ in range(2)]
    totals = [Counter() for _ in range(order + 1)]
    for label, t in texts:
        padded = "^" * order + t
        for i in range(order, len(padded)):
            for n in range(order + 1):
                counts[label][n][padded[i - n : i], sign(padded[i])] += 1
                totals[n][padded[i - n : i]] += 1

    def kept(n, context):
        return totals[n][context] and totals[n][context] >= share * sum(totals[n].values())

    def p(label, n, context, c):
        shorter = p(label, n - 1, context[1:], c) if n else 1 / url_filter.SIGNS
        seen = {s: v for (x, s), v in counts[label][n].items() if x == context}
        total = sum(seen.values()) + len(seen)
        return (seen.get(c, 0) + len(seen) * shorter) / total if total else shorter

    padded, out = "^" * order + text, 0.0
    for i in range(order, len(padded)):
        n = max(k for k in range(order + 1) if all(kept(m, padded[i - m : i]) for m in range(k + 1)))
        out += math.log(p(1, n, padded[i - n : i], sign(padded[i]))) - math.log(p(0, n, padded[i - n : i], sign(padded[i])))
    return out / len(text) if text else 0.0


def test_url_scores_equal_brute_force(spark):
    rng = random.Random(8)
    make = lambda letters: "http://" + "".join(rng.choice(letters) for _ in range(12)) + "/é"
    good = [make("abc./") for _ in range(40)]
    bad = [make("abx1.") for _ in range(40)]
    frames = [spark.createDataFrame([(u,) for u in us], "url string") for us in (good, bad)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good[:5] + bad[:5])], "page_id long, url string")
    got = url_filter.judge(pages, (), accepted=frames[0], rejected=frames[1], least_share=0.01).orderBy("page_id")
    training = spark.createDataFrame(
        [(label, u.split("://")[1].replace("é", "~")) for label, us in ((1, good), (0, bad)) for u in us],
        "label int, signs string",
    )
    used = training.filter(F.pmod(F.xxhash64("signs"), F.lit(5)) != 0).collect()
    for row in got.collect():
        text = row["url"].split("://")[1].replace("é", "~")
        want = brute_delta([(r["label"], r["signs"]) for r in used], text, 3, 0.01)
        assert math.isclose(row["score"], want, abs_tol=1e-9)


def test_rare_contexts_of_a_large_corpus_count(spark):
    """Words on few of many training URLs, in every one of their contexts under 1/4096 of the positions."""
    common = [(f"http://a.org/{i % 10}{i // 10 % 10}{i // 100 % 10}{i // 1000}",) for i in range(4000)]
    good, bad = ([(f"http://a.org/{w}{i % 10}",) for i in range(10)] for w in ("qzqx", "zqxq"))
    frames = [spark.createDataFrame(common + rare, "url string") for rare in (good, bad)]
    pages = spark.createDataFrame([(1, good[0][0]), (0, bad[0][0])], "page_id long, url string")
    got = {r["page_id"]: r["score"] for r in url_filter.judge(pages, (), accepted=frames[0], rejected=frames[1]).collect()}
    training = [(k, r["url"].split("://")[1]) for k in (0, 1) for r in frames[1 - k].collect()]
    rows = spark.createDataFrame(training, "label int, signs string")
    used = [(r["label"], r["signs"]) for r in rows.filter(F.pmod(F.xxhash64("signs"), F.lit(5)) != 0).collect()]
    for i, (url,) in ((1, good[0]), (0, bad[0])):
        assert math.isclose(got[i], brute_delta(used, url.split("://")[1], 3, 0.0), abs_tol=1e-9)
    assert got[1] > got[0] + 0.1


# --- nearest vectors -------------------------------------------------------------------------------------------------


def test_nearest_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    x = (centres[np.arange(400) % 20] + 0.3 * rng.standard_normal((400, 16))).astype(np.float32)
    x[100:120] = x[100]  # equal vectors
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [1.0, None] * 8, 0)]
    rows += [(504, [1.0], 0), (None, [1.0] * 16, 0), (3, rows[3][1], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    asked = vectors.filter("vec_id % 50 = 0")
    got = neighbours.nearest(vectors, asked, block=150, query_block=3).orderBy("query_id", "rank").collect()
    exact = x.astype(np.float64)
    norms = np.sqrt((exact * exact).sum(axis=1))
    hits = 0
    for q in range(0, 400, 50):
        cosine = (exact * exact[q]).sum(axis=1) / (norms * norms[q])
        want = sorted((-round(c, 12), i) for i, c in enumerate(cosine) if i != q)[:5]
        own = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(math.isclose(r["score"], cosine[r["vec_id"]], abs_tol=1e-12) for r in own)
        hits += len({i for _, i in want} & {r["vec_id"] for r in own})
    assert {r["query_id"] for r in got} == set(range(0, 400, 50)) and hits >= 0.9 * 40
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == [101, 102, 103, 104, 105]


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in neighbours.nearest(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert neighbours.nearest(few.limit(0), few.limit(0)).count() == 0


def test_bounded_windows_verify_few_vectors_and_keep_the_nearest():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    queries, part, k = x[:40], x[6_000:], 5
    cosine = queries @ x.T
    reached = np.sort(cosine[:, 40:6_000], axis=1)[:, -k]  # what the queries found in another part
    bounds = np.sqrt(2 - 2 * reached) + 1e-6
    hits = neighbours.search_block(queries, part, bounds, k + 1, 192, 0.83, 1.5, 1.2, 7)
    assert sum(map(len, hits)) < 0.1 * 40 * len(part)
    wanted = [set(np.flatnonzero(cosine[i, 6_000:] > reached[i])) for i in range(40)]
    caught = sum(len(w & set(h.tolist())) for w, h in zip(wanted, hits, strict=True))
    assert caught >= 0.9 * sum(map(len, wanted))


def test_a_query_with_a_bound_takes_one_round(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    m, need, bounds = 24, 20, rng.uniform(0.7, 1.2, 10)
    lookups, searchsorted = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: lookups.append(1) or searchsorted(*a, **k))
    hits = neighbours.search_block(x[:10], x, bounds, 6, m, need / m, 1.5, 1.2, 7)
    assert len(lookups) <= 2 * m
    directions = np.random.default_rng(7).standard_normal((m, 16))
    directions /= np.linalg.norm(directions, axis=1)[:, None]
    for q, bound, found in zip(x, bounds, hits, strict=False):
        within = np.abs((x - q) @ directions.T) <= 1.5 / 4 * bound
        assert sorted(found.tolist()) == np.flatnonzero(within.sum(axis=1) >= need).tolist()


@pytest.mark.parametrize("n", [300, 70_000])
def test_wide_windows_are_counted_like_narrow_ones(n):
    rng = np.random.default_rng(8)
    order = np.stack([rng.permutation(n) for _ in range(7)])
    place = np.argsort(order, axis=1).astype(np.uint16 if n < 1 << 16 else np.uint32)
    for width in (0, 1, n // 100, n // 3, n):
        low = rng.integers(0, n - width + 1, 7)
        want = np.zeros(n, int)
        for own, start in zip(order, low, strict=True):
            want[own[start : start + width]] += 1
        assert (neighbours.window_counts(order, place, low, low + width) == want).all()


def test_nearest_vectors_through_several_waves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WAVE", 2)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>, ids string, rank int")
    got = neighbours.nearest(vectors, vectors.filter("vec_id % 30 = 0"), vector="v", block=30, query_block=4).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 300, 30):
        cosine = unit @ unit[q]
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [rank for rank, _ in own] == [1, 2, 3, 4, 5]
        want = sorted((-c, i) for i, c in enumerate(cosine) if i != q)[:5]
        hits += len({i for _, i in want} & {i for _, i in own})
    assert hits >= 0.9 * 50


# --- pieces ----------------------------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load(VOCABULARY)


def random_text(rng, n):
    return "".join(rng.choice(["the", "lich", "ung", " ", "ñ", "é", "\n", "a", "b", "  ", "😀"]) for _ in range(n))


@needs_vocabulary
def test_pieces_equal_the_library_with_the_same_scores(model):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    file = proto.ModelProto()
    with open(VOCABULARY, "rb") as f:
        file.ParseFromString(f.read())
    file.trainer_spec.model_type = 1  # best path instead of merges
    for piece in file.pieces:
        if piece.piece in model.scores:
            piece.score = model.scores[piece.piece] / pieces.SCALE
    library = sentencepiece.SentencePieceProcessor(model_proto=file.SerializeToString())
    rng = random.Random(1)
    for text in ["Hello  world", "  a\nb\t c ", "x\r\ny", ""] + [random_text(rng, rng.randint(1, 15)) for _ in range(200)]:
        assert model.encode(text) == library.encode(text)
        assert model.decode(model.encode(text)) == text


def total(model, ids):
    out = 0
    for i in ids:
        piece = model.surface[i].decode("utf-8", "ignore").replace(" ", pieces.SPACE)
        out += model.scores[piece] if model.ids.get(piece) == i else 0
    return out


@needs_vocabulary
@pytest.mark.parametrize("chunk", [20, 37, 64, 97])
def test_chunks_give_the_ids_of_the_undivided_text(spark, sf, model, chunk):
    rng = random.Random(chunk)
    texts = [random_text(rng, rng.randint(30, 120)) for _ in range(30)] + ["thelichungabc" * 40, "\n" * 99, " " * 150]
    texts += [r.text for r in table(spark, sf, "documents").select("text").limit(150).collect() if r.text]
    for text in texts:
        whole = pieces.prepared(text)
        starts = list(range(0, max(len(whole) - model.longest, 1), chunk))
        ends = [*starts[1:], len(whole)]
        parts = [(whole[a : b + model.longest], b - a) for a, b in zip(starts, ends, strict=True)]
        reached = pieces.reached_before(np.stack([model.transfer(*p) for p in parts]))
        states = pieces.states_of([model.entries(*p, r) for p, r in zip(parts, reached, strict=True)])
        ids = model.between([(*p, a, b) for p, a, b in zip(parts, states, states[1:], strict=False)])
        assert np.concatenate(ids).tolist() == model.encode(text)


def test_ties_do_not_depend_on_the_cut():
    """All pieces score alike a character, so every segmentation is a best one."""
    scores = {p: -10 * len(p) for p in ("a", "b", "ab", "ba", "aba", "bab", "▁", "▁a", "▁b")}
    model = pieces.Pieces.of(scores, {p: i for i, p in enumerate(scores)}, [0] * 256, [p.encode() for p in scores])
    rng = random.Random(0)
    for _ in range(60):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 80)))
        whole, found = pieces.prepared(text), []
        for chunk in (3, 4, 7, 500):
            starts = list(range(0, max(len(whole) - model.longest, 1), chunk))
            ends = [*starts[1:], len(whole)]
            parts = [(whole[a : b + model.longest], b - a) for a, b in zip(starts, ends, strict=True)]
            reached = pieces.reached_before(np.stack([model.transfer(*p) for p in parts]))
            states = pieces.states_of([model.entries(*p, r) for p, r in zip(parts, reached, strict=True)])
            ids = model.between([(*p, a, b) for p, a, b in zip(parts, states, states[1:], strict=False)])
            found.append(np.concatenate(ids).tolist())
        assert all(f == model.encode(text) for f in found)


@needs_vocabulary
def test_units_solved_together_equal_units_solved_alone(model):
    rng = random.Random(5)
    letters = ["a", "e", "the", "▁", "ng", "é", "龘", "😀", "-", "qx", "\n"]
    units = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(800)}) + ["e" * 64, "e" * 65]
    got = model.solve(units)
    for unit in units:
        best, came = model.forward(unit, 0, len(unit))
        assert np.frombuffer(got[unit], np.int32).tolist() == model.traced(unit, came, len(unit), 0)


def test_scan_is_the_running_product():
    rng = np.random.default_rng(0)
    m = rng.integers(-50, 0, (9, 4, 4))
    got, now = pieces.scan(m), m[0]
    for k in range(1, 9):
        now = pieces.times(now, m[k])
        assert (got[k] == now).all()


@needs_vocabulary
def test_encode_rows(spark, documents, model):
    got = pieces.encode(documents.withColumn("ids", F.lit("own")), model, chunk=1000)
    assert got.columns == [*documents.columns, "ids", "_ids"] and got.count() == 10
    for r in got.collect():
        assert list(r["_ids"]) == model.encode(r["text"])
        assert model.decode(r["_ids"]) == (r["text"] or "")
    assert pieces.encode(documents.limit(0), model).count() == 0


# --- language model --------------------------------------------------------------------------------------------------


def test_base_scores_and_proper_probabilities(spark, documents, tmp_path):
    documents.select("doc_id", "text").repartition(3).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    train = F.coalesce(F.col("doc_id") != 2, F.lit(True))
    got = pitman_yor.score(stored, train).collect()
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    counts = Counter(w for i, t in rows if i != 2 for w in [*spaced_words(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), len(words), sum(counts[w] > 0 for w in words),
         round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 6))
        for i, words in ((i, [*spaced_words(t), b""]) for i, t in rows)
    )
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 and r["perplexity"] > 1 for r in got)
    again = {(str(r["doc_id"]), r["score"]) for r in pitman_yor.score(stored, train).collect()}
    assert again == {(str(r["doc_id"]), r["score"]) for r in got}


def test_word_order_counts(spark, tmp_path):
    rng = random.Random(3)
    phrase = "we hold these truths to be self evident".split()
    rows = [(i, " ".join(phrase)) for i in range(60)] + [(100, " ".join(phrase)), (101, " ".join(rng.sample(phrase, 8)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    got = pitman_yor.score(spark.read.parquet(str(tmp_path / "docs")), F.col("doc_id") < 100).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 62 and score[100] > score[101] + 5


def test_words_met_once_are_no_rows_of_the_sweeps(spark, tmp_path, monkeypatch):
    rows = [(i, f"one two one w{i}") for i in range(40)] + [(100, "two new")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    drawn, seated = [], pitman_yor._seated

    def run(rows, names, *rest):
        if names == ["id"]:
            drawn.append({bytes(r["word"]) for r in rows.select("word").collect()})
        return seated(rows, names, *rest)

    monkeypatch.setattr(pitman_yor, "_seated", run)
    got = pitman_yor.score(spark.read.parquet(str(tmp_path / "docs")), F.col("doc_id") < 100).collect()
    assert drawn == [{b"", b"one", b"two"}] * 4
    assert len(got) == 41 and all(r["score"] < 0 for r in got)


def test_batches_of_large_rows_are_bounded_in_bytes(spark, tmp_path):
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"n": [len(frame)]})

    large = spark.range(24, numPartitions=1).select(F.expr("unhex(repeat('ab', 1 << 20))").alias("x"))
    large.write.parquet(str(tmp_path / "large"))
    store = pitman_yor._Store()
    found = store("found", spark.read.parquet(str(tmp_path / "large")).mapInPandas(run, "n long")).collect()
    assert sum(r["n"] for r in found) == 24 and max(r["n"] for r in found) <= 5
    zipped = store("zipped", spark.range(9), zipped=True)
    assert zipped.count() == 9 and not [f for f in os.listdir(store.paths["zipped"].removeprefix("file:")) if "snappy" in f]
    store.drop(spark, "found")
    store.drop(spark, "zipped")


def test_without_training_rows(spark, documents):
    got = pitman_yor.score(documents, F.lit(False)).collect()
    assert len(got) == 10 and {r["train_tokens"] for r in got} == {0}
    uniform = -math.log10(pitman_yor.ALL_CHARACTERS)
    assert all(math.isclose(r["score"], uniform, rel_tol=1e-9) for r in got if r["n_tokens"] == 1)


def test_seats_stay_between_one_table_and_one_each():
    rng = np.random.default_rng(0)
    customers = np.array([0, 1, 2, 50, 1000, 1_000_000])
    got = pitman_yor.seat(customers, np.full(6, 1e-3), np.full(6, 100.0), 0.5, 1.0, lambda rows, _: rng.random(len(rows)))
    assert got[0] == 0 and got[1] == 1 and (got <= customers).all() and (got[1:] >= 1).all()


def test_spelling_sums_to_one():
    rows = {("ab", "c"): 5.0, ("ab", "d"): 2.0, ("b", "c"): 1.0}
    import pandas as pd

    frame = pd.DataFrame([(c, ch, n) for (c, ch), n in rows.items()], columns=["context", "character", "n"])
    out = pitman_yor._sample_subtree(frame, {"c": 0.4, "d": 0.3}, 2, 5, 2, 1)
    values = {(r.kind, r.name_): r.value for r in out.rename(columns={"name": "name_"}).itertuples()}
    for context in ("ab", "b"):
        held = sum(v for (kind, name), v in values.items() if kind == "held" and name[:-1] == context)
        assert math.isclose(held + values["back", context], 1.0, abs_tol=1e-9)


def test_spelled_words_equal_the_rules_applied_directly(spark):
    import pandas as pd

    texts = ["cab", "abab", "cabs", "scab", "bab", "", "é" * 40, "unmet\u4e2d", "abab" * 300]
    trained = [3.0, 5.0, 1.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0]
    rows = [(i, w.encode(), t, 0.0) for i, (w, t) in enumerate(zip(texts, trained, strict=True))]
    words = spark.createDataFrame(rows, "id long, word binary, t double, spelled double")
    grams = pitman_yor._fit(pitman_yor._Store(), pitman_yor._spelled(words, 3), 3, 11, 2, 4)
    got = {r["id"]: r["spelled"] for r in pitman_yor._with_spelling(words, grams, 3).collect()}
    counts = Counter()
    for _, word, t, _ in rows:
        for gram in pitman_yor._grams(word, 3):
            counts[gram] += t

    def root(customers):
        total = 1.0 + sum(customers.values())
        held = {ch: max(n - 0.3, 0) / total for ch, n in customers.items()}
        other = (1 - sum(held.values())) / pitman_yor.ALL_CHARACTERS
        return lambda ch: held.get(ch, 0.0) + other

    met = Counter(g[-1] for g, n in counts.items() if n)
    first, held, back, sent = root(met), {}, {}, Counter()
    for last in {g[2] for g, n in counts.items() if n}:
        own = [(g[:3], g[3], n) for g, n in counts.items() if n and g[2] == last]
        frame = pd.DataFrame(own, columns=["context", "character", "n"])
        for r in pitman_yor._sample_subtree(frame, {ch: first(ch) for ch in met}, 3, 6, 2, 11).itertuples(index=False):
            if r.kind == "root":
                sent[r.name] += r.value
            else:
                (held if r.kind == "held" else back)[r.name] = r.value
    at_root = root(sent)

    def behind(gram):
        p = at_root(gram[3])
        for own in (gram[2:3], gram[1:3], gram[:3]):
            if own not in back:
                return p
            p = held.get(own + gram[3], 0.0) + back[own] * p
        return p

    for i, word, _, _ in rows:
        want = sum(math.log10(behind(g)) for g in pitman_yor._grams(word, 3))
        assert math.isclose(got[i], want, abs_tol=1e-6), word


def test_runs_of_many_words_at_once_equal_those_of_each():
    every = "".join(chr(c) for c in range(0x100, 0xC500))  # more characters than four digits of 62 bits tell apart
    words = [b"cab", b"", "é龘😀".encode(), b"\xff\xfe", f"a{pitman_yor.START}{pitman_yor.END}".encode(), b"ab" * 70, every.encode()]
    for part in (words, words[:-1], words[1:2]):
        grams, at, starts = pitman_yor._grams_of(part, 3)
        assert len(set(grams)) == len(grams)
        found = [grams[i] for i in at]
        for word, a, b in zip(part, starts, [*starts[1:], len(at)], strict=True):
            assert found[a:b] == list(pitman_yor._grams(word, 3))


def test_a_bucket_of_words_asks_for_each_run_once(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_WORDS", 40)
    rows = [(i, b"ab" * i + b"c", float(i % 3), -1.0) for i in range(200)]
    words = spark.createDataFrame(rows, "id long, word binary, t double, spelled double")
    asked = pitman_yor._asked(words, 3)
    kinds = {g for _, word, _, _ in rows for g in pitman_yor._grams(word, 3)}
    assert asked.select("bucket").distinct().count() == 5 and asked.count() <= 5 * len(kinds)
    assert asked.select("bucket", "context", "character").distinct().count() == asked.count()
    counts = Counter()
    for _, word, t, _ in rows:
        for gram in pitman_yor._grams(word, 3):
            counts[gram] += t
    assert {r["context"] + r["character"]: r["n"] for r in pitman_yor._spelled(words, 3, asked).collect()} == counts
    units = {g: -(i + 1) * 10**8 for i, g in enumerate(sorted(kinds))}
    grams = spark.createDataFrame(list(units.items()), "gram string, units long")
    found = {r["id"]: (bytes(r["word"]), r["t"], r["spelled"]) for r in pitman_yor._with_spelling(words, grams, 3).collect()}
    assert found == {i: (w, t, sum(units[g] for g in pitman_yor._grams(w, 3)) / pitman_yor.UNITS) for i, w, t, _ in rows}
