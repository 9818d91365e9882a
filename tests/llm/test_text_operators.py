"""Decontamination, near-duplicates, language, licences, quality and toxicity on small tables against brute force."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from helpers import plan
from pyspark.sql import functions as F

from popmeasure.llm import decontaminate, language, licences, quality, simhash, toxicity
from popmeasure.llm.common import written
from popmeasure.llm.components import components
from popmeasure.llm.words import plain_words, spaced_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def lowered_words(text):
    return WORD.findall((text or "").translate(UPPER))


# --- words -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [None, "", "ÀB c-D\x0be f", "İstanbul 9A_b", "a" * 300])
def test_words(text):
    assert [w.decode() for w in plain_words(text)] == lowered_words(text)
    assert [w.decode() for w in spaced_words(text)] == re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


# --- decontamination -------------------------------------------------------------------------------------------------


def brute_contamination(docs, items, n=10):
    windows = set()
    for item, text in items:
        words = lowered_words(text)
        for i in range(max(len(words) - n, 0) + 1):
            if words:
                windows.add((item, tuple(words[i : i + n])))
    out = []
    for doc, text in docs:
        words, hit, found = lowered_words(text), set(), set()
        for item, window in windows:
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        listed = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(listed), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["É", "ß"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([25, 12, 10, 9, 3, 1, 11])] + [(50, None), (51, ""), (0, "w1 w2 !")]
    items += [(None, "only here stands this line")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(20)]
    docs += [(100 + i, f"A, {text(9)}; {(t or '').upper()}...{text(4)} {t}") for i, (_, t) in enumerate(items)]
    return docs + [(7, None), (None, "..."), (8, "")], items


@pytest.mark.parametrize("bound", [decontaminate.MAX_WINDOWS, 0])
def test_contamination(spark, leaks, bound):
    docs, items = leaks
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(left, right, max_windows=bound).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_contamination(docs, items)


def test_remove_spans_and_documents(spark, documents):
    items = spark.createDataFrame([(1, "Quick, brown fox!"), (2, None)], "item_id long, text string")
    kept = decontaminate.remove_documents(documents, items)
    assert kept.columns == documents.columns and kept.count() == 7
    spans = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(documents, items).collect()}
    assert spans[1] == "The jumps over the lazy dog again and again." and spans[4] == "" and spans[3] is None


def test_contamination_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents, none).filter("contaminated").count() == 0
    assert decontaminate.remove_documents(documents.limit(0), none).count() == 0


# --- near duplicates -------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = spaced_words(text)
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, distance=3):
    parent = {p: p for p in points}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in combinations(points, 2):
        if (a ^ b).bit_count() <= distance:
            parent[find(a)] = find(b)
    return {p: find(p) for p in points}


def test_near_duplicates_of_texts(spark, documents):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(documents).select(
        "doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id").collect()}
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert {k for k in got} == {(i, f"{brute_fingerprint(t):016x}") for i, t in rows}
    assert got[(2, f"{brute_fingerprint(rows[1][1]):016x}")] == 1
    assert got[(5, "0" * 16)] == got[(3, "0" * 16)] == 3
    assert got[(None, f"{brute_fingerprint(rows[7][1]):016x}")] is None
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(None) == 2 and 2 not in ids and {1, 3, 6, 9} <= set(ids) and len(ids) == 6


def test_keep_one_where_an_id_stands_on_several_texts(spark):
    shared, lone = "one two three four five six seven", "nothing else in here is like this text at all"
    rows = [(1, shared, "a"), (2, shared, "b"), (2, lone, "c"), (3, "entirely other words again", "d"), (3, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["fp"] for r in kept.collect()) == ["a", "c", "d", "e"]


def test_grid_finds_every_link(spark):
    rng = random.Random(5)
    points = set()
    for _ in range(60):
        seed = rng.getrandbits(64)
        for _ in range(4):
            near = seed
            for _ in range(rng.randint(0, 4)):
                near ^= 1 << rng.randrange(64)
            points.add(near)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(p), signed(p)) for p in points], "fp long, comp long")
    got = {(r["a"], r["b"]) for r in simhash.near_links(classes).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in combinations(points, 2) if (a ^ b).bit_count() <= 3}
    assert got == want and want
    singles = {(r["a"], r["b"]) for r in simhash.one_bit_links(classes.select("fp", F.col("fp").alias("id"))).collect()}
    ones = [p for p in combinations(points, 2) if (p[0] ^ p[1]).bit_count() == 1]
    assert len(ones) == 0 or singles


def test_cells_of_a_small_class_table_are_not_broadcast(spark):
    """The files of the classes are small, their exploded cells are not: a broadcast of them ends the driver."""
    rng = random.Random(9)
    fps = [rng.getrandbits(63) for _ in range(300)]
    fps += [fp ^ 1 << 40 ^ 1 << 3 for fp in fps[:50]]
    classes = written(spark.createDataFrame([(fp, fp) for fp in fps], "fp long, comp long"))
    links = simhash.near_links(classes)
    text = plan(links)
    assert "SortMergeJoin" in text and "BroadcastExchange" not in text
    assert {tuple(r) for r in links.collect()} == {tuple(sorted((fp, fp ^ 1 << 40 ^ 1 << 3))) for fp in fps[:50]}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (100, 102), (5, 5), (None, 3), (200, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in [*range(1, 41), 200]}, **{i: 100 for i in (100, 101, 102)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language --------------------------------------------------------------------------------------------------------


def brute_profile(texts, size):
    counts = {}
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            padded = f" {word} "
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    gram = padded[i : i + n]
                    if gram != " ":
                        counts[gram] = counts.get(gram, 0) + 1
    code = lambda g: (len(g) << 48) | sum(ord(c) << 16 * k for k, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def test_language_equals_out_of_place_distance(spark):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [("aa", make("abcd")) for _ in range(6)] + [("bb", make("cdeé")) for _ in range(6)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = language.train(docs, size=50)
    profiles = {name: brute_profile([t for x, t in rows if x == name], 50) for name in ("aa", "bb")}
    asked = [make("abcd"), make("deé"), "a", "c d", None, "123 !", ""]
    names, scores = model.score(asked)
    for text, name, score in zip(asked, names, scores, strict=True):
        own = brute_profile([text], 50)
        if not own:
            assert (name, score) == ("und", 0)
            continue
        apart = {
            k: sum(abs(p.index(g) - i) if g in p else 50 for i, g in enumerate(own)) for k, p in profiles.items()
        }
        best = min(sorted(apart), key=lambda k: apart[k])
        assert name == best and math.isclose(score, 1 - apart[best] / (50 * len(own)), abs_tol=1e-12)


def test_language_of_odd_rows(spark, documents):
    model = language.train(documents)
    rows = documents.withColumn("found", language.language_column(model, F.col("text"))).collect()
    assert all(r["found"]["lang_pred"] == "und" for r in rows if not (r["text"] or "").strip())
    empty = language.train(documents.limit(0))
    assert empty.score(["some words"])[0] == ["und"]


def test_long_text_counts_like_its_pieces():
    model = language.RankProfiles.of({"x": np.arange(10, dtype=np.uint64)}, 10)
    text = "abc déf " * 200_000
    assert model.score([text])[0] == model.score([text[:800]])[0]


# --- licences --------------------------------------------------------------------------------------------------------


def test_licences(spark, documents):
    phrase = "Under the MIT license, under the\nMIT License. CC-BY-NC cc by nc"
    more = spark.createDataFrame([(20, phrase), (21, "Licensed under the apache license,  Version 2.0 ok")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(documents.select("doc_id", "text").unionByName(more)).collect()}
    one = got[20]
    assert (one["n_base"], one["first_word"], one["last_word"], one["base_labels"]) == (4, 0, 11, "cc-by-nc,mit")
    assert got[21]["labels"] == "apache-2" and got[21]["first_word"] == 3 and got[21]["score"] == 1.0
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["first_word"], got[3]["labels"]) == (0, 0, None, "")


def test_containment_join_equals_brute_force():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    templates = [(f"t{k}", " ".join(rng.sample(words, rng.randint(1, 8)))) for k in range(15)] + [("none", "!")]
    index = licences.TemplateIndex.of(templates, {w.encode(): rng.randint(0, 9) for w in words}, 0.8)
    for _ in range(300):
        block = {w.encode() for w in rng.sample(words, rng.randint(0, 9))}
        want = []
        for label, text in templates:
            own = set(plain_words(text))
            if own and len(own & block) >= math.ceil(0.8 * len(own) - 1e-9):
                want.append((label, len(own & block) / len(own)))
        assert sorted(index.met(block)) == sorted(want)


def test_wrapped_notices_and_scattered_words(spark):
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided"
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy"
    apache = "# Licensed under the Apache\n# License, Version 2.0 (the"
    filler = "some other words that stand between these ones here "
    scattered = f"Copyright {filler * 3} all {filler * 3} rights {filler * 3} reserved"
    gnu = {t.label: t.text for t in licences.TEMPLATES}["gnu"].replace("program", "library").replace(" 3 ", " 2 ")
    rows = [bsd, mpl, apache, scattered, "x\n\nCopyright (c) 2020 Jane Doe.\nAll rights reserved.", "\n".join(gnu.split())]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert [got[i]["labels"] for i in range(6)] == ["bsd", "mpl-2", "apache-2", "", "all-rights-reserved", "gnu"]
    assert got[4]["blocks"][0]["line"] == 2 and got[3]["score"] == 0


NAMED = [
    ("Released under the MIT License", "mit"),
    ("This module is released under the terms of the MIT licence.", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("It is licensed under the Apache License 2.0 as of today", "apache-2"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("Covered by the GNU Lesser General Public License (LGPL)", "lgpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("Copyright 2001. All rights reserved.", "all-rights-reserved"),
    *[(t.text, t.label) for t in licences.TEMPLATES],
]
OTHERS = [
    "Released under the Apache License",
    "Released under the Eclipse License",
    "The report was released under the license of the ministry",
    "Permission is hereby granted, for a charge, to any person obtaining a copy of this report and this software",
    "Licensed under CC BY-SA 4.0",
    "Licensed under CC BY 4.0",
    "Licensed under the Mozilla Public License, Version 2.0",
    "Licensed under the Educational Community License, Version 2.0",
    "Licensed under the Apache License, Version 1.1 or 0",
    "This work is licensed under the GNU General Public License, version 2",
    "This work is licensed under the GNU Affero General Public License, version 3",
    "GNU General Public License (GPL)",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "We reserve all rights; copyright was reserved in 1990 for all",
    "Redistribution of income and use of source material in binary form, with or without modification, are forms permitted and in",
    "This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0",
    "Permission to copy, modify, or distribute this book for any purpose with or without fee and use is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "This is free and encumbered software released into the public square. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means, domain",
]


def test_notices_and_their_near_misses(spark):
    rows = [t for t, _ in NAMED] + OTHERS
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in licences.scan(docs).collect()}
    for i, (text, label) in enumerate(NAMED):
        assert got[i] == {label}, text
    for i, text in enumerate(OTHERS, len(NAMED)):
        assert got[i] == set(), text


def test_phrase_places_equal_brute_force():
    rng = random.Random(8)
    phrases = [[b"a"], [b"a", b"a"], [b"a", b"b", b"a"], [b"c"], []]
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 12))]
        want = [(i, k) for k, p in enumerate(phrases) for i in range(len(words)) if p and words[i : i + len(p)] == p]
        assert sorted(licences.phrase_places(words, phrases)) == sorted(want)


def test_licences_of_no_and_of_very_long_texts(spark):
    long = "word " * 300_000 + "under the MIT license"
    docs = spark.createDataFrame([(1, long, "x")], "doc_id long, text string, labels string")
    (one,) = licences.scan(docs).collect()
    assert (one["n_words"], one["n_base"], one["first_word"], one["labels"]) == (300_004, 1, 300_000, "mit")
    assert licences.scan(docs.limit(0)).collect() == []


def test_windows_equal_brute_force():
    rng = random.Random(5)
    words = [f"w{i}".encode() for i in range(25)]
    templates = [(f"t{k}", " ".join(w.decode() for w in rng.sample(words, rng.randint(2, 8)))) for k in range(10)]
    index = licences.TemplateIndex.of(templates, {w: rng.randint(0, 9) for w in words}, 0.8)
    for _ in range(50):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        got, want = {}, {}
        for _, label, share in index.windows(text, set(text)):
            got[label] = max(share, got.get(label, 0))
        for label, template in templates:
            own = set(plain_words(template))
            span = len(own) + 8
            most = max((len(own & set(text[i : i + span])) for i in range(len(text))), default=0)
            if most >= math.ceil(0.8 * len(own) - 1e-9):
                want[label] = most / len(own)
        assert got == want


# --- quality ---------------------------------------------------------------------------------------------------------


def test_quality_learns_and_scores_all(spark, documents):
    rng = random.Random(4)
    rows = [(i, ("GOOD!! " if i % 2 else "plain words, ") * rng.randint(5, 30)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 120)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(200))
    odd = quality.classify(documents.select("doc_id", "text"), labels.limit(0)).collect()
    assert len(odd) == 10 and {r["score"] for r in odd} == {0.5}


def test_features_of_odd_texts():
    for text in (None, "", "\n", "a", "é" * 1000):
        values = quality.features_of(text)
        assert len(values) == len(quality.FEATURES) and np.isfinite(values).all()


# --- toxicity --------------------------------------------------------------------------------------------------------


def brute_kernel(s, t, n=3, decay=0.6):
    total = 0.0
    for a in combinations(range(len(s)), n):
        for b in combinations(range(len(t)), n):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_subsequence_kernel():
    strings, others = ["idiot", "idixot", "banana", "ab", "xxidiot", "annana"], ["idiot", "banana"]
    got = toxicity.normalised_kernel(strings, others)
    for i, s in enumerate(strings):
        for j, t in enumerate(others):
            own = brute_kernel(s, s) * brute_kernel(t, t)
            assert math.isclose(got[i, j], brute_kernel(s, t) / math.sqrt(own) if own else 0, abs_tol=1e-9)


def test_toxicity_finds_insults_and_their_variants(spark, documents):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    plain = lambda: " ".join(rng.choice(vocabulary) for _ in range(30))
    insults = ["vexwikor", "vexwikam", "grubzik", "bazquop"]
    rows = [(i, plain() + (f" {rng.choice(insults)}. " if i % 3 == 0 else " ") + plain()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = model.probability(model.documents([t for _, t in rows[400:]]))
    assert np.mean((got >= 0.5) == np.array([i % 3 == 0 for i, _ in rows[400:]])) > 0.95
    odd = model.probability(model.documents(["some g.r.u.b.z.i.k here", "g r u b z i k", "vexwikix", None, "", "xx"]))
    assert (odd[:3] >= 0.5).all() and (odd[3:] < 0.5).all()
    assert toxicity.train(documents, labels.filter("toxic = 0")) is None
    scored = documents.withColumn("p", toxicity.probability_column(model, F.col("text")))
    assert scored.filter("p between 0 and 1").count() == 10


@pytest.mark.parametrize("text", ["i d i o t", "i . d . i . o . t", "i  d  i  o  t", "i\nd\ni\no\nt", "so: i - d\t i, o  t !"])
def test_spelled_out_words_are_one_token(text):
    assert "idiot" in toxicity.tokens_of(text)
    accented = toxicity.tokens_of(text.replace("i", "é"))
    assert "édéot" in accented


def test_remainder_matches_crc32(spark):
    from popmeasure.llm.common import remainder

    rows = spark.createDataFrame([(i,) for i in (0, 7, 12345, None)], "doc_id long")
    got = [r[0] for r in rows.select(remainder("doc_id", 5)).collect()]
    assert got == [zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in (0, 7, 12345, None)]
