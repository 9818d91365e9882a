"""The pipeline's stages on the smallest tables against what the operators' brute-force versions say."""

import random
import string

from pyspark.sql import functions as F

import corpus_pipeline
from popmeasure.llm import language
from popmeasure.llm.common import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, sf))
        kept[name] = docs
        if name != "sentencepiece":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    left = {r["doc_id"] for r in kept["toxicity"].collect()}
    clean = [i for i, toxic in labels.items() if not toxic]
    assert sum(i in left for i in clean) >= 0.8 * len(clean)
    texts = [r["text"] for r in kept["language_id"].collect()]
    assert all(any(c.isalpha() for c in t) for t in texts)
    ids = [r["doc_id"] for r in kept["simhash_near_dedup"].collect()]
    assert len(ids) == len(set(ids))
    assert kept["sentencepiece"].count() == kept["benchmark_decontamination"].count()
    assert kept["sentencepiece"].columns == ["doc_id", "n_tokens", "ids"]


def test_stages_take_empty_tables(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_unlearned_languages_go(spark, sf):
    docs = table(spark, sf, "documents")
    rng = random.Random(1)
    foreign = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi "
        "quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura.",
        "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan, "
        "lajivirttä laulamahan. Sanat suussani sulavat, puhe'et putoelevat, kielelleni kerkiävät.",
        "Litwo! Ojczyzno moja! ty jesteś jak zdrowie. Ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś "
        "piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie.",
        *(" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(80)) for _ in range(5)),
    ]
    rows = docs.limit(1).select(*[c for c in docs.columns if c not in ("doc_id", "text", "lang")]).crossJoin(
        spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(foreign)], "doc_id long, text string, lang string")
    )
    both = docs.unionByName(rows.select(docs.columns))
    left = [r["doc_id"] for r in corpus_pipeline.drop_unknown_language(spark, both, sf).collect()]
    assert [i for i in left if i >= 10**9] == []
    with_letters = docs.filter(F.col("text").rlike("\\p{L}")).count()
    assert len(left) >= 0.98 * with_letters


def test_unknown_language_name():
    assert language.UNKNOWN == "und"
