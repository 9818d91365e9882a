"""The registered queries: their columns, one against its SQL, and that they read whole tables."""

import pytest

from check import compare, duck
from popmeasure.llm.common import table
from popmeasure.llm.oracles import ORACLES
from popmeasure.llm.queries import QUERIES

COLUMNS = {
    "op1_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op2_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op4_benchmark_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op5_quality": ["doc_id", "held_out", "score", "predicted"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_sentencepiece": ["doc_id", "n_chars", "n_tokens", "ids_hash", "round_trip"],
    "op11_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op12_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_licences": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract_columns_and_rows(spark, sf, name):
    got = QUERIES[name](spark, sf)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    source = "pages" if name.startswith("op1_") else "documents"
    assert got.count() == table(spark, sf, source).count()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, sf, name):
    assert compare(spark, duck(sf), name, sf) is None


def test_native_queries_have_no_python(spark, sf):
    for name in ("op1_url_filter", "op4_benchmark_decontamination"):
        text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in text for x in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin"))


def test_nearest_vectors_columns_and_scores(spark, sf):
    rows = QUERIES["op3_nearest_vectors"](spark, sf).select("query_id", "rank", "vec_id", "score").collect()
    vectors = {r.vec_id: r.embedding for r in table(spark, sf, "embeddings").collect()}
    assert {r.query_id for r in rows} == {i for i in vectors if i % 50 == 0}
    assert all(r.vec_id != r.query_id and -1.000001 <= r.score <= 1.000001 for r in rows)
    by_query = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(found == sorted(found) and len(found) == 5 for found in by_query.values())
