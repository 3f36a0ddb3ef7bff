"""The registered queries against DuckDB, and the pipeline against a brute-force version of its stages."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from orgpulse.llm import mixing, oracle_sql, quality
from orgpulse.llm.queries import all_queries
from tests.llm.test_text_operators import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="test data not present")


@pytest.mark.parametrize("key", list(oracle_sql.ORACLES))
def test_query_matches_its_sql(spark, key):
    from tools.oracle_check import compare, duck_connect
    line, ok = compare(spark, duck_connect(SF), key, all_queries()[key], oracle_sql.ORACLES[key], SF)
    assert ok, line


def test_there_is_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in all_queries()) == list(range(1, 14))


def test_pipeline_stages_against_brute_force(spark):
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = table("documents")
    given = {r.doc_id: r for r in docs.collect()}
    score = {r.doc_id: r.score for r in quality.quality_scores(docs, table("labels")).collect()}
    kept = {i for i in given if score[i] >= 0.7}
    stage = corpus_pipeline.quality_stage(spark, docs, SF)
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} == kept

    _, component = brute_components([(i, given[i].text) for i in kept], 5, 4, 5)
    kept = {i for i in kept if component[i] == i}
    words = lambda t: [w.lower() for w in re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", t)]
    def grams(text):
        said = words(text)
        return {tuple(said[k:k + 5]) for k in range(len(said) - 4)}

    items = [g for r in table("benchmark").collect() if (g := grams(r.text))]
    held = {i: grams(given[i].text) for i in kept}
    clean = {i for i in kept if not any(len(g & held[i]) >= 0.8 * len(g) for g in items)}

    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    left = docs.where(docs.doc_id.isin(sorted(clean)))
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(left).collect()}
    assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in copies.items() if n})
    assert len(clean) < len(kept) and sum(copies.values()) > len(clean)
    for r in rows:
        assert r.text == given[r.doc_id].text and r.source == given[r.doc_id].source
    for shard, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


def test_stages_keep_other_columns_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'x' as row", "1 as size", "'y' as shard")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).columns == docs.columns
    assert corpus_pipeline.sharding_stage(spark, docs.where("false"), SF).count() == 0
