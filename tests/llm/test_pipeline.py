"""The pipeline's stages against brute force, each on its own input."""

import pytest

import corpus_pipeline
from plausia.llm import decontamination, quality_classifier, substring_dedup
from tests.llm.helpers import SCHEMA, docs, odd_rows, prose
from tests.llm.test_pairs import brute_groups, brute_removals
from tests.llm.test_rules import QUESTION


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    copy = prose(1, 80)
    passage = prose(500, 60)
    rows = [(i, prose(i, 60 + i), "en", f"s{i % 3}") for i in range(2, 60)]
    rows += [(100, copy, "en", "a"), (101, copy, "en", "b"), (102, copy + " tail", "en", "c"), (103, prose(600, 60) + " " + passage, "en", "a"), (104, prose(601, 90) + " " + passage, "en", "a"), (105, prose(602, 50) + " " + QUESTION, "en", "a")]
    rows += [(200 + i, " ".join(w + "***###" for w in prose(i, 50).split()), "en", "j") for i in range(20)]
    docs(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), int(i % 9 == 0)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_equal_brute_force(spark, folder, tmp_path):
    own = spark.read.parquet(f"{folder}/documents.parquet")
    docs_, seen = own, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs_, folder).write.parquet(str(tmp_path / name))
        before, docs_ = docs_, spark.read.parquet(str(tmp_path / name))
        seen[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs_.collect()})
        assert docs_.columns[:5] == own.columns and (docs_.columns == own.columns or name == "mixture")
    a, b = seen["quality"]
    assert set(b) == {i for i in a if i < 200}
    a, b = seen["near_duplicates"]
    assert set(b) == {i for i, _, _, kept in brute_groups([(i, r.text) for i, r in a.items()]) if kept} and 101 not in b and 102 not in b
    a, b = seen["repeated_passages"]
    want = {i: (n, gone) for i, n, gone, _ in brute_removals([(i, r.text) for i, r in a.items()])}
    assert set(a) == set(b) and all(len(b[i].text.split()) == n - gone for i, (n, gone) in want.items()) and want[104][1] == 60
    a, b = seen["benchmark_passages"]
    assert set(a) - set(b) == {105}
    a, b = seen["mixture"]
    assert set(b) <= set(a) and all(r.copies > 0 for r in b.values()) and sum(r.copies for r in b.values()) > 0.8 * len(a) * 0.9


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"rate", "copies"} < set(out.columns) and 0 < out.count() < 84


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = docs(spark, odd_rows(), True)
    out = stage(spark, odd, folder)
    assert set(odd.columns) <= set(out.columns)
    out.collect()
    assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_stages_call_their_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_passages", "mixture"]
    assert corpus_pipeline.ORACLE_SQL is None and quality_classifier and substring_dedup and decontamination
