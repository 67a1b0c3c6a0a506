"""Queries over tables with ids, kinds and places beyond those of the smallest driver tables: every row counts."""

import pytest

from plausia.operators import evaluation
from plausia.plans import requests
from plausia.plans.registry import QUERIES


def saved(spark, at, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_quotas_and_budgets_reach_every_post(spark, tmp_path):
    orders = [(i, i, 1000.0 - i, "F" if i < 500 else "P", f"c{i % 7}") for i in range(510)]
    sf = saved(
        spark, tmp_path, orders=(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string"),
        customer=([(i, "one") for i in range(510)], "c_custkey long, c_mktsegment string"),
    )
    mix = QUERIES["choose_mix"](spark, sf).collect()
    assert [r.post_id for r in sorted(mix, key=lambda r: r.shown)] == [0, 1, 2, 3, 4, 5, 500, 501, 502, 503, 6, 7]
    assert {r.request for r in QUERIES["within_calls"](spark, sf).collect()} == {str(i) for i in range(510)}


def test_requests_of_every_part_are_read(spark, tmp_path, monkeypatch):
    parts = [(i, f"red {('kettle', 'grinder', 'skillet')[i % 3]}", 5) for i in range(1990, 2020)]
    sf = saved(spark, tmp_path, part=(parts, "p_partkey long, p_name string, p_size int"))
    assert {r.p_partkey for r in QUERIES["parsed_requests"](spark, sf).collect()} == set(range(1990, 2020))
    assert QUERIES["query_case_accuracy"](spark, sf).first().cases == 30
    monkeypatch.setattr(requests, "MOST_NOUNS", 2)
    with pytest.raises(ValueError, match="too many"):
        QUERIES["parsed_requests"](spark, sf)


def test_lines_of_every_order_are_matched(spark, tmp_path):
    lines = [(k, n, 5 * k + n, 5 * k + n) for k in range(1995, 2006) for n in (1, 2)]
    sf = saved(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long"))
    assert {r.grp for r in QUERIES["max_matching"](spark, sf).select("grp").collect()} == set(range(1995, 2006))


def test_matching_passes_groups_in_batches(spark, capsys):
    rows = [(g, a, b) for g in range(300) for a, b in ((1, 1), (1, 2), (2, 1), (2, 1))] + [(None, 1, 1), (None, 2, 1), (7, 3, None), (7, None, 3)] + [(300, n, n) for n in range(40)]
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = evaluation.max_matching(spark.createDataFrame(rows, "grp long, left long, right long"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(g, a, 3 - a) for g in range(300) for a in (1, 2)] + [(None, 1, 1)] + [(300, n, n) for n in range(40)], key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    got.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
