"""Signs in texts with letters beyond ASCII: word ends, blanks and case as the SQL reads them."""

import duckdb
import pytest

from plausia.plans.registry import ORACLES, QUERIES

ODD = ["schßbest", "éavoid it", "avoidé", "don\rt buy", "don\nt buy", "avoİd", "Know: stilĺ", "ßupdate", "ü3 yearsß", "für 12 monthsä, 4 daysñ", "i useß mine", "ßbut ßcheaper", "my sister", "für ßpeople 7ß", "stopped́ it", "best"]


@pytest.mark.parametrize("name", ["thread_kinds", "independence_signs", "honesty_tags", "evidence_levels", "says_changed", "time_of_use", "summary_problems", "tip_similarity", "keyword_families"])
def test_words_end_where_the_sql_ends_them(spark, tmp_path, name):
    at = str(tmp_path / "conversations.parquet")
    # the phrase of these numbers has no sign of a kind of its own
    spark.createDataFrame([(10 * i + 4, t, "user", x) for i, x in enumerate(ODD) for t in (0, 1)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(at)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{at}/*.parquet')")
    want = c.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
