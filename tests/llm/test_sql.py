"""The operators against their DuckDB SQL, on a table of the test data and on odd texts."""

import duckdb
import pytest

from volumetra.llm.queries import ORACLE_SQL, QUERIES

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ODD = [
    None, "", " \t\n\r\x0b", "word", "Word", "two words", "TWO words", "two\x0bWORDS", "ÀB straße", "àb straße",
    BASE, BASE.upper(), f"{BASE} fifteen", f"{BASE} x y", "a b " * 400, ("a b c d e f " * 3 + ". ") * 2, "x" * 50_000,
    f"{BASE}.\n{BASE}.\n\n{BASE}!", f"{BASE}.\nclick here to Sign In.\nCopyright (c) 2024 somebody and others.", f"{BASE}.\nhome | news | about | contact .",
    f"{BASE}!! !! !! !!.", f"### *** {BASE} <b>.", f"{BASE}.\"') ", f"all rights reserved {BASE}.", f"{BASE}。", f"{BASE}\n\n{BASE} and no end",
]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("tables", ["given", "odd", "none"])
def test_rows_equal_those_of_the_sql(spark, tmp_path, name, tables):
    folder = "/root/testdata/sf0.001" if tables == "given" else str(tmp_path)
    if tables != "given":
        rows = [(i, t) for i, t in enumerate(ODD)] if tables == "odd" else []
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = QUERIES[name](spark, folder)
    with duckdb.connect() as base:
        found = f"{folder}/documents.parquet" + ("" if tables == "given" else "/*.parquet")
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{found}'")
        relation = base.sql(ORACLE_SQL[name])
        assert sorted(relation.columns) == sorted(got.columns)
        expected = relation.project(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(expected)
