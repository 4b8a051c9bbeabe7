"""Queries against their SQL on the smallest tables, where these are there."""

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = ["third_foot_rate", "caesura_counts", "stress_scansion", "binary_features", "metre_vectors", "indices_to_bookref", "propers_removed", "link_best_match", "rhyme_baseline_bruteforce", "scan_slant_leo", "stars"]


def canon(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert canon(tuple(r) for r in df.select(*cols).collect()) == canon(want)
