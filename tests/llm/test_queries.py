"""The pN_ queries on the smallest tables: their columns, and counts that brute force gives."""

from pathlib import Path

import pytest

from quillworks.llm import queries as Q
from quillworks.llm.cues import TYPO, dissimilarity, reduced

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")
COLUMNS = {
    "p1_found": ["tbl", "rec_id", "pos"], "p2_found": ["tbl", "id_a", "id_b"], "p3_found": ["document_id", "first_seq", "last_seq"], "p4_found": ["tbl", "rec_id", "pos"], "p5_found": ["document_id"], "p6_found": ["document_id"], "p9_found": ["doc_id", "pii_kind", "start_pos"],
}


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, D)
    rows = [tuple(r) for r in df.collect()] if name in COLUMNS else []
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and rows and len(set(rows)) == len(rows)
    else:
        assert df.count() > 0


def test_runs_of_the_whole_table(spark):
    rows = {}
    for r in spark.read.parquet(f"{D}/segments.parquet").select("document_id", "seq", "text").collect():
        rows[(r.document_id, r.seq)] = r.text
    want, prior, start = set(), None, None
    for (d, s), t in [*sorted(rows.items()), ((None, None), None)]:
        same = prior and prior[0] == d and dissimilarity(reduced(prior[2]), reduced(t)) <= TYPO
        if not same:
            if prior and start != prior[1]:
                want.add((prior[0], start, prior[1]))
            start = s
        prior = (d, s, t)
    assert {tuple(r) for r in Q.p3_found(spark, D).collect()} == want


def test_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(D).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    assert sorted(con.sql(Q.oracle_sql()["p1_found"]).fetchall()) == sorted(tuple(r) for r in Q.p1_found(spark, D).collect())
