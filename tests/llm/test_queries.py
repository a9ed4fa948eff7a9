import os

import duckdb
import pytest

from lettermill.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": "field string, record_id bigint, family string", "p2_found": "field string, message_id bigint", "p3_found": "field string, message_id bigint, kind string", "p4_found": "field string, record_id bigint, pii_type string, mention string",
    "p5_found": "attachment_id bigint", "p6_found": "field string, message_id bigint, lang string", "p7_found": "attachment_id bigint", "p8_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint, kind string",
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, name):
    df = queries()[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert ", ".join(f"{a} {b}" for a, b in df.dtypes) == COLUMNS[name] and len(set(rows)) == len(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    want = con.execute(oracle_sql()[name])
    order = [c[0] for c in want.description]
    got = queries()[name](spark, DATA)
    key = lambda r: tuple(repr(r[c]) for c in sorted(order))
    assert sorted(got.columns) == sorted(order)
    assert sorted(key(r.asDict()) for r in got.collect()) == sorted(key(dict(zip(order, r))) for r in want.fetchall())
