"""Every query with SQL gives the SQL's rows on the smallest tables; streams give what batches give; files are read as attachments."""

import os

import duckdb
import pytest

from lettermill import api
from lettermill.operators.attachments import extract_attachments
from lettermill.operators.html_body import extract_bodies
from lettermill.plans import catalog
from lettermill.sources.tables import attachment_files
from lettermill.streaming.mail import message_stream, write_bodies

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    want = con.execute(catalog.oracle_sql()[name])
    cols = sorted(c[0] for c in want.description)
    got = catalog.queries()[name](spark, DATA)
    assert sorted(got.columns) == cols
    order = [c[0] for c in want.description]
    key = lambda r: tuple(repr(r[c]) for c in cols)
    assert sorted(key(r.asDict()) for r in got.collect()) == sorted(key(dict(zip(order, r))) for r in want.fetchall())


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet(f"{DATA}/messages.parquet").limit(60)
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = message_stream(spark, str(tmp_path / "in"), 1)
    write_bodies(stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    batch = extract_bodies(spark.read.parquet(str(tmp_path / "in"))).select("message_id", "extracted_text", "extracted_html")
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"hello")
    (tmp_path / "y.png").write_bytes(b"\x89PNG\x00")
    files = attachment_files(spark, str(tmp_path))
    got = {r.filename: r.status for r in files.join(extract_attachments(files), "attachment_id").collect()}
    assert got == {"x.txt": "extracted", "y.png": "skipped"}


def test_sql_functions(spark):
    api.register(spark)
    r = spark.sql("SELECT extract_attachment(cast('a,b' AS binary), 'd.csv', NULL) AS r").first().r
    assert (r.status, r.extraction, r.reason) == ("extracted", "a,b", None)
