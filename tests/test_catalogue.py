"""Every catalogued query against its oracle on the smallest tables, and the entry module's contract."""

import pathlib

import duckdb
import pytest

from sparkfolio.plans import catalogue, packed  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not pathlib.Path(DATA).exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame, columns):
    clean = lambda v: None if v is None or v != v else str(v)
    return sorted((tuple(clean(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark, con):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())


def test_archives_of_large_keys(spark, con, tmp_path):
    """Times beyond USTAR's 2**33 seconds, and beyond the year 9999."""
    part = "(SELECT * REPLACE (key AS p_partkey) FROM (SELECT * FROM part LIMIT 1), (VALUES (99419::BIGINT), (99420), (1199999), (3000000)) AS k(key))"
    con.execute(f"COPY (SELECT * EXCLUDE (key) FROM {part}) TO '{tmp_path}/part.parquet'")
    got = catalogue.QUERIES["archive_listing"](spark, str(tmp_path)).toPandas()
    large = duckdb.connect()
    large.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = large.execute(catalogue.ORACLE_SQL["archive_listing"]).df()
    columns = sorted(want.columns)
    assert len(want) == 12 and rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name, text", [("convert_answers", "''"), ("convert_answers", "NULL::VARCHAR"), ("convert_files", "''"), ("registry_dispatch", "''")])
def test_documents_of_nothing(spark, con, tmp_path, name, text):
    """Empty texts, and missing ones, in every place that a document's id gives it."""
    con.execute(f"COPY (SELECT i AS doc_id, {text} AS text FROM range(30) AS r(i)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"COPY (SELECT * FROM pages LIMIT 2) TO '{tmp_path}/pages.parquet'")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()
    odd = duckdb.connect()
    for t in ("documents", "pages"):
        odd.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = odd.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    clean = lambda frame: sorted((tuple(str(v) if v == v and v is not None else None for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)), key=str)
    assert clean(got) == clean(want)


def test_convert_files_of_any_text(spark, con, tmp_path):
    """Missing texts, control characters, other formats' signatures, mail without header lines, and pages without markup."""
    mail = "'From: a@b.c' || chr(10) || 'To: b@c.d' || chr(10) || chr(10) || 'x'"
    texts = ("NULL", "''", "'a'", "repeat(chr(1), 40)", "'%PDF-1.4 x'", "'PK' || chr(3) || chr(4)", "'<html>x'", mail, "'Hello, From: a To: b'", f"'Subject: =?utf-8?b?abcde?=' || chr(10) || {mail}", f"'Date: Mon, 01 Jan 0001 00:00:00 +1000' || chr(10) || {mail}")
    odd = "(VALUES " + ", ".join(f"({i}, {t})" for i, t in enumerate(texts)) + ") AS t(k, text)"
    con.execute(f"COPY (SELECT k * 10 + i AS doc_id, text::VARCHAR AS text FROM {odd}, range(10) AS r(i)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"COPY (SELECT k AS page_id, text::VARCHAR AS html FROM {odd} UNION ALL SELECT 99, 'x' || repeat(chr(233), 600) || '<html>') TO '{tmp_path}/pages.parquet'")
    got = catalogue.QUERIES["convert_files"](spark, str(tmp_path)).toPandas()
    any_text = duckdb.connect()
    for t in ("documents", "pages"):
        any_text.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = any_text.execute(catalogue.ORACLE_SQL["convert_files"]).df()
    columns = sorted(want.columns)
    assert len(want) == 10 * len(texts) + len(texts) + 1 and rows(got, columns) == rows(want, columns)
