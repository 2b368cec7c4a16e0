"""Queries beside their SQL over texts the given tables lack: empty, blank, long, odd quotes."""

import duckdb
import pytest

from sluice import catalog

TEXTS = ["", " ", "   ", "\n", "\n\n\n", "\n \n", "a b\nc", "\n\na b a\nc c", "a  b", ' "a" "a"',
         'x"y', '"open, and\nopen', '"a""b"c,d\n', '""', '"",""\n', '\n"a', "a\r\n\rb\r",
         "z" * 130, "z" * 2000, " " + "z" * 2000 + " ", "z" * 2001, "one two\n" * 1200,
         "\ufeffa,b\nc", '\ufeff"a"']
LANGS = ["en", "fr", "de", "es", "een", "", None]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of documents and pages, and DuckDB's views of them."""
    folder = tmp_path_factory.mktemp("odd")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR,"
                 " source VARCHAR, n_chars BIGINT)")
    rows = [(text, lang) for lang in LANGS for text in TEXTS]
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?, 'src0', ?)",
                     [(i, text, lang, len(text)) for i, (text, lang) in enumerate(rows)])
    duck.execute("CREATE TABLE pages AS SELECT doc_id AS page_id, text AS html FROM documents"
                 " WHERE lang = 'en'")
    duck.execute("INSERT INTO pages SELECT -n, repeat('p', n) FROM (VALUES (2097152), (2097153)) v(n)")
    for name in ("documents", "pages"):
        duck.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder), duck


@pytest.mark.parametrize("name", ["fn9_bounded_text", "src2_csv_file_admission",
                                  "src3_csv_header_check", "val10_job_request_check"])
def test_query_matches_oracle_over_odd_texts(spark, odd, name):
    folder, duck = odd
    found = catalog.queries()[name](spark, folder)
    expected = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(
        expected.fetchall(), key=repr)
