"""Queries over ids and digests that the small tables don't have, against their SQL."""

import duckdb
import pytest

from tessera.functions import text as X
from tessera.plans import catalogue, corpora, projected  # noqa: F401
from tests.test_catalogue import rows
from tests.test_text import one


@pytest.fixture
def documents(spark, tmp_path):
    def write(ids):
        d = spark.createDataFrame([(i, f"text {i}", "en", "src", 9) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
        d.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        return str(tmp_path), con

    return write


def test_registry_ids_of_five_digits(spark, documents):
    sf, con = documents([7, 1000, 9999, 10000, 10001, 123457])
    assert rows(catalogue.queries()["restored_registry"](spark, sf).toPandas()) == rows(con.sql(catalogue.oracle_sql()["restored_registry"]).df())


def test_a_digest_that_begins_with_nought_is_damaged(spark, documents):
    sf, con = documents(range(286 * 20, 287 * 20))  # benchmark 286 has fault 22
    assert rows(catalogue.queries()["benchmark_drift"](spark, sf).toPandas()) == rows(con.sql(catalogue.oracle_sql()["benchmark_drift"]).df()) == [(286.0, 1.0)]


def test_hits_with_bounds_of_ascii(spark):
    p = [r"\bund\b.*\bdie\b", r"a\sb", r"\\b"]
    for text, want in (("stößund die", p[:1]), ("und\rdie", p[:1]), ("und\ndie", []), ("bund die", []), ("UND DIEſ", p[:1]), ("a\x0bb", []), ("a\tb", p[1:2])):
        assert one(spark, X.hits("t", p, ascii=True), t=text) == want
