"""Registered queries against their SQL over small tables with rows that the sample tables lack."""

from __future__ import annotations

import duckdb
import pytest

from docpipe.plans import catalogue, made


def _customers(folder, orders: list[int]) -> str:
    """A customer for each number of orders, by key."""
    db = duckdb.connect()
    db.execute(f"copy (select i as c_custkey, 'Customer#' || i as c_name, 1 as c_nationkey, (i * 10.25)::double as c_acctbal, 'BUILDING' as c_mktsegment from range({len(orders)}) r(i)) to '{folder}/customer.parquet' (format parquet)")
    db.execute(f"""copy (select 1000 * k + j as o_orderkey, k as o_custkey, ['F', 'O', 'P'][(j % 3 + 1)::int] as o_orderstatus, (10.5 * j + 1)::double as o_totalprice, timestamp '1995-01-01' + to_days((j % 900)::int) as o_orderdate, 'LOW' as o_orderpriority
      from (select k, unnest(range(m)) as j from (select unnest({orders}) as m, generate_subscripts({orders}, 1) - 1 as k))) to '{folder}/orders.parquet' (format parquet)""")
    return str(folder)


def _equal(spark, folder: str, name: str, *tables: str) -> None:
    got = catalogue.QUERIES[name](spark, folder)
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in tables:
        db.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    want = db.execute(f"select {', '.join(got.columns)} from ({catalogue.ORACLE[name]})").fetchall()
    assert len(want) and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("name", ["docx_files"])
def test_customer_without_orders(spark, tmp_path, name):
    _equal(spark, _customers(tmp_path, [2, 0, 1]), name, "customer", "orders")


def test_title_with_references_cut_short(spark, tmp_path):
    page = lambda title: f"<!DOCTYPE html><html lang=\"de\"><head><title>{title}</title></head><body><p>x</p></body></html>"
    titles = ["Rest &amp; rest&amp", "AT&T &copyright &middot; &quot;x&quot", "a && b &", "&copy; 2020"]
    rows = ", ".join(f"({k}, $${page(t)}$$)" for k, t in enumerate(titles))
    duckdb.execute(f"copy (select * from (values {rows}) v(page_id, html)) to '{tmp_path}/pages.parquet' (format parquet)")
    _equal(spark, str(tmp_path), "html_title", "pages")


def test_made_files_are_spread_by_rows(spark, tmp_path, monkeypatch):
    """Few bytes of rows are much work, so adaptive execution must not merge them into one task."""
    monkeypatch.setattr(made, "TASK_ROWS", 50)
    folder = _customers(tmp_path, [3] * 200)
    found = made.files(spark, folder, "csv")
    found.collect()
    assert found.rdd.getNumPartitions() == 16
    assert max(found.rdd.glom().map(len).collect()) < 40


@pytest.mark.parametrize("name", ["docx_text", "docx_blocks", "rtf_json"])
def test_blocks_have_the_wanted_fields_alone(spark, tmp_path, name):
    folder = _customers(tmp_path, [2, 5, 1])
    assert made.documents(spark, folder, "docx", "txt").schema["blocks"].dataType.elementType.names == ["txt"]
    _equal(spark, folder, name, "customer", "orders")
