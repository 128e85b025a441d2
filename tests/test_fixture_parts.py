"""Views that unroll a company's rows are dealt to as many tasks as their lines need."""

import re

import pytest

from ledgerline.plans import fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view", ["fx_facts", "fx_dims"])
def test_tasks_grow_with_the_lines(spark, monkeypatch, view):
    monkeypatch.setattr(fixtures, "_LINES_A_TASK", 100, raising=False)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    plan = fixtures.fixture(spark, SF, view)._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-lines // 100)}), REPARTITION_BY_NUM" in plan


def test_tasks_grow_with_the_quarters_of_few_lines(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(fixtures, "_QUARTERS_A_TASK", 100, raising=False)
    # One line for each of 1,000 companies and three quarters.
    spark.range(3000).selectExpr(
        "id % 1000 AS l_suppkey", "add_months(date '1999-01-15', cast(3 * (id div 1000) AS int)) AS l_shipdate",
        "100d AS l_extendedprice", "0.1d AS l_discount", "0.05d AS l_tax", "7d AS l_quantity",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    facts = fixtures.fixture(spark, str(tmp_path), "fx_facts")
    tasks = re.findall(r"hashpartitioning\(cik#\d+L, (\d+)\)", facts._jdf.queryExecution().executedPlan().toString())
    assert 24 <= max(map(int, tasks)) <= 36
    # Filers of half-years lack two of the three.
    assert facts.where("concept = 'Assets'").count() == 3000 - 2 * (1000 // 13)


def test_twin_keeps_its_text():
    assert "fx_lines" not in fixtures.oracle("SELECT * FROM fx_segments")
