import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.dates import easter, is_exchange_holiday
from ledgerline.functions.labels import expand_forms
from ledgerline.operators import screen as sc
from ledgerline.plans.fundamentals import metric_subset
from ledgerline.sources.sinks import KeyedTable, SnapshotSink
from ledgerline.streaming import streams as st


@pytest.mark.parametrize("call", [
    lambda: sc.argument("", "ticker"), lambda: sc.argument(None, "ticker"), lambda: sc.argument("X" * 13, "ticker"), lambda: sc.argument("  ", "ticker"),
    lambda: sc.argument("2024-13-01", "day"), lambda: sc.argument("01/02/2024", "day"), lambda: sc.argument("2024-01-02x", "day"),
    lambda: sc.argument("weekly", "word", among=("annual", "ttm")), lambda: sc.argument("x", "count"), lambda: sc.argument(0, "count", among=range(1, 501)),
    lambda: sc.argument(2.5, "count"), lambda: sc.argument(True, "count"), lambda: sc.argument(True, "number"), lambda: sc.argument("abc", "number"),
    lambda: sc.argument("123", "accession"), lambda: sc.argument(None, "accession"), lambda: sc.argument("1" * 19, "accession"),
    lambda: sc.several([2020, 2020], "count", range(2, 3), distinct=True, among=range(1994, 2026)),
    lambda: sc.several([1990, 2020], "count", range(2, 3), distinct=True, among=range(1994, 2026)),
    lambda: sc.several(["A"], "ticker", range(2, 9)), lambda: sc.several("AB", "ticker", range(2, 9)), lambda: expand_forms("not a form!!"),
    lambda: sc.condition({"metric": "x", "operator": "~", "value": 1}),
    lambda: sc.condition({"metric": "x", "operator": "between", "value": 1}),
    lambda: sc.condition({"metric": "x", "value": 1}),
])
def test_bad_arguments_fail_early(spark, call):
    with pytest.raises(ValueError):
        call()


def test_good_arguments():
    assert sc.argument(" brk.b ", "ticker") == "BRK.B" and sc.argument("X" * 12, "ticker") == "X" * 12 and sc.argument("x", "ticker") == "X"
    assert sc.argument("000032019324000123", "accession") == sc.argument(" 0000320193/24 000123", "accession") == "0000320193-24-000123"
    assert sc.argument("2024-2-29", "day") == sc.argument(dt.date(2024, 2, 29), "day") == dt.date(2024, 2, 29)
    assert sc.argument(None, "day", optional=True) is None and sc.argument(None, "word", default="annual") == "annual"
    assert sc.argument(" TTM ", "word", among=("annual", "ttm")) == "ttm"
    assert sc.several(["a", " b"], "ticker", range(2, 9)) == ["A", "B"]
    assert expand_forms("13d/g")[0] == "SC 13D" and expand_forms("25-NSE") == ["25-NSE"]
    assert sc.argument("2.5", "number") == 2.5 and sc.argument(-1e3, "number") == -1000 and sc.argument("7", "count") == sc.argument(7.0, "count") == 7


def test_unknown_screen_and_metric_names(spark):
    df = spark.createDataFrame([(1, 2.0)], "cik long, revenue double")
    with pytest.raises(ValueError):
        sc.screen(df, [{"metric": "nope", "operator": ">", "value": 1}])
    with pytest.raises(ValueError):
        sc.screen_composed(df, {"nope": 1})
    with pytest.raises(ValueError):
        metric_subset(df, ["nope"])


def test_missing_values_fail_screens(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0)], "cik long, revenue double")
    got = [r.cik for r in sc.screen(df, [{"metric": "revenue", "operator": ">=", "value": 2}]).collect()]
    assert got == [3, 1]


def buckets_of(path):
    return {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in Path(path.removeprefix("file:")).glob("bucket=*")}


def test_batches_can_be_written_twice_and_touch_their_buckets_only(spark):
    path = st.work_folder(spark, "keyed")
    table = KeyedTable(path, ["k"], buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v int")
    table.write(rows(*[(k, k) for k in range(50)]), 0)
    before = buckets_of(path)
    table.write(rows((2, 300)), 1)
    after = buckets_of(path)
    table.write(rows((2, 300)), 1)
    assert sum(before[b] != after[b] for b in before) == 1
    assert {(r.k, r.v) for r in table.read(spark).collect()} == {(k, 300 if k == 2 else k) for k in range(50)}


def test_a_write_cut_short_is_finished_by_its_retry(spark):
    """The rows set aside are whole: a bucket that was lost while it was replaced comes back."""
    path = st.work_folder(spark, "cut")
    table = KeyedTable(path, ["k"], buckets=2)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v int")
    table.write(rows(*[(k, 0) for k in range(20)]), 0)
    table.write(rows(*[(k, 1) for k in range(10)]), 1)
    lost = next(Path(path.removeprefix("file:")).glob("bucket=*"))
    for file in lost.iterdir():
        file.unlink()
    table.write(rows(*[(k, 1) for k in range(10)]), 1)
    assert {(r.k, r.v) for r in table.read(spark).collect()} == {(k, int(k < 10)) for k in range(20)}


def test_rows_of_a_key_have_a_total_order(spark):
    table = KeyedTable(st.work_folder(spark, "order"), ["k"], ["seq"], buckets=2)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, seq int, v int")
    table.write(rows((1, 5, 10), (1, 5, 11), (1, 4, 99), (2, 1, 1)), 0)
    table.write(rows((1, 3, 50), (2, 2, 0), (3, 1, None)), 1)
    assert {tuple(r) for r in table.read(spark).select("k", "seq", "v").collect()} == {(1, 5, 11), (2, 2, 0), (3, 1, None)}


def test_a_snapshot_appended_again_replaces_itself(spark):
    sink = SnapshotSink(st.work_folder(spark, "snap"))
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v double")
    for batch, given in (("2024-01", [(1, 1.0), (2, 2.0)]), ("2024-02", [(1, 3.0)]), ("2024-01", [(1, 1.0), (2, 2.0)])):
        sink.append(rows(*given), batch)
    assert sorted(tuple(r) for r in sink.read(spark).select("batch", "k", "v").collect()) == [("2024-01", 1, 1.0), ("2024-01", 2, 2.0), ("2024-02", 1, 3.0)]


def test_holidays_by_rule(spark):
    days = spark.sql("SELECT explode(sequence(date '2024-01-01', date '2027-12-31')) AS d").where(is_exchange_holiday("d"))
    got = [str(r.d) for r in days.orderBy("d").collect()]
    assert got == [
        "2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25",
        "2025-01-01", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
        "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
        "2027-01-01", "2027-01-18", "2027-02-15", "2027-03-26", "2027-05-31", "2027-06-18", "2027-07-05", "2027-09-06", "2027-11-25", "2027-12-24",
    ]
    known = {1961: "04-02", 1999: "04-04", 2000: "04-23", 2008: "03-23", 2011: "04-24", 2019: "04-21", 2038: "04-25"}
    assert {y: str(easter(y))[5:] for y in known} == known


def test_rank_filter_reaches_the_shuffle(spark):
    """The dedupe keeps one row per key before the exchange."""
    from ledgerline.operators.facts import dedupe_facts
    day = F.date_add(F.current_date(), (F.col("id") % 5).cast("int"))
    df = spark.range(100).select(
        (F.col("id") % 3).alias("cik"), F.col("id").cast("string").alias("concept"), F.col("id").cast("string").alias("taxonomy"),
        F.col("id").cast("string").alias("units"), day.alias("start_date"), day.alias("end_date"), day.alias("filed"),
        F.col("id").cast("string").alias("accn"), F.col("id").cast("double").alias("value"),
    )
    plan = dedupe_facts(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
