import datetime as dt

from ledgerline.operators import periods as pr

D = dt.date
Q = "cik long, fy int, rank int, is_ytd boolean, end_date date, revenue double, net_income double, interest_expense double, shares_outstanding double, eps_diluted double"


def quarters(spark):
    return spark.createDataFrame([
        (1, 2024, 1, False, D(2024, 4, 30), 10.0, 1.0, None, None, 0.10),
        (1, 2024, 2, True, D(2024, 7, 31), 25.0, 3.0, 5.0, None, 0.30),
        (1, 2024, 3, True, D(2024, 10, 31), 45.0, 6.0, 9.0, None, 0.60),
        (2, 2024, 2, True, D(2024, 6, 30), 30.0, 2.0, 1.0, 10.0, 0.2),
    ], Q)


def test_decumulation_uses_the_running_values(spark):
    got = {(r.cik, r.rank): r for r in pr.decumulate(quarters(spark)).collect()}
    assert [got[1, k].revenue for k in (1, 2, 3)] == [10.0, 15.0, 20.0]
    assert got[1, 2].quality == "standalone_decumulated" and not got[1, 2].is_ytd
    # The first quarter never had the column, so the second cannot keep it.
    assert got[1, 2].interest_expense is None and got[1, 3].interest_expense == 4.0
    assert got[1, 3].eps_diluted == 0.3
    assert got[2, 2].quality == "ytd_fallback" and got[2, 2].revenue == 30.0 and got[2, 2].is_ytd


def test_fourth_quarter_by_report_date_not_label(spark):
    # The year ends in January of the next calendar year.
    annual = spark.createDataFrame(
        [(1, D(2025, 1, 31), 70.0, 10.0, 12.0, None, 1.0), (1, D(2024, 1, 31), 55.0, 8.0, 11.0, None, 0.9)],
        "cik long, report_date date, revenue double, net_income double, interest_expense double, shares_outstanding double, eps_diluted double",
    )
    rows = pr.synthesize_q4(pr.decumulate(quarters(spark)), annual).collect()
    assert len(rows) == 1
    q4 = rows[0]
    assert (q4.fy, q4.rank, q4.end_date, q4.revenue, q4.net_income) == (2024, 4, D(2025, 1, 31), 25.0, 4.0)
    assert q4.interest_expense is None and q4.quality == "q4_synthesized"


def test_split_sign_check_drops_the_share_figure(spark):
    annual = spark.createDataFrame(
        [(1, D(2025, 1, 31), 70.0, 10.0, 12.0, None, 0.5)],
        "cik long, report_date date, revenue double, net_income double, interest_expense double, shares_outstanding double, eps_diluted double",
    )
    assert pr.synthesize_q4(pr.decumulate(quarters(spark)), annual).first().eps_diluted is None


def ttm_rows(spark, ends, qualities=None, revenue=None):
    cols = [*pr.TTM_FLOWS, *pr.TTM_BALANCES, "eps_diluted"]
    rows = []
    for n, end in enumerate(ends):
        values = dict.fromkeys(cols, 10.0)
        values["shares_outstanding"] = None
        if revenue:
            values["revenue"] = revenue[n]
        rows.append((1, end.year, end, "10-Q", "Q1", (qualities or ["standalone"] * len(ends))[n], *[values[c] for c in cols]))
    schema = "cik long, fy int, end_date date, form string, fiscal_period string, quality string, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema)


ENDS = [D(2024, 12, 31), D(2024, 9, 30), D(2024, 6, 30), D(2024, 3, 31), D(2023, 12, 31)]


def test_ttm(spark):
    row = pr.trailing_twelve_months(ttm_rows(spark, ENDS)).first()
    assert (row.status, row.revenue, row.total_assets, row.eps_diluted, row.prior_equity) == ("ok", 40.0, 10.0, 40.0, 10.0)
    gap = pr.trailing_twelve_months(ttm_rows(spark, ENDS, revenue=[1.0, None, 1.0, 1.0, 1.0])).first()
    assert gap.status == "ok" and gap.revenue is None
    mixed = pr.trailing_twelve_months(ttm_rows(spark, ENDS, ["q4_synthesized"] + ["standalone"] * 4)).first()
    assert mixed.eps_diluted is None
    ytd = pr.trailing_twelve_months(ttm_rows(spark, ENDS[:4], ["ytd_fallback"] + ["standalone"] * 3)).first()
    assert ytd.status == "too_few_quarters" and ytd.revenue is None
    wide = [D(2024, 12, 31), D(2024, 6, 30), D(2023, 12, 31), D(2023, 6, 30)]
    assert pr.trailing_twelve_months(ttm_rows(spark, wide)).first().status == "window_check_failed"


def test_latest_quarter_cadence(spark):
    assert pr.latest_quarter(ttm_rows(spark, ENDS)).first().status == "ok"
    assert pr.latest_quarter(ttm_rows(spark, [ENDS[0], ENDS[2]])).first().status == "cadence_check_failed"
    assert pr.latest_quarter(ttm_rows(spark, ENDS[:1])).first().status == "ok"
