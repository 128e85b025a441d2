"""Whole pipelines: facts of every company in, finished tables out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import fiscal_rank, fiscal_year, is_year_to_date
from ledgerline.functions.ratios import with_ratios
from ledgerline.operators import facts as fx
from ledgerline.operators import periods as pr
from ledgerline.operators import resolve as rs
from ledgerline.operators.screen import capped_filings
from ledgerline.session import ensure_checkpoint_dir

QUARTER_COLUMNS = (
    *pr.TTM_FLOWS, *[b for b in pr.TTM_BALANCES], "depreciation_amortization", "cost_of_revenue",
    "eps_basic", "eps_diluted",
)


def filing_calendar(facts: DataFrame) -> DataFrame:
    """Fiscal label of each reported period, from the filing that first showed it."""
    cal = fx.filing_profile(facts)
    w = Window.partitionBy("cik", "report_date", "form").orderBy("filed", "accn")
    cal = cal.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    year = fiscal_year(F.col("fy"), F.col("report_date"), F.col("filed"), F.col("form"))
    return cal.select(
        "cik", F.col("report_date").alias("end_date"), "form", "accn", "filed", year.alias("fy"),
        fiscal_rank("fp").alias("rank"), is_year_to_date(F.col("form"), F.col("fp")).alias("is_ytd"),
    )


def both_views(facts: DataFrame) -> DataFrame:
    """Annual and year-to-date rows of clean facts, told apart by ``basis``.

    Doing both in one pass keeps a single resolution for the whole history.
    """
    is_fy, short = F.col("ptype") == "FY", F.col("dur_days") <= 295
    df = fx.with_period(facts).withColumns({
        "__fy": fx._any(is_fy, fx.SERIES), "__short": fx._any(short, fx.SERIES),
        "__rank": fx._rank_by_length(fx.SERIES),
    })
    # Among rows that can be year-to-date, the longest per end.
    w = Window.partitionBy(*fx.SERIES, "end_date", "__can").orderBy(
        F.col("dur_days").desc_nulls_last(), F.col("start_date").asc_nulls_last()
    )
    df = df.withColumn("__can", short | ~F.col("__short")).withColumn("__ytd", F.row_number().over(w))
    instant = F.expr(fx.INSTANT)
    annual = instant | is_fy | (~F.col("__fy") & (F.col("__rank") == 1))
    ytd = instant | (F.col("__can") & (F.col("__ytd") == 1))
    basis = F.array_compact(F.array(F.when(annual, "annual"), F.when(ytd, "ytd")))
    return df.select(*facts.columns, F.explode(basis).alias("basis"))


def quarterly_history(facts: DataFrame, industry: DataFrame | None = None) -> DataFrame:
    """Standalone quarters of every company, fourth quarters included."""
    calendar = filing_calendar(facts)
    view = both_views(fx.clean_facts(facts))
    wide = rs.extract(view, industry=industry, keys=("cik", "end_date", "basis"))
    wide = wide.where("revenue IS NOT NULL").select("cik", "end_date", "basis", *QUARTER_COLUMNS)
    quarterly = F.col("form").isin("10-Q", "6-K")
    fits = (F.col("basis") == "ytd") == quarterly
    # The finished metrics are small next to the facts: keep them once, since
    # the steps below read them from two sides.
    ensure_checkpoint_dir(facts.sparkSession)
    rows = wide.join(calendar, ["cik", "end_date"]).where(fits).checkpoint()

    quarters = pr.decumulate(rows.where("basis = 'ytd'").drop("basis"))
    annual = rows.where("basis = 'annual'").drop("basis", "rank", "is_ytd", "fy")
    q4 = pr.synthesize_q4(quarters, annual.withColumnRenamed("end_date", "report_date"))
    return quarters.unionByName(q4.select(*quarters.columns))


def trailing_profitability(facts: DataFrame, industry: DataFrame | None = None) -> DataFrame:
    """Trailing-twelve-month revenue, income, margin and return on equity."""
    ttm = pr.trailing_twelve_months(quarterly_history(facts, industry))
    rated = with_ratios(ttm, "prior_equity", "prior_assets")
    return rated.select(
        "cik", "status", "as_of", "quality", "revenue", "net_income", "net_margin", "roe", "roe_basis",
    )


def filing_views(facts: DataFrame, caps: Mapping[str, int | None], default: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, view): the newest filings of each form up to its cap, if it has one, and their own facts of their own period.

    A filing keeps one currency, the one most of its rows have: rows in another
    one, also in dollars, would mix into its sums and ratios.
    """
    index = capped_filings(fx.filing_profile(facts), caps, default)
    # Said as two bounds, the end date is no key of the join: rows stay dealt by filing for all windows below.
    rows = facts.where(fx.is_quality_row(facts)).join(
        index.select("cik", "accn", "report_date", F.col("form").alias("__form")), ["cik", "accn"]
    ).where("end_date <= report_date AND end_date >= report_date")
    rows = fx.with_currency(rows, ("cik", "accn"))
    own = fx.unit_currency().isNull() | (fx.unit_currency() == F.col("currency"))
    rows = rows.where(own).drop("currency")
    rows = fx.dedupe_facts(rows, ("cik", "accn", "concept", "taxonomy", "units", "start_date", "end_date"))
    series = ("cik", "accn", "concept", "taxonomy", "units")
    annual = F.col("__form").isin("10-K", "20-F")
    view = fx.ytd_facts(fx.annual_facts(rows, series, among=annual), series, among=~annual)
    return index, view.select("cik", "accn", "concept", "value")


def historical_metrics(facts: DataFrame, caps: dict[str, int], default: int, industry: DataFrame | None = None) -> DataFrame:
    """Every metric of the tag rules as each periodic filing tags it: one row per (cik, accn, metric)."""
    _, view = filing_views(facts, caps, default)
    return rs.resolve_metrics(view, industry=industry, keys=("cik", "accn"))


def historical_extract(
    facts: DataFrame, caps: Mapping[str, int | None] | None = None, default: int | None = None,
    metrics: tuple[str, ...] = rs.ALL_METRICS, industry: DataFrame | None = None,
) -> DataFrame:
    """All metrics and ratios of every periodic filing, as it was filed.

    Facts are resolved per accession, so restatements do not leak backwards.
    Every filing is kept; a caller may ask for the newest of a form only.
    """
    index, view = filing_views(facts, caps or {}, default)
    wide = rs.extract(view, industry=industry, metrics=metrics, keys=("cik", "accn"))
    return with_ratios(wide.join(index.select("cik", "accn", "form", "report_date", "filed"), ["cik", "accn"]))


KNOWN_METRICS = (*rs.ALL_METRICS, *rs.DERIVED_METRICS)


def metric_subset(wide: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("cik", "end_date")) -> DataFrame:
    """Keys and the requested metrics; unknown names are an error."""
    bad = [m for m in metrics if m not in KNOWN_METRICS]
    if bad:
        raise ValueError(f"unknown metrics {bad}")
    return wide.select(*keys, *metrics)
