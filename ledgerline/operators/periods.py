"""Year-to-date to standalone quarters, fourth quarters, trailing twelve months.

Frames are wide: one row per company and period, metrics as columns. Windows
run inside one company's fiscal year or over its few newest periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.concepts import FLOW_METRICS
from ledgerline.functions.numeric import exact_minus, exact_total, or_zero, round_half_up, safe_div, truthy
from ledgerline.operators.ranges import day_number, window_join

PER_SHARE = ("eps_basic", "eps_diluted")

# Qualities that may be added up to a year.
SUMMABLE = ("standalone", "standalone_decumulated", "q4_synthesized", "")

# Quarter columns that add up, and those taken at the period end.
TTM_FLOWS = (
    "revenue", "gross_profit", "operating_income", "net_income", "ebitda", "operating_cash_flow",
    "capital_expenditures", "free_cash_flow", "income_tax_expense", "income_before_tax", "interest_expense",
)
TTM_BALANCES = (
    "total_assets", "total_liabilities", "stockholders_equity", "cash_and_equivalents", "total_debt",
    "shares_outstanding",
)


def rebuild_derived(df: DataFrame, prior_eps: dict[str, Column], recompute: Column) -> DataFrame:
    """Re-derive FCF, per-share and EBITDA columns of rows whose basis changed."""
    c = F.col
    have = set(df.columns)
    out: dict[str, Column] = {}
    if {"operating_cash_flow", "capital_expenditures", "free_cash_flow"} <= have:
        fcf = exact_minus(c("operating_cash_flow"), F.abs("capital_expenditures"))
        out["free_cash_flow"] = F.coalesce(fcf, c("free_cash_flow"))
    ni = c("net_income")
    for k in PER_SHARE:
        if k not in have:
            continue
        own = round_half_up(safe_div(ni, truthy("shares_outstanding")), 2)
        diff = round_half_up(c(k) - prior_eps[k], 2)
        flipped = (ni != 0) & (diff != 0) & ((diff < 0) != (ni < 0))
        out[k] = F.coalesce(own, F.when(~F.coalesce(flipped, F.lit(False)), diff))
    if "ebitda" in have and "depreciation_amortization" in have:
        da = F.abs("depreciation_amortization")
        interest = F.abs(or_zero("interest_expense")) if "interest_expense" in have else F.lit(0.0)
        tax = or_zero("income_tax_expense") if "income_tax_expense" in have else F.lit(0.0)
        rebuilt = exact_total([ni, interest, tax, da])
        if "operating_income" in have:
            rebuilt = F.coalesce(rebuilt, exact_total([c("operating_income"), da]))
        out["ebitda"] = rebuilt
    return df.withColumns({k: F.when(recompute, v).otherwise(c(k)) for k, v in out.items()})


def _ties(df: DataFrame, *used: str) -> list[Column]:
    """All other columns that have an order, by name: rows that still tie are equal."""
    return [F.col(f.name).asc_nulls_last() for f in sorted(df.schema, key=lambda f: f.name)
            if f.name not in used and f.dataType.typeName() not in ("map", "variant")]


def decumulate(quarters: DataFrame, flows: Sequence[str] | None = None) -> DataFrame:
    """Standalone quarters from year-to-date rows of the same fiscal year.

    Rows need ``cik, fy, rank, is_ytd``. A row whose neighbour is missing keeps
    its running value and says so; a column the neighbour lacks becomes NULL.
    """
    flows = [m for m in (flows or FLOW_METRICS) if m in quarters.columns]
    shares = [k for k in PER_SHARE if k in quarters.columns]
    w = Window.partitionBy("cik", "fy").orderBy("rank", *_ties(quarters, "cik", "fy", "rank"))
    df = quarters.withColumn("__prev", F.lag("rank").over(w))
    df = df.withColumns({f"__p_{m}": F.lag(m).over(w) for m in [*flows, *shares]})
    known = F.col("fy").isNotNull() & F.col("rank").isNotNull()
    passes = (F.col("rank") == 1) | ~F.col("is_ytd")
    neighbour = F.coalesce(F.col("__prev") == F.col("rank") - 1, F.lit(False))
    quality = (
        F.when(~known, "unknown_period")
        .when(passes, "standalone")
        .when(~neighbour, "ytd_fallback")
        .otherwise("standalone_decumulated")
    )
    df = df.withColumn("quality", quality)
    changed = F.col("quality") == "standalone_decumulated"
    df = df.withColumns({
        m: F.when(changed, exact_minus(F.col(m), F.col(f"__p_{m}"))).otherwise(F.col(m)) for m in flows
    })
    df = rebuild_derived(df, {k: F.col(f"__p_{k}") for k in shares}, changed)
    still = F.col("quality").isin("ytd_fallback", "unknown_period") & F.col("is_ytd")
    return df.withColumn("is_ytd", still).select(*quarters.columns, "quality")


def match_annual_to_q3(q3: DataFrame, annual: DataFrame, lo: int = 60, hi: int = 130) -> DataFrame:
    """The newest annual report whose period ends one quarter after Q3.

    ``q3`` has (cik, fy, q3_end); ``annual`` has (cik, report_date, ...).
    """
    day = day_number(F.col("q3_end"))
    near = window_join(q3, annual, ["cik"], day + lo, day + hi, day_number(F.col("report_date")), hi - lo + 1)
    ties = [F.col("accn")] if "accn" in annual.columns else []
    w = Window.partitionBy("cik", "fy").orderBy(F.col("report_date").desc(), *ties)
    return near.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def has_first_three(ranks: Column) -> Column:
    """True when the set of ranks holds the first three quarters."""
    return (
        F.array_contains(ranks, 1) & F.array_contains(ranks, 2) & F.array_contains(ranks, 3)
    )


def synthesize_q4(quarters: DataFrame, annual: DataFrame, flows: Sequence[str] | None = None) -> DataFrame:
    """Fourth quarters as the year less its three standalone quarters.

    ``quarters`` is the output of :func:`decumulate` with ``end_date``;
    ``annual`` has ``cik, report_date`` and the same metric columns. Balances
    come from the annual report. Returns only the new rows.
    """
    flows = [m for m in (flows or FLOW_METRICS) if m in quarters.columns]
    shares = [k for k in PER_SHARE if k in quarters.columns]
    clean = quarters.where(F.col("quality").startswith("standalone") & F.col("rank").isNotNull())
    aggs = [F.collect_set("rank").alias("ranks"), F.max(F.when(F.col("rank") == 3, F.col("end_date"))).alias("q3_end")]
    for m in [*flows, *shares]:
        three = F.col("rank") <= 3
        total = F.sum(F.when(three, F.col(m).cast("decimal(28,4)"))).cast("double")
        aggs.append(F.when(F.count(F.when(three, F.col(m))) == 3, total).alias(f"__s_{m}"))
    groups = clean.groupBy("cik", "fy").agg(*aggs)
    groups = groups.where(has_first_three(F.col("ranks")) & ~F.array_contains("ranks", 4)).drop("ranks")
    carried = [c for c in annual.columns if c not in ("cik", "fy")]
    matched = match_annual_to_q3(groups, annual.select("cik", *carried))
    out = matched.withColumns({m: exact_minus(F.col(m), F.col(f"__s_{m}")) for m in flows})
    out = rebuild_derived(out, {k: F.col(f"__s_{k}") for k in shares}, F.lit(True))
    out = out.where(F.col("revenue") > 0)
    out = out.withColumns({
        "rank": F.lit(4), "is_ytd": F.lit(False), "quality": F.lit("q4_synthesized"),
        "end_date": F.col("report_date"),
    })
    return out.select(*[c if c in out.columns else F.lit(None).alias(c) for c in quarters.columns])


def summable(quality: Column | str = "quality") -> Column:
    """True for rows that may be added: clean quarters and unlabelled ones."""
    q = F.col(quality) if isinstance(quality, str) else quality
    return F.coalesce(q, F.lit("")).isin(*SUMMABLE)


def newest(df: DataFrame, n: int, order: str = "end_date", keys: Sequence[str] = ("cik",)) -> DataFrame:
    """The n newest rows per key, numbered from one."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *_ties(df, order, *keys))
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def newest_summable(quarters: DataFrame, n: int) -> DataFrame:
    """The n newest clean quarters per company.

    Companies without any keep unusable rows, so that they can be reported.
    """
    flagged = quarters.withColumn("usable", summable())
    w = Window.partitionBy("cik").orderBy(F.col("usable").desc(), F.col("end_date").desc_nulls_last(), *_ties(quarters, "cik", "end_date"))
    return flagged.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def _at(n: int, c: str) -> Column:
    return F.max(F.when(F.col("usable") & (F.col("n") == n), F.col(c)))


def _aliases(df: DataFrame) -> DataFrame:
    """Columns that older consumers read under a second name."""
    return df.withColumns({
        "total_equity": F.col("stockholders_equity"),
        "net_debt": F.col("total_debt") - or_zero("cash_and_equivalents"),
    })


def _year_ago(gap: Column, c: str) -> Column:
    return F.when(gap.between(330, 400), _at(5, c))


def trailing_twelve_months(quarters: DataFrame) -> DataFrame:
    """Newest four standalone quarters per company, or why there is no sum.

    A gap in a flow makes its sum NULL. Rows with a status other than ``ok``
    carry no metrics.
    """
    top = newest_summable(quarters, 5)
    gap = F.datediff(_at(1, "end_date"), _at(5, "end_date"))
    plain = F.coalesce(F.col("quality"), F.lit("standalone")) == "standalone"
    four = F.col("usable") & (F.col("n") <= 4)
    aggs = [
        F.count_if(F.col("usable")).alias("n_quarters"),
        _at(1, "end_date").alias("as_of"),
        _at(1, "fy").alias("fiscal_year"),
        _at(1, "form").alias("form"),
        F.datediff(_at(1, "end_date"), _at(4, "end_date")).alias("span_days"),
        F.min(F.when(four, plain)).alias("__plain"),
        F.when(F.count(F.when(four, F.col("eps_diluted"))) == 4,
               F.sum(F.when(four, F.col("eps_diluted").cast("decimal(28,4)"))).cast("double")).alias("__eps_sum"),
        _year_ago(gap, "stockholders_equity").alias("prior_equity"),
        _year_ago(gap, "total_assets").alias("prior_assets"),
    ]
    for m in TTM_FLOWS:
        total = F.sum(F.when(four, F.col(m).cast("decimal(28,4)"))).cast("double")
        aggs.append(F.when(F.count(F.when(four, F.col(m))) == 4, total).alias(m))
    aggs += [_at(1, m).alias(m) for m in TTM_BALANCES]
    df = top.groupBy("cik").agg(*aggs)
    df = df.withColumn("status", (
        F.when(F.col("n_quarters") < 4, "too_few_quarters")
        .when(~F.coalesce(F.col("span_days").between(240, 300), F.lit(False)), "window_check_failed")
        .otherwise("ok")
    ))
    df = df.withColumn("capital_expenditures", F.abs("capital_expenditures"))
    own = safe_div("net_income", truthy("shares_outstanding"))
    df = df.withColumn("eps_diluted", F.coalesce(own, F.when(F.col("__plain"), F.col("__eps_sum"))))
    df = _aliases(df)
    ok = F.col("status") == "ok"
    metrics = [*TTM_FLOWS, *TTM_BALANCES, "eps_diluted", "total_equity", "net_debt"]
    shown = {m: F.when(ok, F.col(m)) for m in [*metrics, "prior_equity", "prior_assets", "as_of", "fiscal_year", "form"]}
    df = df.withColumns(shown).withColumn("quality", F.when(ok, "ttm_sum_4q"))
    return df.select(
        "cik", "status", "as_of", "fiscal_year", "form", "quality", "n_quarters", "span_days",
        *metrics, "prior_equity", "prior_assets",
    )


def year_ago_prior(quarters: DataFrame) -> DataFrame:
    """Balances one year before the newest quarter, where it really is a year."""
    top = newest_summable(quarters, 5)
    gap = F.datediff(_at(1, "end_date"), _at(5, "end_date"))
    return top.groupBy("cik").agg(
        _at(1, "end_date").alias("as_of"),
        gap.alias("gap_days"),
        _year_ago(gap, "stockholders_equity").alias("prior_equity"),
        _year_ago(gap, "total_assets").alias("prior_assets"),
    )


def latest_quarter(quarters: DataFrame) -> DataFrame:
    """The newest standalone quarter, if its distance to the one before is a quarter."""
    top = newest(quarters.where(summable()), 5)
    w_next = Window.partitionBy("cik").orderBy("n")
    top = top.withColumn("__gap", F.datediff("end_date", F.lead("end_date").over(w_next)))
    year_gap = F.datediff("end_date", F.lead("end_date", 4).over(w_next))
    in_year = year_gap.between(330, 400)
    top = top.withColumns({
        "prior_equity": F.when(in_year, F.lead("stockholders_equity", 4).over(w_next)),
        "prior_assets": F.when(in_year, F.lead("total_assets", 4).over(w_next)),
    })
    df = top.where("n = 1")
    lone = F.col("__gap").isNull()
    status = (
        F.when(~lone & F.col("__gap").between(75, 110), "ok")
        .when(~lone, "cadence_check_failed")
        .when(F.col("form") == "10-Q", "ok")
        .otherwise("single_period")
    )
    own = safe_div("net_income", truthy("shares_outstanding"))
    plain = F.coalesce(F.col("quality"), F.lit("standalone")) == "standalone"
    df = df.withColumns({
        "status": status,
        "capital_expenditures": F.abs("capital_expenditures"),
        "eps_diluted": F.coalesce(F.when(plain, F.col("eps_diluted")), own),
    })
    df = _aliases(df)
    metrics = [*TTM_FLOWS, *TTM_BALANCES, "eps_diluted", "total_equity", "net_debt"]
    ok = F.col("status") == "ok"
    return df.select(
        "cik", "status", "fy", "fiscal_period", "form", "end_date", "quality",
        *[F.when(ok, F.col(m)).alias(m) for m in metrics],
        F.when(ok, F.col("prior_equity")).alias("prior_equity"),
        F.when(ok, F.col("prior_assets")).alias("prior_assets"),
    )


def compare_periods(series: DataFrame, *, quarterly: bool = False, keys: Sequence[str] = ("cik", "metric")) -> DataFrame:
    """Each value with the one a year before and, for quarters, the one before."""
    w = Window.partitionBy(*keys).orderBy("end_date")
    out = series.withColumn("yoy_prior", F.lag("value", 4 if quarterly else 1).over(w))
    if quarterly:
        out = out.withColumn("qoq_prior", F.lag("value", 1).over(w))
    return out


def newest_periods(rows: DataFrame, limit: int, quarterly: bool = False, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Newest-first slice of at most twelve periods; quarters get one neighbour more."""
    want = max(limit, 1)
    return newest(rows, want + 1 if quarterly else want, keys=keys)


def overlay(annual: DataFrame, other: DataFrame, metrics: Sequence[str], period: str) -> DataFrame:
    """Replace annual metrics by TTM or quarter ones where those exist.

    ``other`` has ``cik, status`` and the metrics. Companies without a usable
    row keep the annual figures and say ``annual_fallback``.
    """
    rename = {m: f"o_{m}" for m in metrics}
    right = other.select("cik", F.col("status").alias("o_status"), *[F.col(m).alias(n) for m, n in rename.items()])
    joined = annual.join(right, "cik", "left")
    ok = F.coalesce(F.col("o_status") == "ok", F.lit(False))
    cols = {m: F.when(ok, F.col(n)).otherwise(F.col(m)) for m, n in rename.items()}
    out = joined.withColumns(cols).withColumn("basis", F.when(ok, period).otherwise("annual_fallback"))
    return out.drop("o_status", *rename.values())
