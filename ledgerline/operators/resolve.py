"""From tagged facts to canonical metrics, for every company at once.

One join against the small rule table and one grouping replace a lookup per
metric: each metric keeps its best total, and the sum of its tagged components
where no total exists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import concepts as C
from ledgerline.functions.numeric import confidence_of, exact_sum, or_zero, safe_div, safe_num, truthy

PERIOD = ("cik", "end_date")
MAX_RULES = 20_000


def rule_table(df: DataFrame, rules: Sequence[C.ConceptRule], metrics: Sequence[str] | None = None) -> DataFrame:
    """The rules as a broadcast table; the dictionary's size is checked here."""
    if metrics is not None:
        wanted = set(metrics)
        rules = [r for r in rules if r.metric in wanted]
    if len(rules) > MAX_RULES:
        raise ValueError("the concept dictionary is too large to send to every task")
    schema = "metric string, rule_industry string, priority int, tag string, display string, aggregate boolean"
    rows = [(r.metric, r.industry, r.priority, r.tag, r.display, r.aggregate) for r in rules if not r.fuzzy]
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def bare_tag(concept: Column | str = "concept") -> Column:
    """The tag without a namespace prefix (``ns:Tag`` or ``ns_Tag``)."""
    c = F.col(concept) if isinstance(concept, str) else concept
    return F.regexp_extract(c, "([^:_]+)$", 1)


def is_forecast(concept: Column) -> Column:
    low = F.lower(concept)
    hit = F.lit(False)
    for w in C.FORECAST_WORDS:
        hit = hit | low.contains(w.lower())
    return hit


def is_custom_net_revenue(concept: Column) -> Column:
    return concept.rlike(C.CUSTOM_NET_REVENUE) & ~is_forecast(concept)


def is_custom_revenue(concept: Column) -> Column:
    return concept.rlike(C.CUSTOM_REVENUE) & ~is_forecast(concept)


def with_industry(facts: DataFrame, industry: DataFrame | None) -> DataFrame:
    """Attach the industry class of each company; unknown means standard."""
    if industry is None:
        return facts.withColumn("industry", F.lit("standard"))
    joined = facts.join(industry.select("cik", "industry"), "cik", "left")
    return joined.withColumn("industry", F.coalesce("industry", F.lit("standard")))


def candidates(
    facts: DataFrame,
    rules: Sequence[C.ConceptRule],
    keys: Sequence[str] = PERIOD,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Every (key, metric) candidate with its step, rank and confidence.

    One pass: each fact meets the rules of its tag and, where its name looks
    like a custom revenue tag, adds a candidate of its own.
    """
    base = facts.select(*keys, "industry", "concept", safe_num("value").alias("value")).where("value IS NOT NULL")
    mine = [r for r in rules if metrics is None or r.metric in metrics]
    if metrics is not None and "revenue" not in metrics and not any(r.fuzzy for r in mine):
        # Only the rules' tags can count; said of the tag alone, this reaches below the windows that made the facts.
        base = base.where(bare_tag().isin(sorted({r.tag for r in mine})))
    df = base.withColumn("tag", bare_tag()).join(rule_table(facts, rules, metrics), "tag", "left")
    fits = F.col("rule_industry").isin("*") | (F.col("rule_industry") == F.col("industry"))
    direct = F.col("concept") == F.col("tag")
    # A prefixed tag only counts for companies that never use the bare one.
    bare_used = F.max(direct & fits).over(Window.partitionBy("cik", "tag"))
    bank = F.col("industry") == "bank"
    custom = F.lit(False)
    if metrics is None or "revenue" in metrics:
        name = F.col("concept")
        custom = (bank & is_custom_net_revenue(name)) | (~bank & is_custom_revenue(name))
    loose = [r for r in rules if r.fuzzy and not r.aggregate and (metrics is None or r.metric in metrics)]

    def fuzzy_hit(r: C.ConceptRule) -> Column:
        return F.lower("concept").contains(r.tag.lower()) & F.lit(r.industry).isin("*", F.col("industry"))

    wanted = F.coalesce(fits, F.lit(False)) | custom
    for r in loose:
        wanted = wanted | fuzzy_hit(r)
    df = df.where(wanted)
    df = df.withColumn("__bare", F.coalesce(bare_used, F.lit(False)))

    def made(step, metric, priority, size, source, confidence, method) -> Column:
        return F.struct(
            metric.alias("metric"), F.lit(step).alias("step") if isinstance(step, int) else step.alias("step"),
            priority.alias("priority"), size.alias("size"), source.alias("source"),
            confidence.alias("confidence"), method.alias("method"),
        )

    by_rule = F.when(
        F.coalesce(fits, F.lit(False)) & (direct | ~F.col("__bare")),
        made(
            F.when(F.col("aggregate"), 4).otherwise(1), F.col("metric"), F.col("priority"), F.lit(0.0),
            F.col("display"), F.lit(0.99), F.when(F.col("aggregate"), "aggregate").otherwise("exact"),
        ),
    )
    label = F.when(bank, "Custom Net Revenue").otherwise("Custom Revenue")
    by_name = F.when(
        custom,
        made(
            3, F.lit("revenue"), F.lit(0), -F.abs("value"), F.concat(label, F.lit(" ("), "concept", F.lit(")")),
            F.when(bank, 0.85).otherwise(0.80), F.lit("custom_ext"),
        ),
    )
    found = [by_rule, by_name]
    for r in loose:
        found.append(F.when(fuzzy_hit(r), made(
            2, F.lit(r.metric), F.lit(r.priority), F.lit(0.0), F.lit(r.display), F.lit(0.90), F.lit("contains"),
        )))
    out = df.select(*keys, "value", F.explode(F.array_compact(F.array(*found))).alias("c"))
    return out.select(*keys, "value", "c.*")


def resolve_metrics(
    facts: DataFrame,
    rules: Sequence[C.ConceptRule] | None = None,
    *,
    industry: DataFrame | None = None,
    keys: Sequence[str] = PERIOD,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (keys, metric): value, source, confidence, method.

    ``facts`` holds one row per (keys, concept), already filtered to a period.
    """
    rules = list(rules) if rules is not None else C.default_rules()
    if "industry" not in facts.columns:
        facts = with_industry(facts, industry)
    cand = candidates(facts, rules, keys, metrics)
    total = F.col("step") < 4
    pick = F.struct("value", "source", "confidence", "method")
    # The value comes last, so that two units or prefixes of one tag have an order too.
    order = F.struct("step", "priority", "size", "source", "value")
    grouped = cand.groupBy(*keys, "metric").agg(
        F.min_by(F.when(total, pick), F.when(total, order)).alias("best"),
        exact_sum(F.when(~total, F.col("value"))).alias("parts"),
        F.array_sort(F.collect_set(F.when(~total, F.struct("priority", "source")))).alias("names"),
    )
    n = F.size("names")
    summed = F.struct(
        F.col("parts").alias("value"),
        F.array_join(F.transform("names", lambda x: x["source"]), " + ").alias("source"),
        F.least(F.lit(0.85), F.lit(0.60) + F.lit(0.05) * n).alias("confidence"),
        F.lit("aggregate").alias("method"),
    )
    return grouped.select(*keys, "metric", F.coalesce("best", summed).alias("m")).select(*keys, "metric", "m.*")


def pivot_metrics(resolved: DataFrame, metrics: Sequence[str], keys: Sequence[str] = PERIOD) -> DataFrame:
    """Wide form: each metric with ``<name>__src`` and ``<name>__conf``.

    One grouping gathers a key's metrics in a map, which is then read by name:
    the work grows with the metrics that a key has, not with keys times metrics.
    """
    entry = F.struct("metric", F.struct("value", "source", "confidence"))
    held = resolved.where(F.col("metric").isin(list(metrics))).groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("__held"))
    # Each metric is looked up once, its three columns are read off the result.
    wide = held.select(*keys, *[F.col("__held")[m].alias(f"__{m}") for m in metrics])
    return wide.select(*keys, *[
        F.col(f"__{m}")[part].alias(f"{m}{end}")
        for m in metrics for part, end in (("value", ""), ("source", "__src"), ("confidence", "__conf"))
    ])


# Tags read directly by the derivation rules.
HELPER_TAGS = (
    "CostOfGoodsSold", "CostOfGoodsAndServicesSold", "CostOfSales", "CostOfServices",
    "CashAndCashEquivalentsAtCarryingValue", "ShortTermInvestments", "AccountsReceivableNetCurrent",
    "InventoryNet", "PrepaidExpenseAndOtherAssetsCurrent", "OtherAssetsCurrent",
    "PaymentsToAcquireEquipmentOnLease",
    "DepreciationDepletionAndAmortization", "DepreciationAndAmortization",
    "DepreciationAmortizationAndAccretionNet", "Depreciation", "AmortizationOfIntangibleAssets",
    "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "Revenue", "SalesRevenueNet",
    "NetRevenues", "TotalRevenues", "OperatingRevenue", "RealEstateRevenueNet",
    "InterestAndDividendIncomeOperating",
)
_COGS = HELPER_TAGS[:4]
_CURRENT = HELPER_TAGS[4:10]
_DA_TOTALS = HELPER_TAGS[11:14]
_BROAD_REVENUE = HELPER_TAGS[16:]


def helper_rules(tags: Sequence[str] = HELPER_TAGS) -> list[C.ConceptRule]:
    """Raw tags as pseudo metrics ``t_<tag>``, resolved in the same pass."""
    return [C.ConceptRule(f"t_{t}", "*", 1, t, t) for t in tags]


def pivot_tags(facts: DataFrame, tags: Sequence[str] = HELPER_TAGS, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Raw tag values side by side, prefixed ``t_``."""
    aggs = [F.max(F.when(F.col("concept") == t, safe_num("value"))).alias(f"t_{t}") for t in tags]
    return facts.where(F.col("concept").isin(*tags)).groupBy(*keys).agg(*aggs)


def depreciation_total(df: DataFrame) -> Column:
    """The largest tagged D&A total, else depreciation plus amortization."""
    largest = F.greatest(*[F.abs(F.col(f"t_{t}")) for t in _DA_TOTALS])
    parts = F.abs("t_Depreciation") + F.abs(or_zero("t_AmortizationOfIntangibleAssets"))
    return F.coalesce(largest, parts)


def current_assets_rollup() -> tuple[Column, Column]:
    """(sum, count) of tagged current-asset components."""
    total, n = None, None
    for t in _CURRENT:
        c = F.col(f"t_{t}")
        part = F.coalesce(c, F.lit(0.0)).cast("decimal(28,4)")
        one = c.isNotNull().cast("int")
        total = part if total is None else total + part
        n = one if n is None else n + one
    return total.cast("double"), n


def derive_metrics(wide: DataFrame) -> DataFrame:
    """Fill what can be computed, in order, with source and confidence.

    ``wide`` is :func:`pivot_metrics` joined to :func:`pivot_tags`. Later steps
    read earlier ones, so each step is its own projection.
    """
    c = F.col

    def conf(m: str) -> Column:
        return F.coalesce(c(f"{m}__conf"), F.lit(0.0))

    # Gross profit from revenue and cost, if untagged.
    cost = F.coalesce(c("cost_of_revenue"), *[c(f"t_{t}") for t in _COGS])
    made = c("gross_profit").isNull() & c("revenue").isNotNull() & cost.isNotNull()
    df = wide.withColumns({
        "gross_profit": F.when(made, c("revenue") - F.abs(cost)).otherwise(c("gross_profit")),
        "gross_profit__src": F.when(made, "Computed: Revenue - Cost of Revenue").otherwise(c("gross_profit__src")),
        "gross_profit__conf": F.when(
            made, confidence_of(conf("revenue"), F.coalesce(c("cost_of_revenue__conf"), F.lit(0.0)), factor=0.9)
        ).otherwise(c("gross_profit__conf")),
    })

    # Current assets from at least two components.
    total, n = current_assets_rollup()
    made = c("current_assets").isNull() & (n >= 2)
    df = df.withColumns({
        "current_assets": F.when(made, total).otherwise(c("current_assets")),
        "current_assets__src": F.when(
            made, F.concat(F.lit("Computed: sum of "), n.cast("string"), F.lit(" current asset components"))
        ).otherwise(c("current_assets__src")),
        "current_assets__conf": F.when(made, 0.70).otherwise(c("current_assets__conf")),
    })

    # Operating income, unless the expense line already holds the cost of sales.
    spent_all = F.coalesce(c("operating_expenses__src"), F.lit("")).contains("Costs and Expenses")
    made = (
        c("operating_income").isNull() & c("gross_profit").isNotNull()
        & c("operating_expenses").isNotNull() & ~spent_all
    )
    df = df.withColumns({
        "operating_income": F.when(made, c("gross_profit") - F.abs("operating_expenses")).otherwise(c("operating_income")),
        "operating_income__src": F.when(made, "Computed: Gross Profit - OpEx").otherwise(c("operating_income__src")),
        "operating_income__conf": F.when(made, 0.70).otherwise(c("operating_income__conf")),
    })

    # Equipment bought to lease out belongs to headline capital expenditure.
    lease = c("t_PaymentsToAcquireEquipmentOnLease")
    made = c("capital_expenditures__src").contains("Capital Expenditures") & (lease > 0)
    made = F.coalesce(made & c("capital_expenditures").isNotNull(), F.lit(False))
    df = df.withColumns({
        "capital_expenditures": F.when(made, c("capital_expenditures") + lease).otherwise(c("capital_expenditures")),
        "capital_expenditures__src": F.when(
            made, F.concat("capital_expenditures__src", F.lit(" + Equipment on Lease"))
        ).otherwise(c("capital_expenditures__src")),
    })

    # Liabilities as the rest of the balance sheet.
    made = c("total_liabilities").isNull() & c("total_assets").isNotNull() & c("stockholders_equity").isNotNull()
    rest = c("total_assets") - c("stockholders_equity") - or_zero("minority_interest")
    df = df.withColumns({
        "total_liabilities": F.when(made, rest).otherwise(c("total_liabilities")),
        "total_liabilities__src": F.when(made, "Computed: Assets - Equity - NCI").otherwise(c("total_liabilities__src")),
        "total_liabilities__conf": F.when(made, 0.80).otherwise(c("total_liabilities__conf")),
    })

    # Debt, net debt, free cash flow.
    owed = c("long_term_debt").isNotNull() | c("short_term_debt").isNotNull()
    df = df.withColumn(
        "total_debt", F.when(owed, or_zero("long_term_debt") + or_zero("short_term_debt"))
    ).withColumns({
        "net_debt": c("total_debt") - or_zero("cash_and_equivalents"),
        "free_cash_flow": c("operating_cash_flow") - F.abs("capital_expenditures"),
        "free_cash_flow__conf": F.when(
            c("operating_cash_flow").isNotNull() & c("capital_expenditures").isNotNull(),
            confidence_of(conf("operating_cash_flow"), conf("capital_expenditures")),
        ).otherwise(0.0),
    })

    # D&A: the served figure must not be smaller than the one EBITDA uses.
    df = df.withColumn("da_total", depreciation_total(df))
    made = c("da_total").isNotNull() & (
        c("depreciation_amortization").isNull() | (F.abs("depreciation_amortization") < c("da_total"))
    )
    df = df.withColumns({
        "depreciation_amortization": F.when(made, c("da_total")).otherwise(c("depreciation_amortization")),
        "depreciation_amortization__src": F.when(made, "D&A (largest tagged total)").otherwise(
            c("depreciation_amortization__src")
        ),
    })

    # EBITDA: tax keeps its sign, interest does not.
    full = (
        c("net_income") + F.abs(or_zero("interest_expense")) + or_zero("income_tax_expense") + F.abs("da_total")
    )
    from_income = c("net_income").isNotNull() & c("da_total").isNotNull()
    from_operating = c("operating_income").isNotNull() & c("da_total").isNotNull()
    df = df.withColumns({
        "ebitda": F.when(from_income, full).when(from_operating, c("operating_income") + F.abs("da_total")),
        "ebitda__conf": F.when(
            from_income,
            F.when(c("interest_expense").isNotNull() & c("income_tax_expense").isNotNull(), 0.85).otherwise(0.70),
        ).when(from_operating, 0.65).otherwise(0.0),
        "ebitda__src": F.when(~from_income & from_operating, "Approximated: Operating Income + D&A"),
    })

    # Income above revenue points to a partial revenue tag: take a broader one.
    suspect = (c("revenue") > 0) & (c("net_income") > 0) & (c("net_income") > c("revenue"))
    best = F.greatest(*[c(f"t_{t}") for t in _BROAD_REVENUE])
    first_tag = F.coalesce(*[F.when(c(f"t_{t}") == best, F.lit(t)) for t in _BROAD_REVENUE])
    fix = F.coalesce(suspect & (best > c("revenue")), F.lit(False))
    return df.withColumns({
        "revenue": F.when(fix, best).otherwise(c("revenue")),
        "revenue__src": F.when(fix, F.concat(first_tag, F.lit(" (auto-corrected)"))).otherwise(c("revenue__src")),
        "revenue__conf": F.when(fix, 0.80).otherwise(c("revenue__conf")),
    })


# Metrics the derivation rules need side by side.
CORE_METRICS = (
    "revenue", "cost_of_revenue", "gross_profit", "operating_income", "operating_expenses", "net_income",
    "income_tax_expense", "income_before_tax", "interest_expense", "depreciation_amortization",
    "operating_cash_flow", "capital_expenditures", "total_assets", "current_assets", "total_liabilities",
    "current_liabilities", "stockholders_equity", "total_equity", "minority_interest", "long_term_debt",
    "short_term_debt", "cash_and_equivalents", "shares_outstanding", "eps_basic", "eps_diluted",
)

# Every metric of the tag rules, those the derivations need first.
ALL_METRICS = tuple(dict.fromkeys([*CORE_METRICS, *[r.metric for r in C.default_rules()]]))
# What the derivations add.
DERIVED_METRICS = ("total_debt", "net_debt", "free_cash_flow", "ebitda")


def extract(
    view: DataFrame,
    *,
    industry: DataFrame | None = None,
    rules: Sequence[C.ConceptRule] | None = None,
    metrics: Sequence[str] = CORE_METRICS,
    keys: Sequence[str] = PERIOD,
) -> DataFrame:
    """Period-filtered facts to derived metrics, one row per ``keys``.

    ``view`` comes from :func:`facts.annual_facts` or :func:`facts.ytd_facts`.
    """
    rules = [*(rules if rules is not None else C.default_rules()), *helper_rules()]
    wanted = [*metrics, *[f"t_{t}" for t in HELPER_TAGS]]
    resolved = resolve_metrics(view, rules, industry=industry, keys=keys, metrics=wanted)
    return derive_metrics(pivot_metrics(resolved, wanted, keys))


# Metrics never converted; per-share amounts are.
NOT_CONVERTED = (
    "shares_outstanding", "reit_occupancy", "insurance_combined_ratio", "bank_efficiency",
    "bank_net_interest_margin", "fintech_take_rate", "gross_margin", "operating_margin", "net_margin",
    "return_on_assets", "return_on_equity", "current_ratio", "debt_to_equity", "debt_to_assets",
    "ebitda_margin", "fcf_margin", "ocf_to_net_income", "retail_same_store", "retail_store_count",
)


def convert_currency(metrics: DataFrame, rates: DataFrame, to: str = "USD") -> DataFrame:
    """Long metrics with a ``currency`` column into ``to``.

    A direct rate wins, then the inverse of the opposite one; without either
    the value stays as it is and ``fx_rate`` is NULL.
    """
    direct = rates.where(F.col("to_ccy") == to).groupBy(F.col("from_ccy").alias("currency")).agg(
        F.max("rate").alias("__direct")
    )
    inverse = rates.where((F.col("from_ccy") == to) & (F.col("rate") > 0)).groupBy(
        F.col("to_ccy").alias("currency")
    ).agg(F.max(1 / F.col("rate")).alias("__inverse"))
    out = metrics.join(direct, "currency", "left").join(inverse, "currency", "left")
    rate = F.when(F.col("currency") == to, F.lit(1.0)).otherwise(F.coalesce("__direct", "__inverse"))
    out = out.withColumn("fx_rate", rate)
    keep = F.col("metric").isin(*NOT_CONVERTED) | F.col("fx_rate").isNull()
    return out.withColumn(
        "value", F.when(keep, F.col("value")).otherwise(F.col("value") * F.col("fx_rate"))
    ).drop("__direct", "__inverse").select(*metrics.columns, "fx_rate")


def resolver_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 0.001) -> DataFrame:
    """Two resolutions side by side; rows on which they disagree."""
    a = left.select(*keys, F.col("value").alias("left_value"))
    b = right.select(*keys, F.col("value").alias("right_value"))
    both = a.join(b, list(keys), "full_outer")
    rel = safe_div(
        F.abs(F.col("left_value") - F.col("right_value")),
        F.greatest(F.abs("left_value"), F.lit(1e-9)),
    )
    comparable = F.col("left_value").isNotNull() & F.col("right_value").isNotNull() & (F.col("left_value") != 0)
    both = both.withColumn("rel_diff", F.when(comparable, rel))
    agree = comparable & (F.col("rel_diff") < tolerance)
    neither = F.col("left_value").isNull() & F.col("right_value").isNull()
    return both.where(~F.coalesce(agree, F.lit(False)) & ~neither)


def bank_revenue_drivers(facts: DataFrame, totals: DataFrame, keys: Sequence[str] = PERIOD) -> DataFrame:
    """Bank revenue by income type, with a plug row so that rows reach the total.

    ``totals`` has (keys, total_net_revenue). Companies with neither interest
    nor noninterest income give no rows.
    """
    rules = C.bank_driver_rules()
    picked = resolve_metrics(
        facts.withColumn("industry", F.lit("standard")), rules, keys=keys,
        metrics=list(dict.fromkeys(r.metric for r in rules)),
    )
    drivers = ["net_interest_income", "noninterest_income", *C.BANK_SUBDRIVERS]
    aggs = [F.max(F.when(F.col("metric") == d, F.col("value"))).alias(d) for d in drivers]
    wide = picked.groupBy(*keys).agg(*aggs).join(totals, list(keys), "left")
    nii, non = F.col("net_interest_income"), F.col("noninterest_income")
    wide = wide.where(nii.isNotNull() | non.isNotNull())
    wide = wide.withColumn("total", F.coalesce("total_net_revenue", nii + non))
    accounted = or_zero("net_interest_income")
    sub_found = F.lit(False)
    for d in C.BANK_SUBDRIVERS:
        accounted = accounted + or_zero(d)
        sub_found = sub_found | F.col(d).isNotNull()
    wide = wide.withColumn("residual", F.col("total") - accounted).withColumn("sub_found", sub_found)
    plug = F.coalesce(F.col("residual") > F.abs("total") * 0.005, F.lit(False))
    names = {r.metric: r.display for r in reversed(rules)}
    parts = [F.struct(F.lit("net_interest_income").alias("driver"), F.lit("Net Interest Income").alias("label"),
                      nii.alias("value"))]
    parts += [F.struct(F.lit(d).alias("driver"), F.lit(names[d]).alias("label"), F.col(d).alias("value"))
              for d in C.BANK_SUBDRIVERS]
    other = F.when(non.isNotNull() & F.col("sub_found"), "Other Fee Income").otherwise("Other Revenue")
    parts.append(F.struct(F.lit("other_revenue").alias("driver"), other.alias("label"),
                          F.when(plug, F.col("residual")).alias("value")))
    alone = F.when(F.col("total").isNull() & ~F.col("sub_found"), non)
    parts.append(F.struct(F.lit("noninterest_income").alias("driver"), F.lit("Noninterest Income").alias("label"),
                          alone.alias("value")))
    reached = accounted + F.when(plug, F.col("residual")).otherwise(0.0)
    tight = F.abs("total") * 0.01
    wide = wide.withColumns({
        "reconciles": F.coalesce(F.abs(reached - F.col("total")) <= tight, F.lit(False)),
        "tier1_identity": F.coalesce(F.abs(nii + non - F.col("total")) <= tight, F.lit(False)),
    })
    rows = wide.select(*keys, "total", "reconciles", "tier1_identity", F.explode(F.array(*parts)).alias("p"))
    rows = rows.select(*keys, "total", "reconciles", "tier1_identity", "p.*").where("value IS NOT NULL")
    return rows.withColumn("share", safe_div("value", truthy("total")))
