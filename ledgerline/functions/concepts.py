"""Which reporting tags stand for which metric.

The built-in rules cover the common tags. A longer dictionary is a parameter:
``load_rules`` reads a CSV with the same columns.
"""

from __future__ import annotations

import csv
from typing import NamedTuple


class ConceptRule(NamedTuple):
    metric: str
    industry: str
    priority: int
    tag: str
    display: str
    aggregate: bool = False
    fuzzy: bool = False


# Metric, industry (* is any), tag, display name; True marks a
# component that is only summed when no total is tagged.
_RULES = (
    ("revenue", "standard", "Revenues", "Total Revenue"),
    ("revenue", "standard", "Revenue", "Revenue"),
    ("revenue", "standard", "SalesRevenueNet", "Net Sales Revenue"),
    ("revenue", "standard", "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenue from Contract with Customer"),
    ("revenue", "standard", "RevenueFromContractWithCustomerIncludingAssessedTax", "Revenue from Contract with Customer (incl. tax)"),
    ("revenue", "standard", "TotalRevenues", "Total Revenues"),
    ("revenue", "standard", "OperatingRevenue", "Operating Revenue"),
    ("revenue", "standard", "SalesRevenueServicesNet", "Net Services Revenue"),
    ("revenue", "standard", "SalesRevenueGoodsNet", "Net Goods Revenue"),
    ("revenue", "standard", "NetRevenues", "Net Revenues"),
    ("revenue", "standard", "TotalRevenuesAndOtherIncome", "Total Revenues and Other Income"),
    ("revenue", "standard", "RevenueFromContractsWithCustomers", "IFRS Revenue"),
    ("revenue", "standard", "Turnover", "IFRS Turnover"),
    ("revenue", "standard", "GrossRevenue", "Gross Revenue"),
    ("revenue", "bank", "NetRevenues", "Net Revenues"),
    ("revenue", "bank", "RevenuesNetOfInterestExpense", "Revenue Net of Interest Expense"),
    ("revenue", "bank", "Revenues", "Total Revenue"),
    ("revenue", "bank", "InterestIncomeExpenseNet", "Net Interest Income (alt)", True),
    ("revenue", "bank", "NoninterestIncome", "Noninterest Income", True),
    ("revenue", "bank", "InvestmentBankingRevenue", "Investment Banking Revenue", True),
    ("revenue", "bank", "TradingGainsLosses", "Trading Gains/Losses", True),
    ("revenue", "insurance", "Revenues", "Total Revenue"),
    ("revenue", "insurance", "NetRevenues", "Net Revenues"),
    ("revenue", "insurance", "InsuranceRevenue", "Insurance Revenue"),
    ("revenue", "insurance", "PremiumsEarnedNet", "Net Premiums Earned", True),
    ("revenue", "insurance", "NetInvestmentIncome", "Net Investment Income", True),
    ("revenue", "reit", "Revenues", "Total Revenue"),
    ("revenue", "reit", "RealEstateRevenueNet", "Net Real Estate Revenue"),
    ("revenue", "reit", "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenue from Contract with Customer"),
    ("revenue", "reit", "LeaseIncome", "Lease Income", True),
    ("revenue", "reit", "RentalRevenue", "Rental Revenue", True),
    ("revenue", "utility", "Revenues", "Total Revenue"),
    ("revenue", "utility", "RegulatedAndUnregulatedOperatingRevenue", "Regulated & Unregulated Revenue"),
    ("revenue", "utility", "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenue from Contract with Customer"),
    ("revenue", "utility", "ElectricUtilityRevenue", "Electric Utility Revenue", True),
    ("revenue", "utility", "GasUtilityRevenue", "Gas Utility Revenue", True),
    ("revenue", "crypto", "Revenues", "Total Revenue"),
    ("revenue", "crypto", "Revenue", "Revenue"),
    ("revenue", "crypto", "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenue from Contract with Customer"),
    ("cost_of_revenue", "*", "CostOfRevenue", "Cost of Revenue"),
    ("cost_of_revenue", "*", "CostOfGoodsAndServicesSold", "Cost of Goods & Services Sold"),
    ("cost_of_revenue", "*", "CostOfGoodsSold", "Cost of Goods Sold"),
    ("cost_of_revenue", "*", "CostOfSales", "IFRS Cost of Sales"),
    ("gross_profit", "*", "GrossProfit", "Gross Profit"),
    ("operating_expenses", "*", "OperatingExpenses", "Operating Expenses"),
    ("operating_expenses", "*", "CostsAndExpenses", "Costs and Expenses"),
    ("operating_expenses", "*", "OperatingCostsAndExpenses", "Operating Costs and Expenses"),
    ("sga_expense", "*", "SellingGeneralAndAdministrativeExpense", "SG&A Expense"),
    ("sga_expense", "*", "GeneralAndAdministrativeExpense", "G&A Expense"),
    ("rd_expense", "*", "ResearchAndDevelopmentExpense", "R&D Expense"),
    ("net_income", "*", "NetIncomeLoss", "Net Income (Loss)"),
    ("net_income", "*", "NetIncomeAttributableToParent", "Net Income Attributable to Parent"),
    ("net_income", "*", "ProfitLoss", "Profit (Loss)"),
    ("net_income", "*", "ProfitLossAttributableToOwnersOfParent", "IFRS Profit Attributable to Parent"),
    ("operating_income", "*", "OperatingIncomeLoss", "Operating Income (Loss)"),
    ("operating_income", "*", "IncomeLossFromOperations", "Income from Operations"),
    ("operating_income", "*", "ProfitLossFromOperatingActivities", "IFRS Operating Profit"),
    ("operating_income", "bank", "IncomeLossFromContinuingOperationsBeforeIncomeTaxes", "Pretax Income (operating proxy, alt2)"),
    ("operating_income", "insurance", "IncomeLossFromContinuingOperationsBeforeIncomeTaxes", "Pretax Income (operating proxy, alt2)"),
    ("other_income_expense", "*", "NonoperatingIncomeExpense", "Nonoperating Income (Expense)"),
    ("other_income_expense", "*", "OtherNonoperatingIncomeExpense", "Other Nonoperating Income (Expense)"),
    ("income_before_tax", "*", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "Income Before Tax"),
    ("income_before_tax", "*", "IncomeLossFromContinuingOperationsBeforeIncomeTaxes", "Income Before Tax (alt)"),
    ("income_before_tax", "*", "ProfitBeforeTax", "IFRS Profit Before Tax"),
    ("interest_expense", "*", "InterestExpense", "Interest Expense"),
    ("interest_expense", "*", "InterestExpenseDebt", "Interest Expense on Debt"),
    ("income_tax_expense", "*", "IncomeTaxExpenseBenefit", "Income Tax Expense (Benefit)"),
    ("income_tax_expense", "*", "IncomeTaxesPaid", "Income Taxes Paid"),
    ("share_based_compensation", "*", "ShareBasedCompensation", "Stock-Based Compensation"),
    ("provision_for_credit_losses", "*", "ProvisionForLoanLeaseAndOtherLosses", "Provision for Loan & Lease Losses"),
    ("provision_for_credit_losses", "*", "ProvisionForCreditLosses", "Provision for Credit Losses"),
    ("depreciation_amortization", "*", "DepreciationDepletionAndAmortization", "D&A"),
    ("depreciation_amortization", "*", "DepreciationAndAmortization", "D&A (alt)"),
    ("depreciation_amortization", "*", "DepreciationAmortizationAndAccretionNet", "D&A incl. Accretion"),
    ("depreciation_amortization", "*", "Depreciation", "Depreciation"),
    ("depreciation_amortization", "*", "AmortizationOfIntangibleAssets", "Amortization of Intangibles"),
    ("total_assets", "*", "Assets", "Total Assets"),
    ("total_assets", "*", "TotalAssets", "Total Assets (alt tag)"),
    ("current_assets", "*", "AssetsCurrent", "Current Assets"),
    ("current_assets", "*", "CurrentAssets", "IFRS Current Assets"),
    ("total_liabilities", "*", "Liabilities", "Total Liabilities"),
    ("total_liabilities", "*", "TotalLiabilities", "Total Liabilities (alt tag)"),
    ("current_liabilities", "*", "LiabilitiesCurrent", "Current Liabilities"),
    ("current_liabilities", "*", "CurrentLiabilities", "IFRS Current Liabilities"),
    ("stockholders_equity", "*", "StockholdersEquity", "Stockholders' Equity"),
    ("stockholders_equity", "*", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "Total Equity (incl. NCI)"),
    ("stockholders_equity", "*", "EquityAttributableToOwnersOfParent", "IFRS Equity Attributable to Parent"),
    ("total_equity", "*", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "Total Equity (incl. NCI)"),
    ("total_equity", "*", "Equity", "Equity"),
    ("total_equity", "*", "StockholdersEquity", "Stockholders' Equity"),
    ("minority_interest", "*", "MinorityInterest", "Noncontrolling Interest"),
    ("minority_interest", "*", "NoncontrollingInterests", "IFRS Noncontrolling Interests"),
    ("long_term_debt", "*", "LongTermDebt", "Long-Term Debt"),
    ("long_term_debt", "*", "LongTermDebtNoncurrent", "Long-Term Debt (Noncurrent)"),
    ("long_term_debt", "*", "LongTermDebtAndCapitalLeaseObligations", "Long-Term Debt & Capital Lease"),
    ("long_term_debt", "*", "LongTermDebtAndCapitalLeaseObligationsIncludingCurrentMaturities", "Long-Term Debt & Capital Lease (incl. Current Maturities)"),
    ("long_term_debt", "*", "LongTermNotesPayable", "Notes Payable (Noncurrent)"),
    ("long_term_debt", "*", "DebtAndCapitalLeaseObligations", "Debt & Capital Lease Obligations (Total)"),
    ("long_term_debt", "*", "NoncurrentPortionOfNoncurrentBorrowings", "IFRS Long-Term Borrowings"),
    ("long_term_debt", "*", "LongTermBorrowings", "IFRS Long-Term Borrowings (alt)"),
    ("long_term_debt", "*", "NotesPayable", "Notes Payable", True),
    ("long_term_debt", "*", "LoansPayable", "Loans Payable (Term Loans)", True),
    ("long_term_debt", "*", "SecuredDebt", "Secured Debt (Mortgages Payable)", True),
    ("short_term_debt", "*", "ShortTermBorrowings", "Short-Term Borrowings"),
    ("short_term_debt", "*", "DebtCurrent", "Current Debt"),
    ("short_term_debt", "*", "CommercialPaper", "Commercial Paper"),
    ("short_term_debt", "*", "CurrentPortionOfNoncurrentBorrowings", "IFRS Current Borrowings"),
    ("short_term_debt", "*", "CurrentBorrowings", "IFRS Current Borrowings (alt)"),
    ("cash_and_equivalents", "*", "CashAndCashEquivalentsAtCarryingValue", "Cash and Cash Equivalents"),
    ("cash_and_equivalents", "*", "CashCashEquivalentsAndShortTermInvestments", "Cash, Equivalents & Short-Term Investments"),
    ("cash_and_equivalents", "*", "Cash", "Cash"),
    ("cash_and_equivalents", "*", "CashAndCashEquivalents", "IFRS Cash and Equivalents"),
    ("accounts_receivable", "*", "AccountsReceivableNetCurrent", "Accounts Receivable, Net (Current)"),
    ("inventory", "*", "InventoryNet", "Inventory, Net"),
    ("goodwill", "*", "Goodwill", "Goodwill"),
    ("intangible_assets", "*", "IntangibleAssetsNetExcludingGoodwill", "Intangible Assets, Net (excl. Goodwill)"),
    ("property_plant_equipment", "*", "PropertyPlantAndEquipmentNet", "PP&E, Net"),
    ("accounts_payable", "*", "AccountsPayableCurrent", "Accounts Payable (Current)"),
    ("accrued_liabilities", "*", "AccruedLiabilitiesCurrent", "Accrued Liabilities (Current)"),
    ("deferred_revenue", "*", "DeferredRevenueCurrent", "Deferred Revenue (Current)"),
    ("deferred_revenue", "*", "ContractWithCustomerLiabilityCurrent", "Contract Liability (Current)"),
    ("retained_earnings", "*", "RetainedEarningsAccumulatedDeficit", "Retained Earnings (Accumulated Deficit)"),
    ("accumulated_other_comprehensive_income", "*", "AccumulatedOtherComprehensiveIncomeLossNetOfTax", "AOCI, Net of Tax"),
    ("operating_cash_flow", "*", "NetCashProvidedByUsedInOperatingActivities", "Operating Cash Flow"),
    ("operating_cash_flow", "*", "CashFlowsFromUsedInOperatingActivities", "Cash Flows from Operations"),
    ("capital_expenditures", "*", "PaymentsToAcquirePropertyPlantAndEquipment", "Capital Expenditures"),
    ("capital_expenditures", "*", "AdditionsToPropertyPlantAndEquipment", "Capital Expenditures (alt)"),
    ("capital_expenditures", "*", "CapitalExpenditures", "Capital Expenditures (generic)"),
    ("capital_expenditures", "*", "PaymentsToAcquireProductiveAssets", "Payments to Acquire Assets"),
    ("capital_expenditures", "*", "PaymentsToAcquireOtherPropertyPlantAndEquipment", "Capital Expenditures (other PP&E)"),
    ("capital_expenditures", "*", "PaymentsForCapitalImprovements", "Capital Improvements"),
    ("capital_expenditures", "*", "PaymentsToAcquireRealEstate", "Real Estate Acquisitions (REIT capex)"),
    ("capital_expenditures", "*", "PaymentsToAcquireAndDevelopRealEstate", "Real Estate Acquisition & Development (REIT capex)"),
    ("capital_expenditures", "*", "PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities", "IFRS CapEx"),
    ("investing_cash_flow", "*", "NetCashProvidedByUsedInInvestingActivities", "Investing Cash Flow"),
    ("financing_cash_flow", "*", "NetCashProvidedByUsedInFinancingActivities", "Financing Cash Flow"),
    ("dividends_paid", "*", "PaymentsOfDividends", "Dividends Paid"),
    ("shares_repurchased", "*", "PaymentsForRepurchaseOfCommonStock", "Share Repurchases"),
    ("sbc_cash_flow", "*", "ShareBasedCompensation", "Stock-Based Compensation (CF add-back)"),
    ("acquisitions", "*", "PaymentsToAcquireBusinessesNetOfCashAcquired", "Acquisitions, Net of Cash"),
    ("proceeds_from_debt", "*", "ProceedsFromIssuanceOfLongTermDebt", "Proceeds from Long-Term Debt Issuance"),
    ("repayment_of_debt", "*", "RepaymentsOfLongTermDebt", "Repayment of Long-Term Debt"),
    ("free_cash_flow_components", "*", "NetCashProvidedByUsedInOperatingActivities", "Operating Cash Flow"),
    ("eps_basic", "*", "EarningsPerShareBasic", "EPS (Basic)"),
    ("eps_diluted", "*", "EarningsPerShareDiluted", "EPS (Diluted)"),
    ("shares_outstanding", "*", "CommonStockSharesOutstanding", "Common Shares Outstanding"),
    ("shares_outstanding", "*", "WeightedAverageNumberOfShareOutstandingBasicAndDiluted", "Weighted Avg Shares"),
    ("shares_outstanding", "*", "EntityCommonStockSharesOutstanding", "Entity Common Shares Outstanding"),
    ("book_value_per_share", "*", "BookValuePerShareOfCommonStock", "Book Value Per Share"),
    ("reit_ffo", "*", "FundsFromOperations", "Funds From Operations"),
    ("reit_noi", "*", "NetOperatingIncome", "Net Operating Income"),
    ("reit_occupancy", "*", "OccupancyRate", "Occupancy Rate"),
    ("insurance_losses", "*", "PolicyholderBenefitsAndClaimsIncurredNet", "Net Policyholder Benefits & Claims"),
    ("insurance_combined_ratio", "*", "CombinedRatio", "Combined Ratio"),
    ("insurance_underwriting", "*", "UnderwritingIncomeLoss", "Underwriting Income (Loss)"),
    ("bank_charge_offs", "*", "ChargeOffsNet", "Net Charge-Offs"),
    ("bank_efficiency", "*", "EfficiencyRatio", "Efficiency Ratio"),
    ("bank_capital_ratios", "*", "Tier1CapitalRatio", "Tier 1 Capital Ratio"),
    ("bank_net_interest_margin", "*", "NetInterestMargin", "Net Interest Margin"),
    ("bank_deposits", "*", "Deposits", "Total Deposits"),
    ("bank_loans", "*", "LoansAndLeasesReceivableNetOfDeferredIncome", "Net Loans & Leases"),
    ("fintech_transaction_volume", "*", "PaymentVolume", "Payment Volume"),
    ("fintech_processing", "*", "TransactionAndProcessingFees", "Transaction & Processing Fees"),
    ("fintech_take_rate", "*", "TakeRate", "Take Rate"),
    ("saas_deferred_revenue", "*", "DeferredRevenueCurrent", "Deferred Revenue (Current)"),
    ("saas_rpo", "*", "RemainingPerformanceObligation", "Remaining Performance Obligation"),
    ("saas_subscription_revenue", "*", "SubscriptionRevenue", "Subscription Revenue"),
    ("saas_cost_of_subscription", "*", "CostOfSubscriptionRevenue", "Cost of Subscription Revenue"),
    ("healthcare_drug_revenue", "*", "ProductRevenue", "Product Revenue"),
    ("healthcare_rd_pipeline", "*", "ResearchAndDevelopmentExpense", "R&D Expense"),
    ("healthcare_milestone_payments", "*", "MilestonePaymentsReceived", "Milestone Payments Received"),
    ("energy_production_revenue", "*", "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenue from Contract with Customer"),
    ("energy_proved_reserves", "*", "ProvedDevelopedReservesOil", "Proved Developed Reserves (Oil)"),
    ("energy_realized_price", "*", "AverageRealizedPricePerBarrelOfOil", "Avg Realized Price (Oil)"),
    ("energy_exploration", "*", "ExplorationExpense", "Exploration Expense"),
    ("retail_same_store", "*", "SameStoreSales", "Same-Store Sales"),
    ("retail_store_count", "*", "NumberOfStores", "Number of Stores"),
    ("retail_ecommerce", "*", "DigitalRevenue", "Digital Revenue"),
)

# Bank revenue drivers, first reported tag wins.
_BANK_DRIVERS = (
    ("net_interest_income", "InterestIncomeExpenseNet", "Net Interest Income"),
    ("net_interest_income", "NetInterestIncome", "Net Interest Income (alt)"),
    ("net_interest_income", "InterestIncomeExpenseAfterProvisionForLoanLoss", "Net Interest Income After Provision"),
    ("noninterest_income", "NoninterestIncome", "Noninterest Income"),
    ("noninterest_income", "NonInterestIncome", "Noninterest Income (alt)"),
    ("investment_banking", "InvestmentBankingRevenue", "Investment Banking"),
    ("investment_banking", "InvestmentBankingAdvisoryBrokerageAndUnderwritingFeesAndCommissions", "Investment Banking & Advisory"),
    ("trading_principal", "PrincipalTransactionsRevenue", "Trading & Principal Transactions"),
    ("trading_principal", "TradingGainsLosses", "Trading Revenue"),
    ("trading_principal", "DebtSecuritiesTradingGainLoss", "Trading Revenue (debt securities)"),
    ("brokerage_commissions", "BrokerageCommissionsRevenue", "Brokerage & Commissions"),
    ("brokerage_commissions", "CommissionsAndFees", "Commissions & Fees"),
    ("asset_wealth_management", "AssetManagementFees1", "Asset & Wealth Management"),
    ("asset_wealth_management", "AssetManagementFees", "Asset Management Fees"),
    ("asset_wealth_management", "InvestmentManagementFees", "Investment Management Fees"),
    ("asset_wealth_management", "WealthManagementRevenue", "Wealth Management"),
    ("card_income", "FeesAndCommissionsCreditAndDebitCards", "Card & Interchange"),
    ("card_income", "CreditCardIncome", "Credit Card Income"),
    ("deposit_service_charges", "FeesAndCommissionsDepositorAccounts", "Deposit Service Charges"),
    ("fiduciary_trust", "FeesAndCommissionsFiduciaryAndTrustActivities", "Fiduciary & Trust"),
    ("mortgage_banking", "FeesAndCommissionsMortgageBankingAndServicing", "Mortgage Banking"),
    ("mortgage_banking", "FeesAndCommissionsMortgageBanking", "Mortgage Banking (alt)"),
)

# Metrics measured at an instant, exempt from duration filters.
BALANCE_METRICS = (
    "total_assets", "current_assets", "total_liabilities", "current_liabilities", "stockholders_equity",
    "total_equity", "minority_interest", "long_term_debt", "short_term_debt", "cash_and_equivalents",
    "accounts_receivable", "inventory", "goodwill", "intangible_assets", "property_plant_equipment",
    "accounts_payable", "accrued_liabilities", "deferred_revenue", "retained_earnings",
    "accumulated_other_comprehensive_income", "shares_outstanding", "bank_deposits", "bank_loans",
)

# Flow metrics that year-to-date arithmetic applies to.
FLOW_METRICS = (
    "revenue", "cost_of_revenue", "gross_profit", "operating_income", "operating_expenses", "sga_expense",
    "rd_expense", "interest_expense", "income_tax_expense", "depreciation_amortization",
    "provision_for_credit_losses", "other_income_expense", "income_before_tax", "share_based_compensation",
    "net_income", "ebitda", "operating_cash_flow", "investing_cash_flow", "financing_cash_flow",
    "capital_expenditures", "dividends_paid", "shares_repurchased", "sbc_cash_flow", "acquisitions",
    "proceeds_from_debt", "repayment_of_debt", "free_cash_flow",
)

# Words that mark a forecast rather than a reported figure.
FORECAST_WORDS = (
    "Guidance", "Forecast", "Estimated", "Expected", "Projected", "Budget", "Plan", "Target", "Outlook",
)

# Endings and infixes of custom revenue tags.
CUSTOM_NET_REVENUE = "(?i)(NetRevenue|TotalNetRevenue|_NetRevenues$)"
CUSTOM_REVENUE = "(?i)(_Revenues$|_Revenue$|_TotalRevenue$|_TotalRevenues$)"


def default_rules() -> list[ConceptRule]:
    seen: dict[tuple[str, str], int] = {}
    out = []
    for metric, industry, tag, display, *flag in _RULES:
        n = seen[(metric, industry)] = seen.get((metric, industry), 0) + 1
        # Industry rows extend the general list of the same metric.
        base = 100 if industry != "*" and metric != "revenue" else 0
        out.append(ConceptRule(metric, industry, base + n, tag, display, bool(flag)))
    return out


def load_rules(path: str) -> list[ConceptRule]:
    """Rules from a CSV with the columns of :class:`ConceptRule`."""
    with open(path, newline="", encoding="utf-8") as fh:
        return [
            ConceptRule(
                r["metric"], r["industry"] or "*", int(r["priority"]), r["tag"], r["display"],
                r.get("aggregate", "").lower() in ("1", "true"),
                r.get("fuzzy", "").lower() in ("1", "true"),
            )
            for r in csv.DictReader(fh)
        ]


def bank_driver_rules() -> list[ConceptRule]:
    seen: dict[str, int] = {}
    out = []
    for driver, tag, display in _BANK_DRIVERS:
        n = seen[driver] = seen.get(driver, 0) + 1
        out.append(ConceptRule(driver, "*", n, tag, display))
    return out


BANK_SUBDRIVERS = [
    d for d in dict.fromkeys(r.metric for r in bank_driver_rules())
    if d not in ("net_interest_income", "noninterest_income")
]
