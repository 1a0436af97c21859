"""Typed schemas of the snapshot tables and the fixed column lists the
fundamentals screens read."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, DT, B = T.StringType(), T.DoubleType(), T.LongType(), T.DateType(), T.BooleanType()


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


HOLDERS = _schema(("date_reported", DT), ("holder", S), ("pctheld", D), ("shares", L), ("value", L),
                  ("type", S), ("symbol", S), ("date_insert", DT))

INSIDER_ROSTER = _schema(("name", S), ("position", S), ("url", S), ("most_recent_transaction", S),
                         ("latest_transaction_date", DT), ("shares_owned_directly", D),
                         ("position_direct_date", DT), ("shares_owned_indirectly", D),
                         ("symbol", S), ("date_insert", DT))

METADATA = _schema(("currency", S), ("symbol", S), ("exchangename", S), ("fullexchangename", S),
                   ("instrumenttype", S), ("firsttradedate", L), ("regularmarkettime", L),
                   ("hasprepostmarketdata", B), ("gmtoffset", L), ("timezone", S),
                   ("exchangetimezonename", S), ("regularmarketprice", D), ("fiftytwoweekhigh", D),
                   ("fiftytwoweeklow", D), ("regularmarketdayhigh", D), ("regularmarketdaylow", D),
                   ("regularmarketvolume", L), ("longname", S), ("shortname", S), ("chartpreviousclose", D),
                   ("previousclose", D), ("scale", L), ("pricehint", L), ("website", S), ("industry", S),
                   ("sector", S), ("fulltimeemployees", L), ("auditrisk", L), ("boardrisk", L),
                   ("compensationrisk", L), ("shareholderrightsrisk", L), ("overallrisk", L),
                   ("irwebsite", S), ("date_insert", DT))

HISTORY = _schema(("date", DT), ("open", D), ("high", D), ("low", D), ("close", D), ("volume", L),
                  ("dividends", D), ("stock_splits", D), ("symbol", S), ("capital_gains", D),
                  ("date_insert", DT))

STATEMENT_LONG = _schema(("symbol", S), ("statement", S), ("freq", S), ("date", DT),
                         ("line_item", S), ("value", D), ("date_insert", DT))

# Fixed column lists read by the fundamentals screens (balance sheet,
# cash flow, income statement), in the order the screens return them.
BALANCE_SHEET_ITEMS = [
    "treasury_shares_number", "ordinary_shares_number", "share_issued", "net_debt", "total_debt",
    "long_term_debt", "current_debt", "interest_payable", "other_payable", "total_assets",
    "total_non_current_assets", "other_non_current_assets", "current_assets", "other_current_assets",
    "inventory", "finished_goods", "raw_materials", "receivables",
    "cash_cash_equivalents_and_short_term_investments", "loans_receivable", "tangible_book_value",
    "invested_capital", "working_capital", "net_tangible_assets", "common_stock_equity",
    "total_capitalization", "stockholders_equity", "retained_earnings",
    "total_equity_gross_minority_interest", "accumulated_depreciation", "other_properties",
    "goodwill_and_other_intangible_assets", "dividends_payable", "investments_and_advances",
    "long_term_equity_investment",
]
CASH_FLOW_ITEMS = [
    "free_cash_flow", "repurchase_of_capital_stock", "repayment_of_debt", "issuance_of_debt",
    "capital_expenditure", "cash_flow_from_continuing_financing_activities", "cash_dividends_paid",
    "net_common_stock_issuance", "common_stock_payments", "long_term_debt_payments",
    "long_term_debt_issuance", "investing_cash_flow", "operating_cash_flow",
    "cash_flow_from_continuing_operating_activities", "change_in_inventory", "change_in_receivables",
    "stock_based_compensation", "asset_impairment_charge", "depreciation_and_amortization",
    "operating_gains_losses", "issuance_of_capital_stock", "common_stock_issuance",
    "sale_of_investment", "depreciation", "amortization_cash_flow",
]
INCOME_ITEMS = [
    "ebitda", "ebit", "net_interest_income", "interest_expense", "total_expenses",
    "total_operating_income_as_reported", "diluted_average_shares", "basic_eps", "net_income",
    "net_income_continuous_operations", "tax_provision", "other_income_expense", "operating_income",
    "operating_expense", "gross_profit", "cost_of_revenue", "total_revenue", "operating_revenue",
    "special_income_charges", "restructuring_and_mergern_acquisition",
    "depreciation_amortization_depletion_income_statement", "interest_income", "write_off",
    "research_and_development", "amortization", "salaries_and_wages", "rent_expense_supplemental",
    "depreciation_income_statement", "rent_and_landing_fees",
]
STATEMENT_ITEMS = {"balance_sheet": BALANCE_SHEET_ITEMS, "cash_flow": CASH_FLOW_ITEMS,
                   "income_statement": INCOME_ITEMS}
