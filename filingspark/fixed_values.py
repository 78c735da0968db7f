"""Fixed values that results depend on: maps from taxonomy concepts to columns.

Each is CSV text as users edit it; `rows` reads one.
"""

from __future__ import annotations

import csv
import io

# Canonical column, taxonomy concept, priority, type.
CONCEPT_MAP = """\
canonical,concept,priority,cast_type
company_number,UKCompaniesHouseRegisteredNumber,1,VARCHAR
company_name,EntityCurrentLegalOrRegisteredName,1,VARCHAR
company_name,EntityCurrentLegalName,2,VARCHAR
company_dormant,EntityDormantTruefalse,1,BOOLEAN
company_dormant,EntityDormant,2,BOOLEAN
principal_activities,DescriptionPrincipalActivities,1,VARCHAR
report_title,ReportTitle,1,VARCHAR
balance_sheet_date,BalanceSheetDate,1,DATE
report_period_start,StartDateForPeriodCoveredByReport,1,DATE
report_period_end,EndDateForPeriodCoveredByReport,1,DATE
authorisation_date,DateAuthorisationFinancialStatementsForIssue,1,DATE
directors_report_date,DateSigningDirectorsReport,1,DATE
auditors_report_date,DateAuditorsReport,1,DATE
auditor_name,NameEntityAuditors,1,VARCHAR
senior_statutory_auditor,NameSeniorStatutoryAuditor,1,VARCHAR
auditors_opinion,OpinionAuditorsOnEntity,1,VARCHAR
production_software,NameProductionSoftware,1,VARCHAR
production_software_version,VersionProductionSoftware,1,VARCHAR
going_concern,FinancialStatementsArePreparedOnGoing-concernBasisTruefalse,1,BOOLEAN
audit_exemption_s477,StatementThatCompanyEntitledToExemptionFromAuditUnderSection477CompaniesAct2006RelatingToSmallCompanies,1,BOOLEAN
small_companies_regime,StatementThatAccountsHaveBeenPreparedInAccordanceWithProvisionsSmallCompaniesRegime,1,BOOLEAN
employees,AverageNumberEmployeesDuringPeriod,1,INTEGER
employees,EmployeesTotal,2,INTEGER
turnover,TurnoverRevenue,1,DECIMAL
turnover,TurnoverGrossOperatingRevenue,2,DECIMAL
cost_of_sales,CostSales,1,DECIMAL
gross_profit,GrossProfitLoss,1,DECIMAL
other_operating_income,OtherOperatingIncome,1,DECIMAL
other_operating_income,OtherOperatingIncomeFormat1,2,DECIMAL
other_operating_income,OtherOperatingIncomeFormat2,3,DECIMAL
administrative_expenses,AdministrativeExpenses,1,DECIMAL
staff_costs,StaffCostsEmployeeBenefitsExpense,1,DECIMAL
staff_costs,StaffCosts,2,DECIMAL
wages_salaries,WagesSalaries,1,DECIMAL
social_security_costs,SocialSecurityCosts,1,DECIMAL
pension_costs,PensionOtherPost-employmentBenefitCostsOtherPensionCosts,1,DECIMAL
director_remuneration,DirectorRemuneration,1,DECIMAL
raw_materials,RawMaterialsConsumables,1,DECIMAL
raw_materials,RawMaterialsConsumablesUsed,2,DECIMAL
depreciation,DepreciationOtherAmountsWrittenOffTangibleIntangibleFixedAssets,1,DECIMAL
depreciation,DepreciationAmortisationImpairmentExpense,2,DECIMAL
other_operating_charges,OtherOperatingChargesFormat2,1,DECIMAL
other_operating_charges,OtherOperatingExpensesFormat2,2,DECIMAL
operating_profit,OperatingProfitLoss,1,DECIMAL
finance_income,OtherInterestReceivableSimilarIncomeFinanceIncome,1,DECIMAL
finance_costs,InterestPayableSimilarChargesFinanceCosts,1,DECIMAL
profit_before_tax,ProfitLossOnOrdinaryActivitiesBeforeTax,1,DECIMAL
profit_before_tax,ProfitLoss,2,DECIMAL
tax,TaxTaxCreditOnProfitOrLossOnOrdinaryActivities,1,DECIMAL
tax,TaxOnProfitOrLossOnOrdinaryActivities,2,DECIMAL
current_tax,CurrentTaxForPeriod,1,DECIMAL
current_tax,TotalCurrentTaxExpenseCredit,2,DECIMAL
tax_at_applicable_rate,TaxExpenseCreditApplicableTaxRate,1,DECIMAL
applicable_tax_rate,ApplicableTaxRate,1,DECIMAL
profit_for_period,ProfitLossForPeriod,1,DECIMAL
profit_for_period,ProfitLoss,3,DECIMAL
comprehensive_income,ComprehensiveIncomeExpense,1,DECIMAL
dividends_paid,DividendsPaid,1,DECIMAL
audit_fees,AuditFeesExpenses,1,DECIMAL
fixed_assets,FixedAssets,1,DECIMAL
fixed_assets,TangibleFixedAssets,2,DECIMAL
intangible_assets,IntangibleAssets,1,DECIMAL
ppe,PropertyPlantEquipment,1,DECIMAL
ppe_cost,PropertyPlantEquipmentGrossCost,1,DECIMAL
ppe_accumulated_depreciation,AccumulatedDepreciationImpairmentPropertyPlantEquipment,1,DECIMAL
ppe_additions,AdditionsOtherThanThroughBusinessCombinationsPropertyPlantEquipment,1,DECIMAL
ppe_depreciation_charge,IncreaseFromDepreciationChargeForYearPropertyPlantEquipment,1,DECIMAL
investments,InvestmentsFixedAssets,1,DECIMAL
investments_group,InvestmentsInGroupUndertakings,1,DECIMAL
current_assets,CurrentAssets,1,DECIMAL
stocks,StocksInventory,1,DECIMAL
stocks,TotalInventories,2,DECIMAL
debtors,Debtors,1,DECIMAL
cash,CashBankOnHand,1,DECIMAL
cash,CashBankInHand,2,DECIMAL
cash_equivalents,CashCashEquivalents,1,DECIMAL
cash_equivalents,CashCashEquivalentsCashFlowValue,2,DECIMAL
creditors_within_one_year,CreditorsDueWithinOneYear,1,DECIMAL
creditors_within_one_year,Creditors,2,DECIMAL
creditors_after_one_year,CreditorsDueAfterOneYear,1,DECIMAL
accrued_liabilities,AccruedLiabilitiesNotExpressedWithinCreditorsSubtotal,1,DECIMAL
provisions,ProvisionsForLiabilitiesBalanceSheetSubtotal,1,DECIMAL
deferred_tax,NetDeferredTaxLiabilityAsset,1,DECIMAL
deferred_tax,TaxationIncludingDeferredTaxationBalanceSheetSubtotal,2,DECIMAL
net_current_assets,NetCurrentAssetsLiabilities,1,DECIMAL
total_assets_less_current_liabilities,TotalAssetsLessCurrentLiabilities,1,DECIMAL
net_assets,NetAssetsLiabilities,1,DECIMAL
net_assets,NetAssetsLiabilitiesIncludingPensionAssetLiability,2,DECIMAL
equity,Equity,1,DECIMAL
equity,ShareholderFunds,2,DECIMAL
called_up_share_capital,CalledUpShareCapital,1,DECIMAL
retained_earnings,ProfitLossAccountReserve,1,DECIMAL
operating_lease_commitments,FutureMinimumLeasePaymentsUnderNon-cancellableOperatingLeases,1,DECIMAL
gain_loss_disposal_ppe,GainLossOnDisposalsPropertyPlantEquipment,1,DECIMAL
net_cash_from_operations,NetCashGeneratedFromOperations,1,DECIMAL
"""

# Column of the comparison's wide row, taxonomy concept, priority, grain, transform.
COLUMN_MAP = """\
column_name,concept,priority,grain,transform
balance_sheet_date,BalanceSheetDate,0,general,identity
companies_house_registered_number,UKCompaniesHouseRegisteredNumber,0,general,str
companies_house_registered_number,CompaniesHouseRegisteredNumber,1,general,str
entity_current_legal_name,EntityCurrentLegalOrRegisteredName,0,general,str
entity_current_legal_name,EntityCurrentLegalName,1,general,str
company_dormant,EntityDormantTruefalse,0,general,bool
company_dormant,EntityDormant,1,general,bool
company_dormant,CompanyDormant,2,general,bool
company_dormant,CompanyNotDormant,3,general,not_bool
average_number_employees_during_period,AverageNumberEmployeesDuringPeriod,0,periodical,abs
average_number_employees_during_period,EmployeesTotal,1,periodical,abs
tangible_fixed_assets,FixedAssets,0,periodical,decimal
tangible_fixed_assets,TangibleFixedAssets,1,periodical,decimal
tangible_fixed_assets,PropertyPlantEquipment,2,periodical,decimal
debtors,Debtors,0,periodical,decimal
cash_bank_in_hand,CashBankInHand,0,periodical,decimal
cash_bank_in_hand,CashBankOnHand,1,periodical,decimal
current_assets,CurrentAssets,0,periodical,decimal
creditors_due_within_one_year,CreditorsDueWithinOneYear,0,periodical,decimal
creditors_due_after_one_year,CreditorsDueAfterOneYear,0,periodical,decimal
net_current_assets_liabilities,NetCurrentAssetsLiabilities,0,periodical,decimal
total_assets_less_current_liabilities,TotalAssetsLessCurrentLiabilities,0,periodical,decimal
net_assets_liabilities_including_pension_asset_liability,NetAssetsLiabilitiesIncludingPensionAssetLiability,0,periodical,decimal
net_assets_liabilities_including_pension_asset_liability,NetAssetsLiabilities,1,periodical,decimal
called_up_share_capital,CalledUpShareCapital,0,periodical,decimal
profit_loss_account_reserve,ProfitLossAccountReserve,0,periodical,decimal
shareholder_funds,ShareholderFunds,0,periodical,decimal
turnover_gross_operating_revenue,TurnoverGrossOperatingRevenue,0,periodical,decimal
turnover_gross_operating_revenue,TurnoverRevenue,1,periodical,decimal
other_operating_income,OtherOperatingIncome,0,periodical,decimal
other_operating_income,OtherOperatingIncomeFormat2,1,periodical,decimal
cost_sales,CostSales,0,periodical,decimal
gross_profit_loss,GrossProfitLoss,0,periodical,decimal
administrative_expenses,AdministrativeExpenses,0,periodical,decimal
raw_materials_consumables,RawMaterialsConsumables,0,periodical,decimal
raw_materials_consumables,RawMaterialsConsumablesUsed,1,periodical,decimal
staff_costs,StaffCosts,0,periodical,decimal
staff_costs,StaffCostsEmployeeBenefitsExpense,1,periodical,decimal
depreciation_other_amounts_written_off_tangible_intangible_fixed_assets,DepreciationOtherAmountsWrittenOffTangibleIntangibleFixedAssets,0,periodical,decimal
depreciation_other_amounts_written_off_tangible_intangible_fixed_assets,DepreciationAmortisationImpairmentExpense,1,periodical,decimal
other_operating_charges_format2,OtherOperatingChargesFormat2,0,periodical,decimal
other_operating_charges_format2,OtherOperatingExpensesFormat2,1,periodical,decimal
operating_profit_loss,OperatingProfitLoss,0,periodical,decimal
profit_loss_on_ordinary_activities_before_tax,ProfitLossOnOrdinaryActivitiesBeforeTax,0,periodical,decimal
tax_on_profit_or_loss_on_ordinary_activities,TaxOnProfitOrLossOnOrdinaryActivities,0,periodical,decimal
tax_on_profit_or_loss_on_ordinary_activities,TaxTaxCreditOnProfitOrLossOnOrdinaryActivities,1,periodical,decimal
profit_loss_for_period,ProfitLoss,0,periodical,decimal
profit_loss_for_period,ProfitLossForPeriod,1,periodical,decimal
"""

# How each column of the wide row counts in the comparison.
COMPARE_SPEC = """\
column_name,kind
run_code,skip
date,skip
file_type,skip
taxonomy,skip
error,skip
zip_url,skip
average_number_employees_during_period,skip
creditors_due_within_one_year,skip
creditors_due_after_one_year,skip
company_id,must
balance_sheet_date,must
companies_house_registered_number,must
entity_current_legal_name,must
company_dormant,must
tangible_fixed_assets,observe
debtors,observe
cash_bank_in_hand,observe
current_assets,observe
net_current_assets_liabilities,observe
total_assets_less_current_liabilities,observe
net_assets_liabilities_including_pension_asset_liability,observe
called_up_share_capital,observe
profit_loss_account_reserve,observe
shareholder_funds,observe
turnover_gross_operating_revenue,observe
other_operating_income,observe
cost_sales,observe
gross_profit_loss,observe
administrative_expenses,observe
raw_materials_consumables,observe
staff_costs,observe
depreciation_other_amounts_written_off_tangible_intangible_fixed_assets,observe
other_operating_charges_format2,observe
operating_profit_loss,observe
profit_loss_on_ordinary_activities_before_tax,observe
tax_on_profit_or_loss_on_ordinary_activities,observe
profit_loss_for_period,observe
"""

# Columns whose type the wide table narrows beyond the map's.
WIDE_TYPES = {"applicable_tax_rate": "decimal(20,6)"}


def rows(text: str) -> list[dict[str, str]]:
    return list(csv.DictReader(io.StringIO(text)))


def canonicals() -> dict[str, str]:
    """Pivoted columns in order, with their types. The registered number is a fact, not the key,
    and stays out."""
    names = {"VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "INTEGER": "int", "DECIMAL": "decimal(20,2)"}
    found = {r["canonical"]: names[r["cast_type"]] for r in rows(CONCEPT_MAP) if r["canonical"] != "company_number"}
    return found | WIDE_TYPES
