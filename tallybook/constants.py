"""Names, labels and limits that give the reports their meaning.

Ids of customers, accounts, investigations and events are never listed here;
they are parameters of the report functions.
"""

import datetime
from decimal import Decimal

# Transaction categories left out of the cash chain and of event balances.
NON_EVENT_CATEGORIES = ("Balance Transfer", "Internal Transfer", "Invoices")

# Transaction categories of transfers between own accounts.
TRANSFER_CATEGORIES = ("Balance Transfer", "Internal Transfer")

# Account name patterns of accounts that do not hold operating cash.
NON_OPERATING_PATTERNS = ("%corporate%", "%health_insurance%", "%flex_pay%")

# Short forms of the same patterns, used by the monthly movement report.
NON_OPERATING_SHORT_PATTERNS = ("%flex%", "%corp%", "%health%")

# Account name patterns left out of the customer-cash invoice report.
NON_CUSTOMER_CASH_PATTERNS = ("%corporate%", "SVB%")

# Transmission types of the two sides of an internal transfer.
ORIGINATION_TRANSMISSION = "NachaEntry"
DESTINATION_TRANSMISSION = "ElectronicEntry"

# Record types that a reconciliation row may point to.
POLYMORPHIC_RECORD_TYPES = ("NachaBatch", "NachaEntryReturn", "CheckPayment", "CheckPaymentReturn")

# Investigation statuses that take an event out of the receivable report.
EXCLUDED_STATUSES = (
    "recovered",
    "awaiting_bad_debt_funds",
    "awaiting_external_dependency",
    "awaiting_bad_debt_approval",
    "false_positive",
)

# Status mappings.
MAPPING_RECOVERED = "RecoveryReceivable_SuccessfullyRecoveredAfterPeriodEnd"
MAPPING_OVER_90 = "RecoveryReceivable_>90d"
MAPPING_UNDER_90 = "RecoveryReceivable_<90d"
MAPPING_FALSE_POSITIVE = "NotRecovery_FalsePositive"
MAPPING_WRITTEN_OFF = "NotRecovery_writtenoff_pendingcorptransfer"

MICRO_VARIANCE = "micro variance"

# Ageing buckets in days: first day, last day (None is open), label.
AGING_BUCKETS = (
    (None, 30, "0 - 30 days"),
    (31, 60, "31 - 60 days"),
    (61, 90, "61 - 90 days"),
    (91, 120, "91 - 120 days"),
    (121, 180, "121 - 180 days"),
    (180, None, "> 180 days"),
)
BUCKET_OVER_180 = "> 180 days"
RESERVE_AGE_DAYS = 90

# Write-off reasons counted as fraud.
FRAUD_WRITEOFF_REASONS = ("Fraud loss", "ATO concession")

# Two-digit fiscal year texts are compared as text.
FISCAL_YEAR_FLOOR = "FY25"
BAD_DEBT_OPEN_STATUS = "pending"

BALANCE_TOLERANCE = Decimal("0.01")
DATE_FLOOR = datetime.date(2020, 1, 1)
PAYROLL_START = datetime.date(2018, 5, 1)
SPREADSHEET_EPOCH = datetime.date(1899, 12, 30)
TRANSFER_LOOKBACK_DAYS = 2

# Pay schedule labels by code.
PAY_PERIOD_LABELS = {
    1: "Every week",
    2: "Every other week",
    3: "Twice per month",
    4: "Monthly",
    5: "Quarterly",
    6: "Annually",
}

# Monthly movement: transfers of one account that are reported in a branch of their own.
MOVEMENT_TRANSFER_TYPES = ("Credit balance transfer", "Debit balance transfer")
MOVEMENT_TRANSFER_LIMIT = 20_000_000

# Admin profile: feature keys of time tracking, device names and login actions.
TIME_TRACKING_FEATURES = (2, 17)
MOBILE_DEVICES = ("Mobile", "Tablet")
LOGIN_PAGE_ACTIONS = ("VisitedLoginPage", "LoginClicked")

# Text read as missing by the CSV loader.
CSV_MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
