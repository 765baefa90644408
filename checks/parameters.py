"""Parameter values used by the cases. All ids are synthetic."""

import datetime

from checks.fixtures import PERIODS
from tallybook.params import Period, parse_date
from tallybook.plans.netting import NettingMonth

LAG_2, LAG_1, CURRENT = (Period(parse_date(end), parse_date(snap)) for end, snap in PERIODS)
MONTH_1 = NettingMonth(LAG_2.end, LAG_2)
MONTH_2 = NettingMonth(LAG_1.end, LAG_1)

EXCLUDED_COMPANIES = (2, 7, 31)
EXCLUDED_INVESTIGATIONS = (11, 21, 37)
OWN_COMPANY = 7
EXCLUDED_ACCOUNTS = (29,)
SPLIT_ACCOUNT = "PNC operations"
REFERRERS = ("https://books.example.test/", "https://ledger.example.test/")

# Account labels of the three bank breakdowns, and labels that replace "bank purpose" in the cheque report.
FIRST_BANK = {3: "First main", 4: "First company", 6: "First incoming", 7: "First recovery", 8: "First flexible", 9: "First wires", 12: "First repaid"}
SECOND_BANK = {16: "Second main", 17: "Second company", 18: "Second wires"}
THIRD_BANK = {1: "Third main", 2: "Third company", 5: "Third health", 10: "Third wires"}
CHECK_ACCOUNTS = {19: "Former main account", 20: "Former company account", 26: "Present main account", 27: "Present company account"}

YEAR_START = datetime.date(2022, 7, 1)
YEAR_END = datetime.date(2023, 6, 30)
AS_OF = datetime.datetime(2024, 11, 15)
PROFILE_MONTHS = tuple(datetime.date(2024, m, 1) for m in (9, 10, 11))
GO_LIVE = datetime.date(2023, 8, 1)

PARTNER_REASON = "Partner invoice"
PARTNER_LABEL = "Partner - Credit Invoiced"


def pairs_sql(labels: dict[int, str]) -> str:
    """Rows of a SQL VALUES list."""
    return ", ".join(f"({key}, '{label}')" for key, label in labels.items())
