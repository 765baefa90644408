"""Sign rules and amount conversions."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.dates import parsed_or_error

MONEY = "decimal(18,2)"
TOTAL = "decimal(28,2)"


def signed_amount(direction: Column, amount: Column) -> Column:
    """Direction 0 is positive, 1 negative, anything else counts as zero."""
    return F.when(direction == 0, amount).when(direction == 1, -amount).otherwise(F.lit(0))


def signed_amount_else_negative(direction: Column, amount: Column) -> Column:
    """Direction 0 is positive; every other direction, also a missing one, is negative."""
    return F.when(direction == 0, amount).otherwise(-amount)


def signed_amount_else_null(direction: Column, amount: Column) -> Column:
    """Direction 0 is positive, 1 negative, anything else is unknown."""
    return F.when(direction == 0, amount).when(direction == 1, -amount)


def bank_signed_amount(transaction_type: Column, cents: Column) -> Column:
    """Bank view in dollars: type 4 brings money in, type 2 takes it out."""
    inflow = F.when(transaction_type == 4, cents).otherwise(F.lit(0))
    outflow = F.when(transaction_type == 2, cents).otherwise(F.lit(0))
    return ((inflow - outflow).cast("decimal(20,0)") / F.lit(Decimal("100.00"))).cast(MONEY)


def bank_signed_cents(transaction_type: Column, cents: Column) -> Column:
    """Ledger view in cents, the opposite of :func:`bank_signed_amount`: type 2 adds, 4 subtracts."""
    return F.when(transaction_type == 2, cents).when(transaction_type == 4, -cents).otherwise(F.lit(0))


def bank_side(transaction_type: Column) -> Column:
    """Side of the ledger a bank transaction belongs to."""
    return F.when(transaction_type == 2, "DEBIT").when(transaction_type == 4, "CREDIT")


def parse_paren_amount(text: Column) -> Column:
    """``1,234.56`` and ``(1,234.56)`` as decimals; blank is NULL, other text an error."""
    return parsed_or_error(text, F.translate(F.trim(text), "(,)", "-").try_cast(MONEY), "an amount")


def money_total(amount: Column) -> Column:
    """Sum of money in one fixed decimal type."""
    return F.sum(amount).cast(TOTAL)


def zero_if_null(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0))
