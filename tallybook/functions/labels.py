"""Category, status and flag rules."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook import constants as K


def one_of(value: Column, values: Sequence) -> Column:
    return value.isin(list(values)) if values else F.lit(False)


def none_of(value: Column, values: Sequence) -> Column:
    """SQL NOT IN: unknown for a NULL value. An empty list excludes nothing."""
    return ~value.isin(list(values)) if values else F.lit(True)


def like_none(value: Column, patterns: Sequence[str]) -> Column:
    """The value matches none of the patterns; unknown for a NULL value."""
    keep = F.lit(True)
    for pattern in patterns:
        keep = keep & ~value.like(pattern)
    return keep


def aging_bucket(age: Column) -> Column:
    """Age in days to its bucket; NULL for a missing age or one between two buckets."""
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for first, last, name in K.AGING_BUCKETS:
        if first is None:
            inside = age <= last
        elif last is None:
            inside = age > first
        else:
            inside = age.between(first, last)
        label = label.when(inside, name)
    return label


def loss_category(category: Column, is_credit_loss: Column) -> Column:
    return (
        F.when(category == "Fraud", "Fraud")
        .when(F.coalesce(is_credit_loss, F.lit(False)), "Credit")
        .otherwise("Product")
    )


def loss_category_strict(category: Column, is_credit_loss: Column) -> Column:
    """As :func:`loss_category`, but a missing category is Product whatever the flag."""
    return (
        F.when(category == "Fraud", "Fraud")
        .when((category != "Fraud") & is_credit_loss, "Credit")
        .otherwise("Product")
    )


def writeoff_category(
    reason: Column, is_credit_loss: Column, partner_reason: str, partner_label: str
) -> Column:
    """Category of a write-off; a missing reason is Product."""
    fraud = reason.isin(list(K.FRAUD_WRITEOFF_REASONS))
    return (
        F.when(fraud, "Fraud")
        .when(reason == partner_reason, partner_label)
        .when(~fraud & is_credit_loss, "Credit")
        .otherwise("Product")
    )


def accounting_status(
    balance: Column, status: Column, investigation_id: Column, age: Column, false_positive_ids: Sequence
) -> Column:
    """Status mapping of a receivable; the first rule that holds decides."""
    return (
        F.when(balance >= 0, K.MAPPING_RECOVERED)
        .when(status.isin("awaiting_external_dependency", "false_positive"), K.MAPPING_FALSE_POSITIVE)
        .when(status.isin("awaiting_bad_debt_approval", "awaiting_bad_debt_funds"), K.MAPPING_WRITTEN_OFF)
        .when(one_of(investigation_id, false_positive_ids), K.MAPPING_FALSE_POSITIVE)
        .when(age >= K.RESERVE_AGE_DAYS, K.MAPPING_OVER_90)
        .otherwise(K.MAPPING_UNDER_90)
    )


def reserve_flag(age: Column) -> Column:
    return F.when(age >= K.RESERVE_AGE_DAYS, "y").when(age < K.RESERVE_AGE_DAYS, "n")


def investigation_category(category: Column) -> Column:
    return F.when(category == "expedited", "Credit").when(category == "fraud", "Fraud").otherwise("Other")


def mapped_label(code: Column, labels: Mapping) -> Column:
    """Label of a code; NULL for an unknown code."""
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, name in labels.items():
        label = label.when(code == value, name)
    return label


def account_label_with_fallback(
    account_id: Column, bank: Column, purpose: Column, labels: Mapping[int, str]
) -> Column:
    """Mapped account name, else bank and purpose (NULL if one of them is)."""
    named = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, name in labels.items():
        named = named.when(account_id == value, name)
    return named.otherwise(F.concat(bank, F.lit(" "), purpose))


def first_match_like(rules: Sequence[tuple[Column, str, str]], default: str) -> Column:
    """Ordered (column, pattern, label) rules; the first pattern that matches decides."""
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, pattern, name in rules:
        label = label.when(value.like(pattern), name)
    return label.otherwise(default)


def yn_flag(condition: Column, yes: str = "Y", no: str = "N") -> Column:
    """Yes where the condition holds; no where it does not or is unknown."""
    return F.when(condition, yes).otherwise(no)


def inclusion_flag(
    reconciled: Column,
    category: Column,
    bank_account: Column,
    bank_date: Column,
    owner_counts: Column,
) -> Column:
    """Whether an entry belongs to the cash chain; an unknown answer counts as excluded.

    ``owner_counts``: the entry has an owner, and not an excluded one.
    """
    belongs = (
        reconciled
        & category.isNotNull()
        & none_of(category, K.NON_EVENT_CATEGORIES)
        & like_none(bank_account, K.NON_OPERATING_PATTERNS)
        & bank_date.isNotNull()
        & owner_counts
    )
    return F.when(belongs, "Should Include").otherwise("Excluded")
