"""Cases of the column rules: each rule over every row of a table."""

import datetime

from pyspark.sql import functions as F

from checks import parameters as P
from checks.parameters import pairs_sql
from tallybook import constants as K
from tallybook.functions import amounts, dates, keys, labels
from tallybook.plans.movement import penalty_accounting_mapping
from tallybook.plans.profile import code_label

c = F.col


def _sign(rule, name):
    return lambda t: t.payment_record_entries.select(
        "payment_record_id", "payment_direction", "amount", rule(c("payment_direction"), c("amount")).alias(name)
    )


def _age(rule, name, column="pi_age_in_days"):
    return lambda t: t.recovery_receivable_snapshot.select("snapshot_date", "pi_id", rule(c(column)).alias(name))


def _flagged(t):
    credit = t.recovery_receivable_credit_delinquencies_snapshot.select(
        c("snapshot_date").alias("d"), c("id_event_concat").alias("k"), "is_credit_loss"
    )
    rr = t.recovery_receivable_snapshot
    return rr.join(credit, (c("snapshot_date") == c("d")) & (c("id_category_concat") == c("k")), "left")


_FLAGGED_SQL = """
FROM {recovery_receivable_snapshot} rr LEFT JOIN {recovery_receivable_credit_delinquencies_snapshot} cd
  ON rr.snapshot_date = cd.snapshot_date AND rr.id_category_concat = cd.id_event_concat"""


def _loss(rule):
    return lambda t: _flagged(t).select(
        "snapshot_date", "pi_id", rule(c("accounting_pi_category"), c("is_credit_loss")).alias("category")
    )


CASES = {
    "signed_amount": (
        _sign(amounts.signed_amount, "signed"),
        """SELECT payment_record_id, payment_direction, amount,
  CAST(amount * (CASE payment_direction WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS DECIMAL(18,2)) AS signed
FROM {payment_record_entries}""",
    ),
    "signed_amount_else_negative": (
        _sign(amounts.signed_amount_else_negative, "signed"),
        """SELECT payment_record_id, payment_direction, amount,
  CASE WHEN coalesce(payment_direction, 1) = 0 THEN amount ELSE -amount END AS signed
FROM {payment_record_entries}""",
    ),
    "signed_amount_else_null": (
        _sign(amounts.signed_amount_else_null, "signed"),
        """SELECT payment_record_id, payment_direction, amount,
  CAST(amount * (1 - 2 * payment_direction) AS DECIMAL(18,2)) AS signed
FROM {payment_record_entries}""",
    ),
    "bank_signed_amount": (
        lambda t: t.bank_transactions_raw.select(
            "id", amounts.bank_signed_amount(c("transaction_type"), c("amount")).alias("signed_amount")
        ),
        """SELECT id, CAST(CASE transaction_type WHEN 4 THEN CAST(amount AS DECIMAL(20,0)) WHEN 2 THEN -CAST(amount AS DECIMAL(20,0)) ELSE 0 END
  * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS signed_amount
FROM {bank_transactions_raw}""",
    ),
    "bank_signed_cents_by_side": (
        lambda t: t.bank_transactions_raw.select(
            "id",
            amounts.bank_signed_cents(c("transaction_type"), c("amount")).alias("amount_cents"),
            amounts.bank_side(c("transaction_type")).alias("side"),
        ),
        """SELECT id, CASE transaction_type WHEN 2 THEN amount WHEN 4 THEN -amount ELSE 0 END AS amount_cents,
  CASE transaction_type WHEN 2 THEN 'DEBIT' WHEN 4 THEN 'CREDIT' END AS side
FROM {bank_transactions_raw}""",
    ),
    "text_id": (
        lambda t: t.payment_record_entries.select("payment_record_id", keys.text_id(c("event_id")).alias("event")),
        "SELECT payment_record_id, CAST(event_id AS VARCHAR) || 'x' AS event FROM {payment_record_entries}",
    ),
    "event_uid": (
        lambda t: t.accounting_balance_history.select(
            "event_id", "transaction_category", keys.event_uid(c("event_id"), c("transaction_category")).alias("uid")
        ),
        """SELECT event_id, transaction_category,
  CASE WHEN event_id IS NOT NULL AND transaction_category IS NOT NULL THEN concat(event_id, 'x', transaction_category) END AS uid
FROM {accounting_balance_history}""",
    ),
    "normalize_key": (
        lambda t: t.recovery_receivable_snapshot.select(
            "snapshot_date", keys.normalize_key(c("id_category_concat")).alias("uid")
        ),
        "SELECT snapshot_date, replace(id_category_concat, '-', 'x') AS uid FROM {recovery_receivable_snapshot}",
    ),
    "aging_bucket": (
        _age(labels.aging_bucket, "bucket"),
        """SELECT snapshot_date, pi_id, CASE WHEN pi_age_in_days > 180 THEN '> 180 days' WHEN pi_age_in_days >= 121 THEN '121 - 180 days'
  WHEN pi_age_in_days >= 91 THEN '91 - 120 days' WHEN pi_age_in_days >= 61 THEN '61 - 90 days'
  WHEN pi_age_in_days >= 31 THEN '31 - 60 days' WHEN pi_age_in_days IS NOT NULL THEN '0 - 30 days' END AS bucket
FROM {recovery_receivable_snapshot}""",
    ),
    "loss_category": (
        _loss(labels.loss_category),
        """SELECT rr.snapshot_date, pi_id, CASE WHEN accounting_pi_category = 'Fraud' THEN 'Fraud'
  WHEN is_credit_loss IS TRUE THEN 'Credit' ELSE 'Product' END AS category""" + _FLAGGED_SQL,
    ),
    "loss_category_strict": (
        _loss(labels.loss_category_strict),
        """SELECT rr.snapshot_date, pi_id, CASE WHEN accounting_pi_category IS NULL THEN 'Product'
  WHEN accounting_pi_category = 'Fraud' THEN 'Fraud' WHEN is_credit_loss IS TRUE THEN 'Credit' ELSE 'Product' END AS category"""
        + _FLAGGED_SQL,
    ),
    "writeoff_category": (
        lambda t: t.fct_bad_debt_transfer.select(
            "bad_debt_id",
            "snapshot_date",
            labels.writeoff_category(
                c("bad_debt_reason"), c("event_id") % 3 == 0, P.PARTNER_REASON, P.PARTNER_LABEL
            ).alias("category"),
        ),
        """SELECT bad_debt_id, snapshot_date, CASE WHEN bad_debt_reason IS NULL THEN 'Product'
  WHEN bad_debt_reason = 'Fraud loss' OR bad_debt_reason = 'ATO concession' THEN 'Fraud'
  WHEN bad_debt_reason = 'Partner invoice' THEN 'Partner - Credit Invoiced'
  WHEN event_id % 3 = 0 THEN 'Credit' ELSE 'Product' END AS category
FROM {fct_bad_debt_transfer}""",
    ),
    "accounting_status": (
        lambda t: t.recovery_receivable_snapshot.select(
            "snapshot_date",
            "pi_id",
            labels.accounting_status(
                c("current_balance"), c("pi_status"), c("pi_id"), c("pi_age_in_days"), P.EXCLUDED_INVESTIGATIONS
            ).alias("mapping"),
        ),
        """SELECT snapshot_date, pi_id, CASE WHEN current_balance >= 0 THEN 'RecoveryReceivable_SuccessfullyRecoveredAfterPeriodEnd'
  WHEN pi_status = 'false_positive' OR pi_status = 'awaiting_external_dependency' THEN 'NotRecovery_FalsePositive'
  WHEN pi_status LIKE 'awaiting_bad_debt_%' THEN 'NotRecovery_writtenoff_pendingcorptransfer'
  WHEN pi_id = 11 OR pi_id = 21 OR pi_id = 37 THEN 'NotRecovery_FalsePositive'
  WHEN pi_age_in_days < 90 THEN 'RecoveryReceivable_<90d' ELSE 'RecoveryReceivable_>90d' END AS mapping
FROM {recovery_receivable_snapshot}""",
    ),
    "reserve_flag": (
        _age(labels.reserve_flag, "flag"),
        """SELECT snapshot_date, pi_id, CASE WHEN pi_age_in_days < 90 THEN 'n' WHEN pi_age_in_days IS NOT NULL THEN 'y' END AS flag
FROM {recovery_receivable_snapshot}""",
    ),
    "investigation_category": (
        _age(labels.investigation_category, "category", "pi_category"),
        """SELECT snapshot_date, pi_id, CASE pi_category WHEN 'fraud' THEN 'Fraud' WHEN 'expedited' THEN 'Credit' ELSE 'Other' END AS category
FROM {recovery_receivable_snapshot}""",
    ),
    "account_label": (
        lambda t: t.payment_records.select(
            "id", labels.mapped_label(c("origination_account_id"), P.FIRST_BANK).alias("bank")
        ),
        f"""SELECT id, bank FROM {{payment_records}} LEFT JOIN (VALUES {pairs_sql(P.FIRST_BANK)}) AS names(account, bank)
  ON origination_account_id = account""",
    ),
    "account_label_with_fallback": (
        lambda t: t.dim_origination_account.select(
            "origination_account_id",
            labels.account_label_with_fallback(
                c("origination_account_id"), c("origination_bank_name"), c("account_purpose"), P.CHECK_ACCOUNTS
            ).alias("bank_account"),
        ),
        f"""SELECT origination_account_id, CASE WHEN label IS NOT NULL THEN label ELSE origination_bank_name || ' ' || account_purpose END AS bank_account
FROM {{dim_origination_account}} LEFT JOIN (VALUES {pairs_sql(P.CHECK_ACCOUNTS)}) AS names(account, label)
  ON origination_account_id = account""",
    ),
    "first_match_like": (
        lambda t: t.penalty_cases.join(
            t.agents.select(c("id").alias("agent"), "agent_payment_type"), c("agent_id") == c("agent"), "left"
        )
        .withColumnRenamed("title", "penalty_case_title")
        .select("id", penalty_accounting_mapping().alias("mapping")),
        """SELECT pc.id, CASE WHEN agent_payment_type LIKE '%State tax%' OR agent_payment_type LIKE '%Federal tax%' THEN 'no_reclass - tax operations'
  WHEN agent_payment_type LIKE '%Benefits Payment%' THEN 'requires_reclass - benefits operations'
  WHEN title LIKE '%#ATO%' THEN 'requires_reclass - risk operations' ELSE 'requires_reclass - default' END AS mapping
FROM {penalty_cases} pc LEFT JOIN {agents} a ON pc.agent_id = a.id""",
    ),
    "inclusion_flag": (
        lambda t: t.payment_records.join(
            t.payment_record_entries.select(
                "payment_record_id", "transaction_category", c("on_behalf_of_id").alias("owner")
            ),
            c("id") == c("payment_record_id"),
            "left",
        ).select(
            "id",
            "transaction_category",
            labels.inclusion_flag(
                c("reconciled"), c("transaction_category"), c("bank_account"), c("bank_transaction_date"),
                c("owner").isNotNull() & labels.none_of(c("owner"), P.EXCLUDED_COMPANIES),
            ).alias("flag"),
        ),
        """SELECT pr.id, e.transaction_category, CASE WHEN coalesce(reconciled, FALSE)
    AND coalesce(transaction_category IN ('Tax Payment', 'Net Pay', 'FX Revenue'), FALSE)
    AND coalesce(NOT regexp_matches(bank_account, 'corporate|health_insurance|flex_pay'), FALSE)
    AND bank_transaction_date IS NOT NULL AND coalesce(e.on_behalf_of_id NOT IN (2, 7, 31), FALSE)
  THEN 'Should Include' ELSE 'Excluded' END AS flag
FROM {payment_records} pr LEFT JOIN {payment_record_entries} e ON pr.id = e.payment_record_id""",
    ),
    "settlement_timing": (
        lambda t: t.transfer_records.select(
            "id", dates.settlement_timing(c("bank_transaction_date"), P.LAG_1.end).alias("timing")
        ),
        """SELECT id, CASE WHEN bank_transaction_date IS NULL THEN 'not_yet_settled'
  ELSE 'settled_' || CASE sign(date_diff('day', DATE '2023-06-30', bank_transaction_date)) WHEN 0 THEN 'on' WHEN 1 THEN 'after' ELSE 'before' END
    || '_period_end_date' END AS timing
FROM {transfer_records}""",
    ),
    "yn_flag": (
        lambda t: t.payroll_admins.select(
            "company_id", labels.yn_flag(c("is_accountant")).alias("accountant"),
            labels.yn_flag(c("primary_payroll_admin"), "Yes", "No").alias("is_primary"),
        ),
        """SELECT company_id, if(coalesce(is_accountant, FALSE), 'Y', 'N') AS accountant,
  if(coalesce(primary_payroll_admin, FALSE), 'Yes', 'No') AS is_primary FROM {payroll_admins}""",
    ),
    "code_label": (
        lambda t: t.pay_schedules.join(t.pay_period_codes, "pay_period")
        .groupBy("company_id")
        .agg(code_label(c("pay_period_num")).alias("shortest")),
        """SELECT company_id, CASE min(pay_period_num) WHEN 1 THEN 'Every week' WHEN 2 THEN 'Every other week' WHEN 3 THEN 'Twice per month'
  WHEN 4 THEN 'Monthly' WHEN 5 THEN 'Quarterly' WHEN 6 THEN 'Annually' END AS shortest
FROM {pay_schedules} JOIN {pay_period_codes} USING (pay_period) GROUP BY company_id""",
    ),
    "parse_paren_amount": (
        lambda t: t.accounting_cash_je_listing.select(
            "je_number", "net_usd_amount", amounts.parse_paren_amount(c("net_usd_amount")).alias("amount")
        ),
        """SELECT je_number, net_usd_amount, CAST(regexp_replace(replace(net_usd_amount, ',', ''), '^\\((.*)\\)$', '-\\1') AS DECIMAL(18,2)) AS amount
FROM {accounting_cash_je_listing}""",
    ),
    "parse_mixed_date": (
        lambda t: t.accounting_cash_je_listing.select(
            "je_number", dates.parse_mixed_date(c("bank_transaction_date")).alias("parsed")
        ),
        """SELECT je_number, CASE WHEN bank_transaction_date LIKE '%/%/____' THEN CAST(strptime(bank_transaction_date, '%m/%d/%Y') AS DATE)
  WHEN bank_transaction_date LIKE '%/%' THEN CAST(strptime(bank_transaction_date, '%m/%d/%y') AS DATE)
  WHEN bank_transaction_date <> '' THEN DATE '1899-12-30' + CAST(bank_transaction_date AS INTEGER) END AS parsed
FROM {accounting_cash_je_listing}""",
    ),
    "parse_date_or_null": (
        lambda t: t.accounting_cash_je_listing.select(
            "je_number", dates.parse_date_or_null(c("bank_transaction_date")).alias("parsed")
        ),
        """SELECT je_number, CAST(try_strptime(bank_transaction_date, '%m/%d/%y') AS DATE) AS parsed FROM {accounting_cash_je_listing}""",
    ),
    "date_floor": (
        lambda t: t.payment_records.select(
            "id", dates.date_floor(c("bank_transaction_date"), datetime.date(2020, 1, 1)).alias("floored")
        ),
        """SELECT id, CASE WHEN bank_transaction_date IS NOT NULL THEN greatest(bank_transaction_date, DATE '2020-01-01') END AS floored
FROM {payment_records}""",
    ),
}
