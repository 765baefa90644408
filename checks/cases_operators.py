"""Cases of the table operators, sources and sinks."""

from pyspark.sql import functions as F

from checks import parameters as P
from tallybook.operators import asof, entries, filters, joins, matching, populations
from tallybook.params import period_params
from tallybook.plans import cash, netting
from tallybook.session import scratch_folder
from tallybook.sources.csv_ingest import csv_ingest
from tallybook.sources.tables import table_scan, write_csv, write_table

c = F.col


def cash_tables(t) -> cash.CashTables:
    return cash.CashTables(
        payment_records=t.payment_records,
        payment_record_entries=t.payment_record_entries,
        record_groups=t.payment_record_reconciliation_groups,
        groups=t.reconciliation_groups,
        bank_groups=t.bank_transaction_reconciliation_groups,
        bank_transactions_raw=t.bank_transactions_raw,
        journal=t.accounting_cash_je_listing,
    )


def _entries(t):
    return entries.payment_entries(t.payment_records, t.payment_record_entries, P.YEAR_START, P.YEAR_END)


# The bank and journal sides of the cash chain as SQL, shared by the cash cases.
BANK_CTE = """bank AS (
  SELECT DISTINCT b.id AS bank_transaction_id, b.date, b.origination_account_id,
    CAST(CASE b.transaction_type WHEN 4 THEN CAST(b.amount AS DECIMAL(20,0)) WHEN 2 THEN -CAST(b.amount AS DECIMAL(20,0)) ELSE 0 END
      * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS signed_amount
  FROM {payment_records} r
  JOIN {payment_record_entries} e ON e.payment_record_id = r.id
  JOIN {payment_record_reconciliation_groups} rg ON rg.payment_record_id = r.id
  JOIN {reconciliation_groups} g ON g.id = rg.reconciliation_group_id AND g.state = 'active'
  JOIN {bank_transaction_reconciliation_groups} bg ON bg.reconciliation_group_id = g.id
  JOIN {bank_transactions_raw} b ON b.id = bg.bank_transaction_id
  WHERE r.bank_transaction_date BETWEEN DATE '2022-07-01' AND DATE '2023-06-30' AND r.reconciled
    AND e.transaction_category IN ('Tax Payment', 'Net Pay', 'FX Revenue') AND e.event_id IS NOT NULL
    AND e.on_behalf_of_id NOT IN (2, 7, 31)
    AND NOT regexp_matches(r.bank_account, 'corporate|health_insurance|flex_pay')
)"""
JOURNAL_CTE = """journal AS (
  SELECT je_number, bank_transaction_id, origination_account_id, bank_transaction_date,
    CAST(regexp_replace(replace(net_usd_amount, ',', ''), '^\\((.*)\\)$', '-\\1') AS DECIMAL(18,2)) AS amount
  FROM {accounting_cash_je_listing}
  WHERE CAST(try_strptime(bank_transaction_date, '%m/%d/%y') AS DATE) BETWEEN DATE '2022-07-01' AND DATE '2023-06-30'
)"""
MATCH_CTE = """outcome AS (
  SELECT b.bank_transaction_id, j.bank_transaction_id AS je_bank_transaction_id, b.date AS bt_date,
    j.bank_transaction_date AS je_date, b.origination_account_id AS bt_account, j.origination_account_id AS je_account,
    b.signed_amount AS bt_amount, j.amount AS je_amount, j.je_number,
    CASE WHEN b.bank_transaction_id IS NOT NULL THEN if(j.bank_transaction_id IS NOT NULL, 'Matched', 'Unmatched BT')
      WHEN j.bank_transaction_id IS NOT NULL THEN 'Unmatched JE' END AS scenario
  FROM bank b FULL JOIN journal j ON CAST(b.bank_transaction_id AS VARCHAR) = j.bank_transaction_id
)"""
CASH_CTES = f"WITH {BANK_CTE}, {JOURNAL_CTE}, {MATCH_CTE}"

# Receivables of a period as SQL.
def population_sql(end: str, snap: str) -> str:
    return f"""SELECT DISTINCT * FROM {{recovery_receivable_snapshot}}
  WHERE bank_transaction_date = DATE '{end}' AND snapshot_date = DATE '{snap}'
    AND company_id NOT IN (2, 7, 31) AND pi_id NOT IN (11, 21, 37)
    AND accounting_status_mapping LIKE 'RecoveryReceivable%' AND coalesce(pi_category, '') <> 'micro variance'
    AND CASE WHEN pi_status IS NULL THEN FALSE WHEN pi_status = 'recovered' THEN current_balance >= 0 ELSE TRUE END"""


def exclusion_sql(end: str, snap: str) -> str:
    return f"""SELECT replace(id_category_concat, '-', 'x') AS uid, CAST(sum(balance) AS DECIMAL(28,2)) AS balance
  FROM {{recovery_receivable_snapshot}}
  WHERE bank_transaction_date = DATE '{end}' AND snapshot_date = DATE '{snap}' AND pi_status IS NOT NULL
    AND (pi_status IN ('recovered', 'awaiting_bad_debt_funds', 'awaiting_external_dependency', 'awaiting_bad_debt_approval', 'false_positive')
      OR pi_category = 'micro variance')
  GROUP BY 1"""


def bad_debt_sql(end: str, snap: str) -> str:
    return f"""SELECT DISTINCT replace(id_category_concat, '-', 'x') AS uid FROM {{bad_debt_transfers_snapshot}}
  WHERE snapshot_date = DATE '{snap}' AND effective_date <= DATE '{end}' AND override_status = 'pending'
    AND fiscal_year_written_off IN ('FY25', 'FY26')"""


def negative_sql(end: str) -> str:
    return f"""SELECT uid, CAST(sum(owner_balance) AS DECIMAL(28,2)) AS balance FROM (
    SELECT CAST(event_id AS VARCHAR) || 'x' || transaction_category AS uid, pr_on_behalf_of_id, sum(balance) AS owner_balance
    FROM {{accounting_balance_history}} WHERE bank_transaction_date <= DATE '{end}'
    GROUP BY 1, 2 HAVING sum(balance) < -0.01) AS owners
  WHERE uid IS NOT NULL GROUP BY uid"""


def _csv_loaded(t):
    """Write the customers as CSV files, find them by name, load them over an earlier table and read that."""
    folder = scratch_folder(t.spark)
    key = c("c_custkey")
    text = t.customer.select(
        key.alias("whole"),
        F.when(key % 5 != 0, c("c_nationkey")).alias("whole_with_gaps"),
        c("c_acctbal").alias("number"),
        (key % 2 == 0).cast("string").alias("flag"),
        F.when(key % 3 != 0, (key % 2 == 0).cast("string")).alias("flag_with_gaps"),
        F.lit("2024-01-31").alias("date_text"),
        F.concat(F.lit('say "'), c("c_name"), F.when(key % 7 == 0, F.lit('",\nplease')).otherwise('", please')).alias("quoted"),
        F.lit("").alias("blank"),
        F.concat(c("c_mktsegment"), F.when(key % 11 == 0, F.lit("\n\n")).otherwise("")).alias("_surplus"),
    )
    write_csv(text, f"{folder}/deep/[in]/customer[1].csv")
    write_csv(text.limit(1), f"{folder}/deep/[in]/customer1.csv")
    table = "csv_loaded_" + folder.rpartition("-")[2].replace("-", "_")
    write_table(t.region, table, path=f"{folder}/table")
    return csv_ingest(t.spark, folder, "customer[1].csv", table, path=f"{folder}/table")


CASES = {
    "table_scan": (lambda t: table_scan(t.spark, "customer", t.folder), "SELECT * FROM customer"),
    "csv_ingest": (
        _csv_loaded,
        """SELECT c_custkey AS whole, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS whole_with_gaps,
  c_acctbal AS number, c_custkey % 2 = 0 AS flag,
  CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 2 = 0 AS VARCHAR) END AS flag_with_gaps,
  '2024-01-31' AS date_text,
  'say "' || c_name || '",' || CASE WHEN c_custkey % 7 = 0 THEN chr(10) ELSE ' ' END || 'please' AS quoted,
  CAST(NULL AS DOUBLE) AS blank,
  c_mktsegment || CASE WHEN c_custkey % 11 = 0 THEN chr(10) || chr(10) ELSE '' END AS _surplus
FROM customer""",
    ),
    "operating_account_filter": (
        lambda t: filters.operating_account_filter(t.payment_records).select("id", "bank_account"),
        """SELECT id, bank_account FROM {payment_records}
WHERE strpos(bank_account, 'corporate') + strpos(bank_account, 'health_insurance') + strpos(bank_account, 'flex_pay') = 0""",
    ),
    "recovery_population": (
        lambda t: populations.recovery_population(
            t.recovery_receivable_snapshot, P.CURRENT.end, P.CURRENT.snapshot_date, P.EXCLUDED_COMPANIES,
            P.EXCLUDED_INVESTIGATIONS,
        ),
        population_sql("2023-09-30", "2023-10-05"),
    ),
    "exclusion_population": (
        lambda t: populations.exclusion_population(
            t.recovery_receivable_snapshot, P.CURRENT.end, P.CURRENT.snapshot_date
        ),
        exclusion_sql("2023-09-30", "2023-10-05"),
    ),
    "snapshot_as_of": (
        lambda t: asof.snapshot_as_of(t.bad_debt_transfers_snapshot, P.LAG_1.snapshot_date),
        "SELECT * FROM {bad_debt_transfers_snapshot} WHERE snapshot_date = DATE '2023-07-05'",
    ),
    "scd2_as_of": (
        lambda t: asof.scd2_as_of(t.fct_bad_debt_transfer_history, P.LAG_1.snapshot_date).select(
            "bad_debt_id", "history_effective_from_ts", "history_effective_to_ts"
        ),
        """SELECT bad_debt_id, history_effective_from_ts, history_effective_to_ts FROM {fct_bad_debt_transfer_history}
WHERE TIMESTAMP '2023-07-05' >= history_effective_from_ts AND TIMESTAMP '2023-07-05' < history_effective_to_ts""",
    ),
    "scd2_as_of_after_go_live": (
        lambda t: asof.scd2_as_of_after_go_live(t.fct_bad_debt_history, P.LAG_1.snapshot_date, P.GO_LIVE)
        .withColumn("asked", F.lit("before go-live"))
        .unionByName(
            asof.scd2_as_of_after_go_live(t.fct_bad_debt_history, P.CURRENT.snapshot_date, P.GO_LIVE).withColumn(
                "asked", F.lit("after go-live")
            )
        ),
        """SELECT *, 'before go-live' AS asked FROM {fct_bad_debt_history} WHERE history_effective_from_ts <= TIMESTAMP '2023-07-05'
UNION ALL SELECT *, 'after go-live' FROM {fct_bad_debt_history}
WHERE history_effective_from_ts <= TIMESTAMP '2023-10-05' AND history_effective_to_ts > TIMESTAMP '2023-10-05'""",
    ),
    "effective_between": (
        lambda t: asof.effective_between(t.daily_customer_cash_balances_snapshot, P.LAG_1.end),
        """SELECT * FROM {daily_customer_cash_balances_snapshot}
WHERE effective_from_date <= DATE '2023-06-30' AND effective_to_date >= DATE '2023-06-30'""",
    ),
    "payment_entries": (
        _entries,
        """SELECT r.id, r.bank_transaction_date, r.bank_account, r.bank_transaction_ids, r.reconciled, r.transmission_type,
  r.transaction_type, r.payment_record_entries_sum, e.payment_record_id, e.transaction_category, e.event_id, e.event_type,
  e.on_behalf_of_id, e.on_behalf_of_type, e.payment_direction, e.amount
FROM {payment_records} r LEFT JOIN {payment_record_entries} e ON e.payment_record_id = r.id
WHERE r.bank_transaction_date BETWEEN DATE '2022-07-01' AND DATE '2023-06-30'""",
    ),
    "event_entries": (
        lambda t: entries.event_entries(_entries(t), P.EXCLUDED_COMPANIES),
        """SELECT r.id, r.bank_transaction_date, r.bank_account, r.bank_transaction_ids, r.reconciled, r.transmission_type,
  r.transaction_type, r.payment_record_entries_sum, e.payment_record_id, e.transaction_category, e.event_id, e.event_type,
  e.on_behalf_of_id, e.on_behalf_of_type, e.payment_direction, e.amount
FROM {payment_records} r JOIN {payment_record_entries} e ON e.payment_record_id = r.id
LEFT JOIN {payrolls} pl ON pl.id = e.event_id AND e.event_type = 'Payroll'
WHERE r.bank_transaction_date BETWEEN DATE '2022-07-01' AND DATE '2023-06-30' AND r.reconciled
  AND e.transaction_category IN ('Tax Payment', 'Net Pay', 'FX Revenue') AND e.event_id IS NOT NULL
  AND e.on_behalf_of_id NOT IN (2, 7, 31) AND NOT regexp_matches(r.bank_account, 'corporate|health_insurance|flex_pay')""",
    ),
    "reconciled_bank_transactions": (
        lambda t: entries.reconciled_bank_transactions(
            entries.event_entries(_entries(t), P.EXCLUDED_COMPANIES), t.payment_record_reconciliation_groups,
            t.reconciliation_groups, t.bank_transaction_reconciliation_groups, t.bank_transactions_raw,
        ),
        f"WITH {BANK_CTE} SELECT * FROM bank",
    ),
    "journal_lines": (
        lambda t: entries.journal_lines(t.accounting_cash_je_listing, P.YEAR_START, P.YEAR_END),
        f"WITH {JOURNAL_CTE} SELECT * FROM journal",
    ),
    "match_classify": (
        lambda t: matching.match_classify(
            cash.cash_bank_transactions(cash_tables(t), P.YEAR_START, P.YEAR_END, P.EXCLUDED_COMPANIES),
            entries.journal_lines(t.accounting_cash_je_listing, P.YEAR_START, P.YEAR_END),
        ),
        f"{CASH_CTES} SELECT * FROM outcome",
    ),
    "priority_match": (
        lambda t: matching.priority_match(
            populations.negative_event_balances(t.accounting_balance_history, P.MONTH_1.cutoff),
            list(
                zip(
                    netting.month_populations(
                        t.recovery_receivable_snapshot, t.bad_debt_transfers_snapshot, P.LAG_2, P.EXCLUDED_COMPANIES,
                        P.EXCLUDED_INVESTIGATIONS,
                    ),
                    netting.MONTH_1_LABELS,
                )
            ),
            netting.MONTH_1_DEFAULT,
        ).withColumnRenamed("balance_1", "balance"),
        f"""WITH negative AS ({negative_sql("2023-03-31")}),
rr AS ({population_sql("2023-03-31", "2023-04-05")}),
bd AS ({bad_debt_sql("2023-03-31", "2023-04-05")}),
ex AS ({exclusion_sql("2023-03-31", "2023-04-05")})
SELECT n.uid, n.balance,
  CASE WHEN rr.pi_id IS NOT NULL THEN 'recovery receivable matched' WHEN bd.uid IS NOT NULL THEN 'bad debt matched'
    WHEN ex.uid IS NOT NULL THEN 'excluded' ELSE 'unmatched' END AS match,
  CASE WHEN rr.pi_id IS NOT NULL THEN 1 WHEN bd.uid IS NOT NULL THEN 2 WHEN ex.uid IS NOT NULL THEN 3 ELSE 4 END AS match_priority
FROM negative n LEFT JOIN rr ON replace(rr.id_category_concat, '-', 'x') = n.uid LEFT JOIN bd ON bd.uid = n.uid
LEFT JOIN ex ON ex.uid = n.uid""",
    ),
    "credit_loss_lookup": (
        lambda t: joins.credit_loss_lookup(
            asof.snapshot_as_of(t.recovery_receivable_snapshot, P.CURRENT.snapshot_date),
            asof.snapshot_as_of(t.recovery_receivable_credit_delinquencies_snapshot, P.CURRENT.snapshot_date),
            c("id_category_concat"),
            c("id_event_concat"),
        ).select("id_category_concat", "pi_id", "balance", "is_credit_loss"),
        """SELECT rr.id_category_concat, rr.pi_id, rr.balance, flags.is_credit_loss FROM {recovery_receivable_snapshot} rr
LEFT JOIN (SELECT DISTINCT id_event_concat, is_credit_loss FROM {recovery_receivable_credit_delinquencies_snapshot}
  WHERE snapshot_date = DATE '2023-10-05') AS flags ON flags.id_event_concat = rr.id_category_concat
WHERE rr.snapshot_date = DATE '2023-10-05'""",
    ),
    "investigation_with_category": (
        lambda t: joins.investigation_with_category(
            t.payment_investigations.drop("transaction_category"), t.payment_event_balance_investigations,
            t.payment_event_balances,
        ).select("id", "event_id", "transaction_category"),
        """SELECT pi.id, pi.event_id, peb.transaction_category FROM {payment_investigations} pi
LEFT JOIN {payment_event_balance_investigations} link ON link.payment_investigation_id = pi.id
LEFT JOIN {payment_event_balances} peb ON peb.id = link.payment_event_balance_id""",
    ),
    "negative_event_balances": (
        lambda t: populations.negative_event_balances(t.accounting_balance_history, P.LAG_1.end).withColumnRenamed(
            "balance_1", "balance"
        ),
        negative_sql("2023-06-30"),
    ),
    "polymorphic_or_join": (
        lambda t: joins.polymorphic_join(
            t.penalty_keys,
            t.reconciliations,
            [
                ("batch_id", "NachaBatch"),
                ("return_id", "NachaEntryReturn"),
                ("check_id", "CheckPayment"),
                ("check_return_id", "CheckPaymentReturn"),
            ],
        ),
        """WITH hits AS (
  SELECT k.penalty_entry_id, r.transaction_id FROM {penalty_keys} k JOIN {reconciliations} r ON r.record_id = k.batch_id AND r.record_type = 'NachaBatch'
  UNION ALL SELECT k.penalty_entry_id, r.transaction_id FROM {penalty_keys} k JOIN {reconciliations} r ON r.record_id = k.return_id AND r.record_type = 'NachaEntryReturn'
  UNION ALL SELECT k.penalty_entry_id, r.transaction_id FROM {penalty_keys} k JOIN {reconciliations} r ON r.record_id = k.check_id AND r.record_type = 'CheckPayment'
  UNION ALL SELECT k.penalty_entry_id, r.transaction_id FROM {penalty_keys} k JOIN {reconciliations} r ON r.record_id = k.check_return_id AND r.record_type = 'CheckPaymentReturn')
SELECT k.penalty_entry_id, k.batch_id, k.return_id, k.check_id, k.check_return_id, hits.transaction_id
FROM {penalty_keys} k LEFT JOIN hits ON hits.penalty_entry_id = k.penalty_entry_id""",
    ),
    "id_list_filter": (
        lambda t: filters.id_list_filter(
            t.payment_record_entries, "event_id", t.international_contractor_payments.filter(
                c("credit_currency") == "EUR"
            ).select("id"),
        ),
        """SELECT * FROM {payment_record_entries}
WHERE event_id IN (SELECT id FROM {international_contractor_payments} WHERE credit_currency = 'EUR')""",
    ),
    "any_nonzero_filter": (
        lambda t: filters.any_nonzero_filter(
            t.payment_records.select("id", "debit_amount", "payment_record_entries_sum"),
            ["debit_amount", "payment_record_entries_sum"],
        ),
        """SELECT id, debit_amount, payment_record_entries_sum FROM {payment_records}
WHERE coalesce(debit_amount, 0) <> 0 OR coalesce(payment_record_entries_sum, 0) <> 0""",
    ),
    "period_params": (
        lambda t: _movement_in(
            t, period_params({"month": "2023-05", "range": "2023-01-01--2023-06-30", "until": "2023-06-15",
                              "names": ["PNC operations", "Chase recovery"]})
        ),
        """SELECT bank_account, count(*) AS records, CAST(sum(signed_amount) AS DECIMAL(28,2)) AS net,
  count(*) FILTER (WHERE bank_transaction_date >= DATE '2023-05-01') AS since_month
FROM {payment_records} WHERE bank_transaction_date BETWEEN DATE '2023-01-01' AND DATE '2023-06-15'
  AND bank_account IN ('PNC operations', 'Chase recovery') GROUP BY bank_account""",
    ),
}


def _movement_in(t, p):
    day = c("bank_transaction_date")
    return (
        t.payment_records.filter(
            day.between(F.lit(p["range"].start), F.lit(p["range"].end))
            & (day <= F.lit(p["until"]))
            & c("bank_account").isin(list(p["names"]))
        )
        .groupBy("bank_account")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.sum("signed_amount").cast("decimal(28,2)").alias("net"),
            F.count(F.when(day >= F.lit(p["month"]), 1)).alias("since_month"),
        )
    )
