"""Ledger-shaped tables derived from whole star-schema tables.

Each table is one SELECT that runs in Spark and, through ``dialects``, in DuckDB. Every
row of the source table gives a row of the fixture; remainders of keys only pick values.
Source dates are moved 23 years ahead, so they span 2018 to 2024.
"""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from checks import dialects
from tallybook.session import scratch_folder
from tallybook.sources.tables import table_scan, write_table

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Period ends and the dates their dated tables were copied.
PERIODS = (("2023-03-31", "2023-04-05"), ("2023-06-30", "2023-07-05"), ("2023-09-30", "2023-10-05"))

# Accounts by order key: remainder, name, id, bank.
ACCOUNTS = (
    (0, "SVB operations", 1, "SVB"),
    (1, "Chase operations", 3, "Chase"),
    (2, "PNC operations", 16, "PNC"),
    (3, "Chase wire_in", 9, "Chase"),
    (4, "SVB corporate", 2, "SVB"),
    (5, "SVB health_insurance", 5, "SVB"),
    (6, "Chase flex_pay", 8, "Chase"),
    (7, None, 29, "Blueridge"),
    (8, "SVB wire_in", 10, "SVB"),
    (9, "Chase corporate", 4, "Chase"),
    (10, "PNC wire_in", 18, "PNC"),
    (11, "Chase payroll_incoming_wires", 6, "Chase"),
    (12, "PNC corporate", 17, "PNC"),
    (13, "Chase recovery", 7, "Chase"),
    (14, "Chase flex_pay_repayment", 12, "Chase"),
    (15, "PNC operations", 16, "PNC"),
)


def _pick(key: str, values, otherwise="NULL") -> str:
    """CASE over the remainder of a key; ``values`` are SQL texts, None stands for NULL."""
    whens = " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values) if v is not None)
    return f"CASE {key} % {len(values)} {whens} ELSE {otherwise} END"


def _text(value) -> str | None:
    return None if value is None else f"'{value}'"


def _account(column: int, key: str = "o_orderkey") -> str:
    values = [_text(a[column]) if column != 2 else str(a[2]) for a in ACCOUNTS]
    return _pick(key, values)


def definitions(d: dict) -> dict[str, str]:
    """SQL text per fixture; earlier ones may be read by later ones as ``{name}``."""
    ts = d["ts"]
    day = "CAST(o_orderdate + INTERVAL 23 YEAR AS DATE)"
    ship = "CAST(l_shipdate + INTERVAL 23 YEAR AS DATE)"
    event = "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey END"
    category = (
        "CASE l_linenumber WHEN 1 THEN 'Tax Payment' WHEN 2 THEN 'Net Pay' WHEN 3 THEN 'Balance Transfer' "
        "WHEN 4 THEN 'Internal Transfer' WHEN 5 THEN 'Invoices' WHEN 6 THEN 'FX Revenue' ELSE NULL END"
    )
    event_type = "CASE {k} % 4 WHEN 0 THEN 'Payroll' WHEN 1 THEN 'ContractorPayment' WHEN 2 THEN 'HistoricalCompany' ELSE 'TaxForm' END"
    money = "CAST({x} AS DECIMAL(18,2))"
    total = money.format(x="o_totalprice")
    bank_day = f"CASE WHEN o_orderkey % 3 = 0 THEN {day} + 2 ELSE {day} END"
    is_debit = "(o_orderkey + o_custkey) % 2 = 0"
    q = {}

    # -- payments -------------------------------------------------------------------
    q["payment_records"] = f"""
SELECT o_orderkey AS id, o_custkey AS on_behalf_of_id, 'Company' AS on_behalf_of_type, {day} AS date,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE {bank_day} END AS bank_transaction_date,
  {_account(3)} AS bank_name, {_account(1)} AS bank_account, {_account(2)} AS origination_account_id,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus <> 'P' END AS reconciled,
  {_pick("o_custkey", ["'NachaEntry'", "'ElectronicEntry'", "'CheckPaymentEntry'", "'WirePayment'"])} AS transmission_type,
  o_orderkey AS transmission_id,
  {_pick("o_orderkey", ["'Credit balance transfer'", "'Debit balance transfer'", "'Payroll'", "'Interest Income'", None])} AS transaction_type,
  {_pick("(o_orderkey + o_custkey)", ["'Others'", "'Tax Payment'", "'Net Pay'", "'Balance Transfer'", "'Invoices'", None])} AS payment_category,
  CASE WHEN {is_debit} THEN {total} END AS debit_amount,
  CASE WHEN {is_debit} THEN NULL ELSE {total} END AS credit_amount,
  CASE WHEN {is_debit} THEN {total} ELSE -{total} END AS signed_amount,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {total} END AS payment_record_entries_sum,
  CASE WHEN o_orderkey % 29 = 0
    THEN CAST(o_orderkey * 10 AS STRING) || ',' || CAST(o_orderkey * 10 + 1 AS STRING)
    ELSE CAST(o_orderkey * 10 AS STRING) END AS bank_transaction_ids
FROM {{orders}}"""
    q["payment_records_raw"] = f"""
SELECT o_orderkey AS id, {_account(2)} AS origination_account_id,
  {_pick("o_custkey", ["'NachaEntry'", "'ElectronicEntry'", "'CheckPaymentEntry'", "'WirePayment'"])} AS transmission_type,
  {total} AS amount
FROM {{orders}}"""
    q["payment_record_entries"] = f"""
SELECT l_orderkey AS payment_record_id, {event} AS event_id, {event_type.format(k="l_partkey")} AS event_type,
  {category} AS transaction_category,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE NULL END AS payment_direction,
  {money.format(x="l_extendedprice")} AS amount,
  CASE WHEN l_suppkey % 23 = 5 THEN NULL ELSE l_suppkey END AS on_behalf_of_id, 'Company' AS on_behalf_of_type
FROM {{lineitem}}"""
    q["fct_payment_record"] = """
SELECT id AS payment_record_id, on_behalf_of_id, origination_account_id, transmission_type, bank_transaction_date,
  debit_amount, credit_amount, reconciled AS reconciled_flag
FROM {payment_records}"""
    q["fct_payment_record_entry"] = """
SELECT payment_record_id, event_id, transaction_category,
  CASE payment_direction WHEN 0 THEN amount WHEN 1 THEN -amount ELSE CAST(0 AS DECIMAL(18,2)) END
    AS payment_record_entry_signed_amount
FROM {payment_record_entries}"""
    # One event holds a twentieth of all rows, with many owners on each of its days, the last ones of the months.
    q["accounting_balance_history"] = f"""
SELECT l_suppkey AS pr_on_behalf_of_id, 'Company ' || CAST(l_suppkey AS STRING) AS on_behalf_of_name,
  CASE WHEN l_partkey % 20 = 3 THEN 3 ELSE {event} END AS event_id, {category} AS transaction_category,
  CASE WHEN l_partkey % 20 = 3 THEN last_day({ship}) ELSE {ship} END AS bank_transaction_date,
  {_pick("l_partkey", ["'open'", "'recovered'", "'in_progress'", None])} AS investigation_status,
  CASE WHEN l_partkey % 4 = 3 THEN NULL ELSE CAST({ship} + 5 AS {ts}) END AS investigation_created_at,
  CASE l_returnflag WHEN 'R' THEN -{money.format(x="l_extendedprice")} WHEN 'A' THEN {money.format(x="l_extendedprice")}
    ELSE CAST(0 AS DECIMAL(18,2)) END AS balance
FROM {{lineitem}}"""
    q["companies"] = f"""
SELECT c_custkey AS id, c_name AS name, c_mktsegment <> 'MACHINERY' AS is_active, c_custkey % 13 <> 0 AS current_flag,
  CASE WHEN c_custkey % 37 = 0 THEN NULL
    ELSE CAST(DATE '2019-01-31' + CAST(c_custkey % 1500 AS INT) AS {ts}) END AS joined_at,
  'N' || CAST(c_nationkey AS STRING) AS filing_state, c_mktsegment AS industry_classification,
  'Title ' || c_mktsegment AS industry_title,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 40 END AS accounting_firm_id,
  {money.format(x="c_acctbal")} AS median_payroll_net_pay
FROM {{customer}}"""
    q["international_contractor_payments"] = f"""
SELECT p_partkey AS id, {_pick("p_size", ["'EUR'", "'CAD'", "'INR'"])} AS credit_currency,
  {money.format(x="p_retailprice")} AS usd_amount
FROM {{part}}"""
    q["payrolls"] = f"""
SELECT o_orderkey AS id, {day} AS check_date,
  CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'failed' END AS processing_state,
  {total} AS gross_amount
FROM {{orders}}"""
    q["calendar"] = f"""
SELECT date, {d["month_name"]("date")} AS month_name, CAST(year(date) AS INT) AS year FROM ({d["days"]}) AS days"""

    # -- bank side --------------------------------------------------------------------
    q["bank_transactions_raw"] = f"""
SELECT o_orderkey * 10 AS id, {bank_day} AS date, {_account(2)} AS origination_account_id,
  CASE WHEN o_orderkey % 31 = 0 THEN 6 WHEN {is_debit} THEN 4 ELSE 2 END AS transaction_type,
  CAST({total} * 100 AS BIGINT) AS amount,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'SWEEP OUT TO 555000111' WHEN '2-HIGH' THEN 'SWEEP IN FROM 555000222'
    WHEN '3-MEDIUM' THEN 'WIRE TRANSFER' ELSE 'ACH BATCH' END AS description,
  {_pick("o_orderkey", ["'ACH Credit'", "'ACH Debit'", "'Wire'"])} AS type_description,
  CAST(100 + o_orderkey % 9 AS STRING) AS type_code,
  CAST(o_orderkey * 7 AS STRING) || 'TC' AS bank_reference,
  CAST(o_orderkey * 3 AS STRING) AS customer_reference
FROM {{orders}}"""
    q["bank_transactions"] = f"""
SELECT o_orderkey * 10 AS id, {bank_day} AS date, {_account(1)} AS bank_account,
  {_pick("o_custkey", ["'ach'", "'wire'", "'check'"])} AS payment_method,
  {_pick("o_orderkey", ["'ACH Credit'", "'ACH Debit'", "'Wire'"])} AS type_description,
  CASE WHEN {is_debit} THEN {total} END AS debit_amount,
  CASE WHEN {is_debit} THEN NULL ELSE {total} END AS credit_amount,
  CASE WHEN {is_debit} THEN {total} ELSE -{total} END AS signed_amount
FROM {{orders}}"""
    q["fct_bank_transaction"] = f"""
SELECT {_account(1)} AS bank_account, {_account(2)} AS origination_account_id,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus <> 'P' END AS reconcile_flag,
  {bank_day} AS transaction_date, CASE WHEN {is_debit} THEN {total} ELSE -{total} END AS transaction_signed_amount
FROM {{orders}}"""
    q["payment_record_reconciliation_groups"] = f"""
SELECT o_orderkey AS payment_record_id, {d["each"]("o_orderkey", "o_orderkey - o_orderkey % 4")} AS reconciliation_group_id
FROM {{orders}}"""
    q["reconciliation_groups"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'inactive' ELSE 'active' END AS state FROM {orders}"""
    q["bank_transaction_reconciliation_groups"] = """
SELECT o_orderkey * 10 AS bank_transaction_id, o_orderkey AS reconciliation_group_id FROM {orders}"""
    q["accounting_cash_je_listing"] = f"""
SELECT 'JE' || CAST(o_orderkey AS STRING) AS je_number,
  CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey * 10 + 5 AS STRING)
    ELSE CAST(CASE WHEN o_orderkey % 7 = 1 THEN o_orderkey * 10 - 10 ELSE o_orderkey * 10 END AS STRING)
    END AS bank_transaction_id,
  CAST({_account(2)} AS STRING) AS origination_account_id,
  CASE WHEN {is_debit} THEN {d["money"](total)} ELSE '(' || {d["money"](total)} || ')' END AS net_usd_amount,
  CASE o_orderkey % 5 WHEN 0 THEN {d["mdy4"]("bank_day")} WHEN 1 THEN {d["serial"]("bank_day")} WHEN 2 THEN ''
    ELSE {d["mdy2"]("bank_day")} END AS bank_transaction_date
FROM (SELECT *, {bank_day} AS bank_day FROM {{orders}}) AS dated"""
    q["origination_banks"] = """
SELECT n_nationkey AS id, CASE WHEN n_nationkey % 11 = 10 THEN NULL ELSE 'Bank ' || n_name END AS name FROM {nation}"""
    q["origination_accounts"] = """
SELECT n_nationkey + 1 AS id, CASE n_nationkey % 3 WHEN 0 THEN 'operations' WHEN 1 THEN 'wire_in' ELSE 'recovery' END AS purpose,
  n_nationkey AS origination_bank_id
FROM {nation}"""
    q["dim_origination_account"] = f"""
SELECT s_suppkey AS origination_account_id, 'Bank ' || CAST(s_nationkey AS STRING) AS origination_bank_name,
  CASE WHEN s_suppkey % 9 = 8 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'operations' ELSE 'wire_in' END AS account_purpose,
  CASE s_suppkey % 2 WHEN 0 THEN 'checking' ELSE 'savings' END AS account_type,
  CAST(DATE '2018-01-01' + CAST(s_suppkey % 1000 AS INT) AS {ts}) AS account_effective_from_ts,
  s_acctbal < 0 AS closed_flag
FROM {{supplier}}"""
    q["dim_origination_account_restricted"] = """
SELECT CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE s_suppkey END AS origination_account_id,
  '900' || CAST(s_suppkey AS STRING) AS routing_number, '5550' || CAST(s_suppkey AS STRING) AS account_number
FROM {supplier}"""

    # -- cheques, transfers, penalties --------------------------------------------------
    q["check_payments"] = f"""
SELECT o_orderkey AS id, CAST(o_orderkey + 1000 AS STRING) AS number, 'Check ' || o_orderpriority AS description,
  {total} AS amount, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE NULL END AS payment_direction,
  {day} AS payment_date, {day} + 3 AS deposit_date, {day} - 1 AS print_date,
  CASE o_orderstatus WHEN 'P' THEN 'voided' ELSE 'sent' END AS processing_state
FROM {{orders}}"""
    q["check_payment_entries"] = "SELECT o_orderkey AS id, o_orderkey AS check_payment_id FROM {orders}"
    q["reconciliations"] = """
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey - o_orderkey % 10 ELSE o_orderkey END AS record_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'NachaBatch' WHEN '2-HIGH' THEN 'NachaEntryReturn'
    WHEN '3-MEDIUM' THEN 'CheckPayment' WHEN '4-NOT SPECIFIED' THEN 'CheckPaymentReturn' ELSE 'WirePayment' END AS record_type,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderkey * 10 END AS transaction_id
FROM {orders}"""
    q["nacha_entries"] = f"""
SELECT o_orderkey AS id, o_orderkey - o_orderkey % 10 AS nacha_batch_id, {total} AS amount FROM {{orders}}"""
    q["nacha_batches"] = """
SELECT nacha_batch_id AS id, nacha_batch_id - nacha_batch_id % 100 AS nacha_file_id,
  'PAYROLL ' || CAST(nacha_batch_id % 7 AS STRING) AS entry_description,
  CAST(sum(amount) AS DECIMAL(18,2)) AS total_credit, CAST(max(amount) AS DECIMAL(18,2)) AS total_debit
FROM {nacha_entries} GROUP BY nacha_batch_id"""
    q["transfer_records"] = f"""
SELECT o_orderkey * 2 + side AS id, o_custkey AS on_behalf_of_id, {day} AS date,
  CASE WHEN side = 0 THEN last_day({day})
    WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN last_day({day})
    WHEN o_custkey % 4 = 2 THEN last_day({day}) + 3 ELSE last_day({day}) + 10 END AS bank_transaction_date,
  CASE WHEN side = 0 THEN 'Chase operations' ELSE 'PNC operations' END AS bank_account,
  CASE WHEN o_orderkey % 19 = 0 THEN 29 WHEN side = 0 THEN 3 ELSE 16 END AS origination_account_id,
  CASE WHEN side = 0 THEN 'NachaEntry' ELSE 'ElectronicEntry' END AS transmission_type,
  CASE WHEN side = 0 THEN -{total} ELSE {total} END AS signed_amount,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {total} END AS payment_record_entries_sum,
  o_orderkey % 23 <> 0 AS reconciled
FROM (SELECT *, {d["each"]("0", "1")} AS side FROM {{orders}}) AS both_sides"""
    q["transfer_entries"] = f"""
SELECT o_orderkey * 2 + side AS payment_record_id,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey END AS event_id, 'Transfer' AS event_type,
  CASE o_orderkey % 3 WHEN 0 THEN 'Balance Transfer' WHEN 1 THEN 'Internal Transfer' ELSE 'Balance Transfer' END
    AS transaction_category
FROM (SELECT o_orderkey, {d["each"]("0", "1")} AS side FROM {{orders}}) AS both_sides"""
    q["penalty_groups"] = f"""
SELECT c_custkey AS id, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_custkey END AS penalty_case_id,
  CAST(DATE '2023-01-01' + CAST(c_custkey % 300 AS INT) AS {ts}) AS created_at,
  CASE c_custkey % 2 WHEN 0 THEN 'agency' ELSE 'company' END AS pay_to
FROM {{customer}}"""
    q["penalty_cases"] = """
SELECT c_custkey AS id, c_nationkey AS agent_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Case #ATO takeover' ELSE 'Late filing' END AS title,
  CASE c_custkey % 3 WHEN 0 THEN 'late' WHEN 1 THEN 'missing' ELSE 'wrong' END AS error_type,
  CAST(c_custkey % 4 + 1 AS INT) AS quarter, CAST(2020 + c_custkey % 4 AS INT) AS year
FROM {customer}"""
    q["agents"] = """
SELECT n_nationkey AS id, n_name AS name, CASE n_regionkey WHEN 0 THEN 'State tax agency' WHEN 1 THEN 'Federal tax agency'
  WHEN 2 THEN 'Benefits Payment agency' WHEN 3 THEN NULL ELSE 'Other agency' END AS agent_payment_type
FROM {nation}"""
    q["penalty_entries"] = f"""
SELECT o_orderkey AS id, o_custkey AS penalty_group_id, o_custkey AS company_id,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey END AS penalized_agent_payment_id,
  {total} AS penalty_amount, CAST({total} * CAST(0.05 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS interest_amount
FROM {{orders}}"""
    q["penalty_transmissions"] = """
SELECT o_orderkey AS penalty_entry_id, o_orderkey AS transmission_id,
  CASE o_custkey % 4 WHEN 0 THEN 'NachaEntry' WHEN 1 THEN 'NachaEntryReturn' WHEN 2 THEN 'CheckPayment'
    ELSE 'CheckPaymentEntryReturn' END AS transmission_type
FROM {orders}"""
    # One key column per record type, most of them NULL, as the penalty report builds them.
    q["penalty_keys"] = """
SELECT penalty_entry_id,
  CASE WHEN transmission_type = 'NachaEntry' THEN transmission_id - transmission_id % 10 END AS batch_id,
  CASE WHEN transmission_type IN ('NachaEntryReturn', 'CheckPayment') THEN transmission_id END AS return_id,
  CASE WHEN transmission_type IN ('CheckPayment', 'NachaEntryReturn') THEN transmission_id END AS check_id,
  CASE WHEN transmission_type = 'CheckPaymentEntryReturn' THEN transmission_id END AS check_return_id
FROM {penalty_transmissions}"""

    # -- receivables and bad debt ---------------------------------------------------------
    sums = ", ".join(
        f"sum(CASE WHEN bank_transaction_date <= DATE '{end}' THEN balance END) AS b{n}"
        for n, (end, _) in enumerate(PERIODS)
    )
    q["event_totals"] = f"""
SELECT event_id, transaction_category, min(pr_on_behalf_of_id) AS owner, {sums}
FROM {{accounting_balance_history}}
WHERE event_id IS NOT NULL AND transaction_category IS NOT NULL
GROUP BY event_id, transaction_category"""
    dated = " UNION ALL ".join(
        f"SELECT event_id, transaction_category, owner, CAST(b{n} AS DECIMAL(18,2)) AS balance, {n} AS period_no, "
        f"DATE '{end}' AS bank_transaction_date, DATE '{snap}' AS snapshot_date FROM {{event_totals}}"
        for n, (end, snap) in enumerate(PERIODS)
    )
    # Small balances stay out of the snapshot; they become the unexplained events.
    q["recovery_receivable_cases"] = f"""
SELECT snapshot_date, bank_transaction_date, CAST(event_id AS STRING) || '-' || transaction_category AS id_category_concat,
  event_id, CASE WHEN event_id % 53 = 0 THEN NULL ELSE owner END AS company_id,
  {event_type.format(k="event_id")} AS event_type, transaction_category,
  event_id * 10 + length(transaction_category) % 10 AS pi_id, pi_status, pi_category,
  CAST((event_id * 13) % 260 AS INT) AS pi_age_in_days,
  CASE WHEN (event_id * 13) % 260 >= 90 THEN 'y' ELSE 'n' END AS accounting_to_reserve,
  CASE WHEN event_id % 59 = 0 THEN NULL WHEN current_balance >= 0 THEN 'RecoveryReceivable_SuccessfullyRecoveredAfterPeriodEnd'
    WHEN pi_status IN ('false_positive', 'awaiting_external_dependency') THEN 'NotRecovery_FalsePositive'
    WHEN pi_status = 'awaiting_bad_debt_funds' THEN 'NotRecovery_writtenoff_pendingcorptransfer'
    WHEN (event_id * 13) % 260 >= 90 THEN 'RecoveryReceivable_>90d' ELSE 'RecoveryReceivable_<90d' END
    AS accounting_status_mapping,
  {_pick("event_id", ["'Fraud'", "'Credit'", None, "'Other'", "'Other'", "'Product'"])} AS accounting_pi_category,
  balance, current_balance
FROM (
  SELECT *, CAST(CASE WHEN event_id % 2 = 0 THEN balance + 60000 ELSE balance END AS DECIMAL(18,2)) AS current_balance,
    {_pick("(event_id + period_no)", ["'recovered'", "'awaiting_bad_debt_funds'", "'open'", "'awaiting_external_dependency'", "'in_progress'", "'false_positive'", None])} AS pi_status,
    {_pick("event_id", ["'micro variance'", None, "'fraud'", "'expedited'", "'other'"])} AS pi_category
  FROM ({dated}) AS dated
) AS cases
WHERE balance < -20000"""
    # Some keys have a second case, of which some are closed.
    q["recovery_receivable_snapshot"] = """
SELECT * FROM {recovery_receivable_cases} UNION ALL
SELECT snapshot_date, bank_transaction_date, id_category_concat, event_id, company_id, event_type, transaction_category,
  pi_id + 1000000000 AS pi_id, CASE WHEN event_id % 2 = 0 THEN 'recovered' ELSE pi_status END AS pi_status, pi_category, pi_age_in_days,
  accounting_to_reserve, accounting_status_mapping, accounting_pi_category, balance, current_balance
FROM {recovery_receivable_cases} WHERE event_id % 8 IN (1, 2)"""
    # One key has up to two flags, one of which may be missing.
    q["recovery_receivable_credit_delinquencies_snapshot"] = """
SELECT snapshot_date, CASE WHEN event_id % 10 = 0 THEN NULL ELSE id_category_concat END AS id_event_concat,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 = 0 END AS is_credit_loss
FROM {recovery_receivable_snapshot} UNION ALL
SELECT snapshot_date, id_category_concat, event_id % 3 <> 0 FROM {recovery_receivable_snapshot} WHERE event_id % 4 IN (0, 1)"""
    q["fct_recovery_receivable_credit_delinquency"] = """
SELECT DISTINCT id_event_concat AS event_id_debit_event_type_concat, is_credit_loss AS credit_loss_flag
FROM {recovery_receivable_credit_delinquencies_snapshot}"""
    # Cases older than the 180-day limit have a bad-debt transfer.
    q["bad_debt_transfers_snapshot"] = """
SELECT snapshot_date, bank_transaction_date - CAST(event_id % 60 AS INT) AS effective_date,
  CASE WHEN event_id % 7 < 2 THEN 'FY24' WHEN event_id % 7 < 5 THEN 'FY25' ELSE 'FY26' END AS fiscal_year_written_off,
  CASE WHEN event_id % 4 = 1 THEN 'rejected' ELSE 'pending' END AS override_status, company_id,
  pi_id AS bad_debt_id, CAST(-balance AS DECIMAL(18,2)) AS bad_debt_amount, balance AS payment_event_balance_amount,
  id_category_concat, event_id AS inv_or_event_id, event_type, transaction_category
FROM {recovery_receivable_snapshot} WHERE pi_age_in_days > 180"""
    q["fct_bad_debt_transfer"] = f"""
SELECT bad_debt_id, bad_debt_id + 1 AS approval_id, bad_debt_id + 2 AS payment_event_balance_id,
  inv_or_event_id AS event_id, company_id, effective_date - 30 AS loss_identification_date, effective_date,
  effective_date - 45 AS event_date, 'FY24' AS loss_event_fiscal_year, fiscal_year_written_off AS written_off_fiscal_year,
  transaction_category, event_type, id_category_concat AS event_id_transaction_category_concat,
  'Company ' || CAST(company_id AS STRING) AS company_name,
  {_pick("inv_or_event_id", ["'Fraud loss'", "'ATO concession'", "'Partner invoice'", "'Customer closed'", None])} AS bad_debt_reason,
  override_status, bad_debt_amount, payment_event_balance_amount,
  CAST(effective_date + 1 AS {ts}) AS bad_debt_approval_create_ts, snapshot_date
FROM {{bad_debt_transfers_snapshot}}"""
    # A version lasts until the next snapshot; the one of the second period has no end yet.
    q["fct_bad_debt_transfer_history"] = f"""
SELECT *, CAST(snapshot_date - 2 AS {ts}) AS history_effective_from_ts,
  CASE WHEN event_id % 2 = 0 THEN CAST(snapshot_date + 40 AS {ts}) ELSE CAST(DATE '9999-12-31' AS {ts}) END
    AS history_effective_to_ts
FROM {{fct_bad_debt_transfer}}"""
    q["fct_bad_debt"] = """
SELECT bad_debt_id, 'Note ' || CAST(max(snapshot_date) AS STRING) AS notes
FROM {fct_bad_debt_transfer} WHERE bad_debt_reason IS NOT NULL GROUP BY bad_debt_id"""
    q["fct_bad_debt_history"] = f"""
SELECT bad_debt_id, 'Note ' || CAST(snapshot_date AS STRING) AS notes,
  CAST(snapshot_date - 2 AS {ts}) AS history_effective_from_ts,
  CAST(snapshot_date + 90 AS {ts}) AS history_effective_to_ts
FROM {{fct_bad_debt_transfer}} WHERE bad_debt_reason IS NOT NULL"""
    q["payment_investigations"] = f"""
SELECT DISTINCT pi_id AS id, event_id, event_type, pi_category AS category, transaction_category,
  CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST(DATE '2023-10-05' - pi_age_in_days AS {ts}) END AS created_at
FROM {{recovery_receivable_snapshot}}"""
    q["payment_investigations_raw"] = """
SELECT id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'open' WHEN 2 THEN 'false_positive' WHEN 3 THEN 'awaiting_bad_debt_funds'
  WHEN 4 THEN 'awaiting_external_dependency' ELSE 'recovered' END AS status, event_id % 100 AS company_id, created_at
FROM {payment_investigations}"""
    q["payment_event_balances"] = """
SELECT id * 3 AS id, transaction_category FROM {payment_investigations}"""
    q["payment_event_balance_investigations"] = """
SELECT id AS payment_investigation_id, CASE WHEN id % 5 = 0 THEN NULL ELSE id * 3 END AS payment_event_balance_id
FROM {payment_investigations}"""
    cash = " UNION ALL ".join(
        f"SELECT *, {n} AS period_no, DATE '{end}' AS period_end, DATE '{snap}' AS snapshot_date FROM {{customer}}"
        for n, (end, snap) in enumerate(PERIODS)
    )
    q["daily_customer_cash_balances_snapshot"] = f"""
SELECT c_custkey AS company_id, CAST(CASE WHEN c_custkey % 50 = 7 THEN 0
    WHEN c_custkey % 3 = 0 THEN {money.format(x="c_acctbal")} + 100 * period_no
    ELSE {money.format(x="c_acctbal")} END AS DECIMAL(18,2)) AS balance,
  CASE WHEN c_custkey % 29 = 3 THEN period_end + 1 ELSE period_end - 30 END AS effective_from_date,
  CASE WHEN c_custkey % 2 = 0 THEN period_end ELSE period_end + 30 END AS effective_to_date, snapshot_date
FROM ({cash}) AS periods"""

    # -- admin profile ----------------------------------------------------------------------
    user = "CAST((c_custkey - c_custkey % 10) / 10 AS BIGINT)"
    q["payroll_admins"] = f"""
SELECT {user} AS user_id, c_custkey AS company_id, c_custkey % 11 <> 0 AS current_flag,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 3 <> 0 END AS primary_payroll_admin,
  c_custkey % 17 <> 0 AS can_run_payroll, c_custkey % 2 = 0 AS is_employee, c_custkey % 5 = 0 AS is_contractor,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 4 = 1 END AS is_accountant
FROM {{customer}}"""
    q["users"] = """
SELECT DISTINCT user_id AS id, 'user' || CAST(user_id AS STRING) || '@example.test' AS email FROM {payroll_admins}"""
    q["pay_schedules"] = """
SELECT o_custkey AS company_id, o_orderpriority AS pay_period,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 7 = 0 END AS is_auto_pilot, o_orderstatus <> 'P' AS is_active,
  o_orderkey % 3 <> 0 AS current_flag
FROM {orders}"""
    q["pay_period_codes"] = """
SELECT DISTINCT o_orderpriority AS pay_period, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2
  WHEN '3-MEDIUM' THEN 4 WHEN '4-NOT SPECIFIED' THEN 5 ELSE 6 END AS pay_period_num
FROM {orders}"""
    q["monthly_employees"] = """
SELECT user_id, CASE event_id % 3 WHEN 0 THEN DATE '2024-09-01' WHEN 1 THEN DATE '2024-10-01' ELSE DATE '2024-11-01' END
  AS for_month, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value > 200 END AS wallet_user
FROM {events}"""
    q["track_events"] = f"""
SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'FinishedRunningPayroll' WHEN 'click' THEN 'LoginClicked'
    WHEN 'view' THEN 'VisitedLoginPage' WHEN 'signup' THEN 'GoogleOAuth' ELSE 'Other' END AS action,
  {_pick("event_id", ["'iOS'", "'Android'", "'Mac OS X'", "'Windows'", None])} AS os_name,
  {_pick("event_id", ["'Computer'", "'Mobile'", "'Tablet'"])} AS device_type,
  CASE WHEN event_id % 40 = 0 THEN 'https://books.example.test/' WHEN event_id % 40 = 1 THEN 'https://ledger.example.test/'
    ELSE 'https://example.test/' END AS referral_url, value < 1 AS has_signed_in
FROM {{events}}"""
    q["monthly_features"] = """
SELECT o_custkey AS company_id, CASE o_orderkey % 4 WHEN 0 THEN DATE '2024-08-01' WHEN 1 THEN DATE '2024-09-01'
    WHEN 2 THEN DATE '2024-10-01' ELSE DATE '2024-11-01' END AS for_month,
  CAST(o_orderkey % 2 AS INT) AS won_indicator, CAST(o_orderkey % 20 AS INT) AS feature_key
FROM {orders}"""
    q["payroll_blockers"] = f"""
SELECT o_custkey AS company_id, o_orderpriority AS reason, CAST({day} + 300 AS {ts}) AS tx_end FROM {{orders}}"""
    q["blocker_codes"] = """
SELECT DISTINCT o_orderpriority AS payroll_blocker_desc, CASE o_orderpriority WHEN '1-URGENT' THEN 'risk'
  WHEN '2-HIGH' THEN 'onboarding' WHEN '3-MEDIUM' THEN 'onboarding' WHEN '4-NOT SPECIFIED' THEN 'risk' ELSE 'other' END
  AS payroll_blocker_type
FROM {orders}"""
    q["company_data"] = f"""
SELECT o_custkey AS company_id, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 'admin_' || CAST(o_custkey % 3 AS STRING) END
    AS payroll_admins_type,
  CASE o_orderkey % 2 WHEN 0 THEN DATE '2024-11-01' ELSE DATE '2024-10-01' END AS for_month,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST({day} AS {ts}) END AS joined_at,
  CAST(o_orderkey % 50 AS INT) AS number_of_payroll_employees, CAST(o_orderkey % 8 AS INT) AS number_of_payroll_contractors,
  CAST(o_orderkey % 30 AS INT) AS hourly_employees, CAST(o_orderkey % 20 AS INT) AS salary_employees
FROM {{orders}}"""
    q["company_product_tiers"] = f"""
SELECT c_custkey AS company_id, {_pick("c_nationkey", ["'simple'", "'plus'", "'premium'"])} AS plan_name,
  c_custkey % 3 <> 1 AS current_flag,
  CASE WHEN c_custkey % 8 = 0 THEN CAST(DATE '2024-06-30' AS {ts}) ELSE CAST(DATE '9999-12-31' AS {ts}) END AS effect_end_dt
FROM {{customer}}"""
    q["monthly_company_payrolls"] = """
SELECT o_custkey AS company_id, CASE o_orderkey % 4 WHEN 0 THEN DATE '2024-08-01' WHEN 1 THEN DATE '2024-09-01'
    WHEN 2 THEN DATE '2024-10-01' ELSE DATE '2024-11-01' END AS created_month,
  CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE CAST(o_orderkey % 3 + 1 AS INT) END AS number_of_regular_payrolls,
  CAST(o_orderkey % 4 AS INT) AS number_of_irregular_payrolls
FROM {orders}"""
    q["partner_companies"] = """
SELECT c_custkey AS company_id, c_mktsegment = 'HOUSEHOLD' AS is_active_er_today FROM {customer}"""
    return q


SPARK_SQL = definitions(dialects.SPARK)
DUCKDB_SQL = definitions(dialects.DUCKDB)

# Grouped tables that many branches of others read, each with other columns or filters, so Spark would group once for each.
GROUPED_ONCE = ("event_totals", "payment_investigations")


def _sources_of(sql: str, names) -> list[str]:
    return [name for name in names if "{" + name + "}" in sql]


class Tables:
    """Fixture tables of one data folder as DataFrames: ``tables.payment_records``.

    All are lazy but ``GROUPED_ONCE``, which go through the scratch folder: grouped when first asked for, then read.
    """

    def __init__(self, spark: SparkSession, folder: str, stored: str | None = None):
        """``stored`` names a database that holds the fixtures as tables."""
        self.spark = spark
        self.folder = folder
        self.stored = stored
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._load(name)
        return self._known[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return table_scan(self.spark, name, self.folder)
        if self.stored:
            return table_scan(self.spark, f"{self.stored}.{name}")
        sql = SPARK_SQL[name]
        sources = _sources_of(sql, (*BASE_TABLES, *SPARK_SQL))
        derived = self.spark.sql(sql, **{source: getattr(self, source) for source in sources})
        if name not in GROUPED_ONCE:
            return derived
        path = f"{scratch_folder(self.spark)}/{name}"
        derived.write.parquet(path)
        return self.spark.read.schema(derived.schema).parquet(path)


def store(spark: SparkSession, folder: str, database: str, location: str) -> None:
    """Save every fixture as a table of a database, dated tables partitioned by their date."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    derived = Tables(spark, folder)
    files = spark.sparkContext.defaultParallelism

    def save(name: str) -> None:
        table = getattr(derived, name)
        dated = "snapshot_date" in table.columns and name.endswith("_snapshot")
        partitions = ["snapshot_date"] if dated else []
        write_table(table.repartition(files), f"{database}.{name}", partition_by=partitions)

    for name in GROUPED_ONCE:
        getattr(derived, name)
    with ThreadPoolExecutor(4) as jobs:
        list(jobs.map(save, SPARK_SQL))


def with_fixtures(sql: str) -> str:
    """Put the fixtures that a DuckDB statement names as ``{name}`` in front of it."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for source in _sources_of(text, DUCKDB_SQL):
            if source not in needed:
                visit(DUCKDB_SQL[source])
                needed[source] = None

    def plain(text: str) -> str:
        for source in (*BASE_TABLES, *DUCKDB_SQL):
            text = text.replace("{" + source + "}", source)
        return text.strip()

    visit(sql)
    body = plain(sql)
    ctes = ",\n".join(f"{name} AS (\n{plain(DUCKDB_SQL[name])}\n)" for name in needed)
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
