"""Profile of payroll admins and their companies."""

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook import constants as K
from tallybook.functions.dates import months_crossed
from tallybook.functions.labels import mapped_label, none_of, yn_flag
from tallybook.operators.filters import not_in_subquery


@dataclass(frozen=True)
class ProfileTables:
    payroll_admins: DataFrame
    companies: DataFrame
    users: DataFrame
    pay_schedules: DataFrame
    pay_period_codes: DataFrame
    monthly_employees: DataFrame
    events_90_days: DataFrame
    events_7_days: DataFrame
    monthly_features: DataFrame
    payroll_blockers: DataFrame
    blocker_codes: DataFrame
    company_data: DataFrame
    company_product_tiers: DataFrame
    monthly_company_payrolls: DataFrame
    partner_companies: DataFrame


def code_label(code: Column) -> Column:
    """Label of the smallest schedule code of a group."""
    return mapped_label(F.min(code), K.PAY_PERIOD_LABELS)


def distinct_where(condition: Column, value: Column) -> Column:
    return F.countDistinct(F.when(condition, value))


def pay_schedule_summary(schedules: DataFrame, codes: DataFrame) -> DataFrame:
    """Shortest schedule, number of schedules and autopilot flag per company."""
    active = schedules.filter(F.col("is_active") & F.col("current_flag"))
    return (
        active.join(codes.withColumnRenamed("pay_period", "_code"), F.col("pay_period") == F.col("_code"), "inner")
        .groupBy(F.col("company_id").alias("_schedule_company"))
        .agg(
            code_label(F.col("pay_period_num")).alias("shortest_pay_period"),
            F.countDistinct("pay_period").alias("pay_period_ct"),
            yn_flag(F.max(F.coalesce(F.col("is_auto_pilot"), F.lit(False)))).alias("has_auto_pilot"),
        )
    )


def wallet_users(monthly_employees: DataFrame) -> DataFrame:
    """Distinct wallet users of the latest month."""
    latest = monthly_employees.agg(F.max("for_month")).scalar()
    return (
        monthly_employees.filter((F.col("for_month") == latest) & F.col("wallet_user"))
        .select(F.col("user_id").alias("_wallet_user"))
        .distinct()
    )


def finish_summary(events: DataFrame) -> DataFrame:
    """Devices behind the finished payrolls of each user.

    Distinct events come in two levels, the rows of an event and the events of a user, so that no count of distinct
    values multiplies rows. A user's device types are a handful of values.
    """
    of_event = ["_user", "event_id"]
    distinct = (
        events.filter((F.col("action") == "FinishedRunningPayroll") & F.col("user_id").isNotNull())
        .select(F.col("user_id").alias("_user"), "event_id", "os_name", "device_type")
        .distinct()
    )
    computer = F.col("device_type") == "Computer"
    mobile = F.col("device_type").isin(list(K.MOBILE_DEVICES))
    by_event = distinct.groupBy(*of_event).agg(
        F.collect_set("device_type").alias("devices"),
        F.max(F.when(F.col("os_name") == "iOS", 1).otherwise(0)).alias("has_ios"),
        F.max(F.when(F.col("os_name") == "Android", 1).otherwise(0)).alias("has_android"),
        F.count(F.when(computer, 1)).alias("computer_rows"),
        F.count(F.when(mobile, 1)).alias("mobile_rows"),
    )
    named = F.col("event_id").isNotNull()
    return by_event.groupBy("_user").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("devices")))).cast("long").alias("device_ct"),
        F.max("has_ios").alias("has_ios"),
        F.max("has_android").alias("has_android"),
        F.count("event_id").alias("payroll_ct"),
        F.count(F.when(named & (F.col("computer_rows") > 0), 1)).alias("computer_ct"),
        F.count(F.when(named & (F.col("mobile_rows") > 0), 1)).alias("mobile_ct"),
        F.sum("computer_rows").alias("computer_login_flg"),
        F.sum("mobile_rows").alias("mobile_login_flg"),
    )


def device_summary(events: DataFrame, admins: DataFrame, companies: DataFrame) -> DataFrame:
    """Devices behind finished payrolls per primary admin and active company.

    All companies of an admin see the same events, so these are summed up per user before companies come in. The
    log-in flags count the same distinct finish events, as the profile defines them.
    """
    primary = admins.filter(F.col("current_flag") & F.col("primary_payroll_admin")).select("user_id", "company_id")
    active = companies.filter(F.col("is_active")).select(F.col("id").alias("_company"))
    pairs = primary.join(active, F.col("company_id") == F.col("_company"), "inner").select(
        F.col("user_id").alias("_device_user"), F.col("company_id").alias("_device_company")
    )
    finished = finish_summary(events)
    return pairs.distinct().join(finished, F.col("_device_user") == F.col("_user"), "inner").drop("_user")


def time_tracking_companies(features: DataFrame, months: Sequence[datetime.date]) -> DataFrame:
    won = features.filter(
        F.col("for_month").between(F.lit(min(months)), F.lit(max(months)))
        & (F.col("won_indicator") == 1)
        & F.col("feature_key").isin(list(K.TIME_TRACKING_FEATURES))
    )
    return won.select(F.col("company_id").alias("_tracking_company")).distinct()


def blocker_summary(blockers: DataFrame, codes: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Distinct open onboarding and risk blockers per company."""
    named = blockers.filter(F.col("tx_end") > F.lit(as_of)).join(
        codes, F.col("reason") == F.col("payroll_blocker_desc"), "inner"
    )
    kind = F.col("payroll_blocker_type")
    return named.groupBy(F.col("company_id").alias("_blocked_company")).agg(
        distinct_where(kind == "onboarding", F.col("reason")).alias("payroll_onboarding_blocker_ct"),
        distinct_where(kind == "risk", F.col("reason")).alias("payroll_risk_blocker_ct"),
    )


def company_sizes(company_data: DataFrame, month: datetime.date) -> DataFrame:
    rows = company_data.filter((F.col("for_month") == F.lit(month)) & F.col("joined_at").isNotNull())
    return rows.groupBy(F.col("company_id").alias("_data_company"), "payroll_admins_type").agg(
        F.max("number_of_payroll_employees").alias("number_active_employees"),
        F.max("number_of_payroll_contractors").alias("number_active_contractors"),
        F.max("hourly_employees").alias("number_hourly_employees"),
        F.max("salary_employees").alias("number_salary_employees"),
    )


def current_plans(tiers: DataFrame, as_of: datetime.datetime) -> DataFrame:
    return (
        tiers.filter(F.col("current_flag") & (F.col("effect_end_dt") > F.lit(as_of)))
        .select(F.col("company_id").alias("_plan_company"), F.col("plan_name").alias("product_plan"))
        .distinct()
    )


def payroll_history(payrolls: DataFrame, months: Sequence[datetime.date]) -> DataFrame:
    """Average and sum over the months, and whether the regular count never changed."""
    regular = F.col("number_of_regular_payrolls")
    return (
        payrolls.filter(F.col("created_month").isin(list(months)))
        .groupBy(F.col("company_id").alias("_history_company"))
        .agg(
            F.avg(regular).alias("regular_payrolls_3m_avg"),
            yn_flag(F.min(regular) == F.max(regular)).alias("payroll_schedule_is_consistent"),
            F.sum("number_of_irregular_payrolls").alias("irregular_payroll_ct_3m"),
        )
    )


def third_party_users(events: DataFrame, referrers: Sequence[str]) -> DataFrame:
    """Users who signed in through another provider, or came from one of the referrers to a login page."""
    action = F.col("action")
    referred = action.isin(list(K.LOGIN_PAGE_ACTIONS)) & F.col("referral_url").isin(list(referrers))
    return (
        events.filter(((action == "GoogleOAuth") | referred) & F.col("has_signed_in"))
        .select(F.col("user_id").alias("_third_party_user"))
        .distinct()
    )


def payroll_admin_profile(
    tables: ProfileTables,
    months: Sequence[datetime.date],
    as_of: datetime.datetime,
    referrers: Sequence[str],
    excluded_companies: Sequence[int] = (),
) -> DataFrame:
    """One row per current admin and company with the attributes of ten summaries.

    Joins on the company come first and those on the user last, so the wide row moves
    between the two keys once.
    """
    companies = tables.companies.filter(
        F.col("current_flag")
        & F.col("is_active")
        & F.col("joined_at").isNotNull()
        & none_of(F.col("id"), excluded_companies)
    ).select(
        F.col("id").alias("_company"), F.col("name").alias("company_name"), "accounting_firm_id",
        "industry_classification", "industry_title", F.col("filing_state").alias("company_state"), "joined_at",
        "median_payroll_net_pay",
    )
    admins = tables.payroll_admins.filter(F.col("current_flag") & F.col("can_run_payroll")).select(
        "user_id", "company_id", "primary_payroll_admin", "is_employee", "is_contractor", "is_accountant"
    )
    partners = tables.partner_companies.filter(F.col("is_active_er_today")).select("company_id")
    admins = not_in_subquery(admins, "company_id", partners)
    latest_month = max(months)
    by_company = [
        (pay_schedule_summary(tables.pay_schedules, tables.pay_period_codes), "_schedule_company"),
        (blocker_summary(tables.payroll_blockers, tables.blocker_codes, as_of), "_blocked_company"),
        (company_sizes(tables.company_data, latest_month), "_data_company"),
        (time_tracking_companies(tables.monthly_features, months), "_tracking_company"),
        (current_plans(tables.company_product_tiers, as_of), "_plan_company"),
        (payroll_history(tables.monthly_company_payrolls, months), "_history_company"),
    ]
    full = admins.join(companies, F.col("company_id") == F.col("_company"), "inner")
    for summary, key in by_company:
        full = full.join(summary, F.col("company_id") == F.col(key), "left")
    devices = device_summary(tables.events_90_days, tables.payroll_admins, tables.companies)
    same_admin = (F.col("user_id") == F.col("_device_user")) & (F.col("company_id") == F.col("_device_company"))
    users = tables.users.select(F.col("id").alias("_account"), "email")
    full = (
        full.join(devices, same_admin, "left")
        .join(users, F.col("user_id") == F.col("_account"), "inner")
        .join(wallet_users(tables.monthly_employees), F.col("user_id") == F.col("_wallet_user"), "left")
        .join(third_party_users(tables.events_7_days, referrers), F.col("user_id") == F.col("_third_party_user"), "left")
    )
    return full.select(
        "user_id",
        "email",
        "company_id",
        "company_name",
        "accounting_firm_id",
        "industry_classification",
        "industry_title",
        "shortest_pay_period",
        "pay_period_ct",
        "company_state",
        months_crossed(F.col("joined_at"), F.lit(as_of)).alias("company_age_months"),
        "median_payroll_net_pay",
        yn_flag(F.col("primary_payroll_admin")).alias("is_primary_payroll_admin"),
        yn_flag(F.col("is_employee")).alias("is_employee"),
        yn_flag(F.col("is_contractor")).alias("is_contractor"),
        yn_flag(F.col("is_accountant")).alias("is_accountant"),
        yn_flag(F.col("_wallet_user").isNotNull()).alias("is_wallet_user"),
        "device_ct",
        yn_flag(F.col("has_ios") > 0).alias("has_ios"),
        yn_flag(F.col("has_android") > 0).alias("has_android"),
        "payroll_ct",
        "computer_ct",
        "mobile_ct",
        "payroll_onboarding_blocker_ct",
        "payroll_risk_blocker_ct",
        "payroll_admins_type",
        "has_auto_pilot",
        "mobile_login_flg",
        "computer_login_flg",
        yn_flag(F.col("_tracking_company").isNotNull()).alias("has_time_tracking"),
        "number_active_employees",
        "number_active_contractors",
        "number_hourly_employees",
        "number_salary_employees",
        "product_plan",
        "regular_payrolls_3m_avg",
        "payroll_schedule_is_consistent",
        "irregular_payroll_ct_3m",
        yn_flag(F.col("_third_party_user").isNotNull()).alias("uses_third_party_login"),
    ).distinct()
