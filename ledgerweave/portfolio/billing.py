"""Contracts of the billing tables that are declared next to the portfolio.

Fixed values, as in the portfolio contracts. No question is asked of these
tables; they can be loaded and checked.
"""

from __future__ import annotations

from ledgerweave.portfolio.contracts import CREATED
from ledgerweave.schema import AREA, DAY, FLAG, INT, LONG, MONEY, TEXT, Field, TableContract

SEGMENTS = ("startup", "smb", "mid_market", "enterprise")
ACCOUNT = Field(
    "customer_account_id",
    LONG,
    required=True,
    references=("customer_account", "customer_account_id"),
)


def _paid(name: str = "amount", **rules) -> Field:
    return Field(name, MONEY, required=True, **rules)


CUSTOMER_ACCOUNT = TableContract(
    "customer_account",
    (
        Field("customer_account_id", LONG, key=True),
        Field("account_name", TEXT, required=True),
        Field("created_date", DAY, required=True),
        Field("country_code", TEXT, required=True),
        Field("customer_segment", TEXT, required=True, one_of=SEGMENTS),
        Field(
            "billing_status",
            TEXT,
            required=True,
            one_of=("trial", "active", "past_due", "cancelled"),
        ),
        _paid("mrr_amount", default=0),
        Field("is_active", FLAG, required=True),
        Field("churned_at", DAY),
    ),
)

SUBSCRIPTION = TableContract(
    "subscription",
    (
        Field("subscription_id", LONG, key=True),
        ACCOUNT,
        Field("plan_code", TEXT, required=True),
        Field("billing_interval", TEXT, required=True, one_of=("monthly", "annual")),
        Field("start_date", DAY, required=True),
        Field("end_date", DAY),
        Field("status", TEXT, required=True, one_of=("trial", "active", "past_due", "cancelled")),
        _paid("monthly_price"),
        CREATED,
    ),
    ordered=(("start_date", "end_date"),),
)

INVOICE = TableContract(
    "invoice",
    (
        Field("invoice_id", LONG, key=True),
        Field(
            "subscription_id",
            LONG,
            required=True,
            references=("subscription", "subscription_id"),
        ),
        ACCOUNT,
        Field("invoice_date", DAY, required=True),
        Field("due_date", DAY, required=True),
        Field("paid_date", DAY),
        Field("status", TEXT, required=True, one_of=("issued", "paid", "past_due", "void")),
        _paid("gross_amount"),
        _paid("tax_amount"),
        _paid("discount_amount", default=0),
        _paid("net_amount"),
        Field("currency_code", TEXT, required=True),
    ),
    ordered=(("invoice_date", "due_date"), ("invoice_date", "paid_date")),
)

PAYMENT = TableContract(
    "payment",
    (
        Field("payment_id", LONG, key=True),
        Field("invoice_id", LONG, required=True, references=("invoice", "invoice_id")),
        ACCOUNT,
        Field("payment_date", DAY, required=True),
        Field("payment_method", TEXT, required=True, one_of=("card", "bank_transfer", "wallet")),
        Field("payment_status", TEXT, required=True, one_of=("captured", "failed", "reversed")),
        _paid(),
    ),
)

REFUND = TableContract(
    "refund",
    (
        Field("refund_id", LONG, key=True),
        Field("payment_id", LONG, required=True, references=("payment", "payment_id")),
        ACCOUNT,
        Field("refund_date", DAY, required=True),
        Field(
            "reason_code",
            TEXT,
            required=True,
            one_of=("service_issue", "fraud", "duplicate_charge", "goodwill", "other"),
        ),
        _paid(),
    ),
)

PRODUCT_USAGE_DAILY = TableContract(
    "product_usage_daily",
    (
        Field("usage_date", DAY, required=True, key=True),
        Field(
            "customer_account_id",
            LONG,
            required=True,
            key=True,
            references=("customer_account", "customer_account_id"),
        ),
        Field("active_users", INT, required=True, non_negative=True),
        Field("api_calls", LONG, required=True, non_negative=True),
        Field("storage_gb", AREA, required=True, non_negative=True),
    ),
)

MARKETING_CAMPAIGN_SPEND = TableContract(
    "marketing_campaign_spend",
    (
        Field("campaign_day", DAY, required=True, key=True),
        Field("campaign_id", LONG, required=True, key=True),
        Field(
            "channel",
            TEXT,
            required=True,
            one_of=("search", "social", "affiliate", "email", "display"),
        ),
        Field("segment", TEXT, required=True, one_of=SEGMENTS),
        _paid("spend_amount", non_negative=True),
        Field("attributed_signups", INT, required=True, non_negative=True),
        _paid("attributed_revenue", non_negative=True),
    ),
)

SEGMENT_MEMBERSHIP_HISTORY = TableContract(
    "segment_membership_history",
    (
        Field("segment_membership_id", LONG, key=True),
        ACCOUNT,
        Field("segment_name", TEXT, required=True, one_of=SEGMENTS),
        Field("valid_from", DAY, required=True),
        Field("valid_to", DAY),
        Field("assigned_reason", TEXT),
    ),
    ordered=(("valid_from", "valid_to"),),
)

BILLING = {
    c.name: c
    for c in (
        CUSTOMER_ACCOUNT,
        SUBSCRIPTION,
        INVOICE,
        PAYMENT,
        REFUND,
        PRODUCT_USAGE_DAILY,
        MARKETING_CAMPAIGN_SPEND,
        SEGMENT_MEMBERSHIP_HISTORY,
    )
}
