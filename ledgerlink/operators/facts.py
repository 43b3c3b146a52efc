"""Bank rows and orders as facts of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_decimal, signed_amount
from ..functions.text import fact_id, join_text
from ..functions.times import extract_date

# Names under which platforms appear, tried in this order.
PLATFORMS = {"taobao": ["taobao", "淘宝", "天猫", "tmall"], "pdd": ["pdd", "拼多多"], "jd": ["jd", "京东"], "meituan": ["meituan", "美团", "大众点评"]}
# Words of payment channels, tried in this order.
CHANNELS = {"alipay": ["支付宝", "alipay"], "wechat_pay": ["微信", "wechat", "财付通"], "jd_pay": ["京东支付", "jd pay"], "meituan_credit": ["美团月付"]}
REFUND_WORDS = ("退款", "退货", "refund")


def first_named(text: Column, names: dict[str, list[str]], otherwise: str) -> Column:
    """The first name one of whose words occurs in the text, whatever its case."""
    low, out = F.lower(text), None
    for name, words in names.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def infer_platform(text: Column, names: dict[str, list[str]] | None = None) -> Column:
    return first_named(text, names or PLATFORMS, "")


def payment_channel(text: Column, names: dict[str, list[str]] | None = None) -> Column:
    return first_named(text, names or CHANNELS, "bank_card")


def business_type(direction: Column, text: Column) -> Column:
    refund = F.lit(False)
    for w in REFUND_WORDS:
        refund = refund | text.contains(w)
    return F.when(direction == "outflow", "expense").when((direction == "inflow") & refund, "refund").when(direction == "inflow", "income").otherwise("unknown")


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def bank_facts(bank: DataFrame, source_id: Column) -> DataFrame:
    """One fact per bank row; amount may be text or decimal. The time falls back to posting date and dates in texts."""
    amount = F.col("amount") if dict(bank.dtypes)["amount"].startswith("decimal") else parse_decimal(F.col("amount"))
    text = join_text(_text(bank, "merchant"), _text(bank, "counterparty"), _text(bank, "summary"), _text(bank, "channel"))
    direction = F.col("direction")
    time = F.coalesce(*[F.nullif(x, F.lit("")) for x in (_text(bank, "transaction_time"), _text(bank, "posting_date"), extract_date(_text(bank, "summary")), extract_date(_text(bank, "raw_line")))], F.lit(""))
    warned = F.col("warnings") if "warnings" in bank.columns else F.array().cast("array<string>")
    return bank.select(
        F.col("pos"), fact_id(F.lit("bank_transaction"), source_id).alias("fact_id"), F.lit("bank_transaction").alias("source_type"), source_id.alias("source_id"),
        F.when(direction == "outflow", "bank_payment").otherwise("bank_money_movement").alias("fact_type"), business_type(direction, text).alias("business_type"),
        time.alias("occurrence_time"), F.abs(amount).cast("decimal(18,2)").alias("amount"), signed_amount(amount, direction).cast("decimal(18,2)").alias("signed_amount"), direction.alias("direction"),
        _text(bank, "bank_key").alias("source_system"), (F.col("platform") if "platform" in bank.columns else infer_platform(text)).alias("platform"), payment_channel(text).alias("payment_channel"),
        _text(bank, "merchant").alias("merchant"), _text(bank, "counterparty").alias("counterparty"), F.lit("").alias("title"), _text(bank, "summary").alias("summary"),
        (F.col("confidence") if "confidence" in bank.columns else F.lit(0.5)).cast("double").alias("confidence"),
        F.array_sort(F.array_distinct(F.concat(warned, F.when(direction == "unknown", F.array(F.lit("unknown_money_direction"))).otherwise(F.array().cast("array<string>"))))).alias("warnings"),
    )


def order_facts(orders: DataFrame, source_id: Column) -> DataFrame:
    amount = F.col("paid_amount") if dict(orders.dtypes)["paid_amount"].startswith("decimal") else parse_decimal(F.col("paid_amount"))
    time = _text(orders, "order_time")
    warned = F.col("warnings") if "warnings" in orders.columns else F.array().cast("array<string>")
    return orders.select(
        F.col("pos"), fact_id(F.lit("platform_order"), source_id).alias("fact_id"), F.lit("platform_order").alias("source_type"), source_id.alias("source_id"),
        F.lit("order_purchase").alias("fact_type"), F.lit("expense").alias("business_type"), time.alias("occurrence_time"),
        amount.cast("decimal(18,2)").alias("amount"), (-F.abs(amount)).cast("decimal(18,2)").alias("signed_amount"), F.when(amount.isNotNull(), "outflow").otherwise("unknown").alias("direction"),
        _text(orders, "platform").alias("source_system"), _text(orders, "platform").alias("platform"), F.lit("unknown").alias("payment_channel"),
        _text(orders, "merchant").alias("merchant"), F.lit("").alias("counterparty"), _text(orders, "title").alias("title"),
        join_text(_text(orders, "merchant"), _text(orders, "title"), _text(orders, "spec")).alias("summary"),
        (F.col("confidence") if "confidence" in orders.columns else F.lit(0.5)).cast("double").alias("confidence"),
        F.array_sort(F.array_distinct(F.concat(warned, F.when(time == "", F.array(F.lit("missing_occurrence_time"))).otherwise(F.array().cast("array<string>"))))).alias("warnings"),
    )


def eligible_payments(facts: DataFrame) -> DataFrame:
    """Outgoing expenses with an amount."""
    return facts.filter((F.col("direction") == "outflow") & F.col("amount").isNotNull() & (F.col("business_type") == "expense"))


def ledger_source_facts(facts: DataFrame) -> DataFrame:
    return facts.filter((F.col("source_type") == "bank_transaction") & F.col("fact_type").isin("bank_payment", "bank_money_movement"))
