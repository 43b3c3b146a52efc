"""Money and direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as money.
MONEY = r"^[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)(?:\.[0-9]{1,2})?$"


def parse_decimal(c: Column) -> Column:
    """Trimmed text without commas as a decimal; null if it is not one."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("decimal(38,10)")


def quantize_money(c: Column) -> Column:
    """Two decimals, half to even."""
    return F.bround(c, 2).cast("decimal(18,2)")


def money_token(c: Column) -> Column:
    """The text without commas if all of it is money, else the empty text."""
    plain = F.regexp_replace(F.trim(c), ",", "")
    return F.when(F.trim(c).rlike(MONEY) | plain.rlike(MONEY), plain).otherwise(F.lit(""))


def clean_money(c: Column) -> Column:
    """Without currency signs and commas."""
    return F.translate(F.trim(F.coalesce(c, F.lit(""))), "¥￥元,", "")


def first_number(c: Column) -> Column:
    """The first number of a cleaned money text, or the empty text."""
    return F.regexp_extract(clean_money(c), r"[+-]?[0-9]+(?:\.[0-9]+)?", 0)


def normalize_direction(given: Column, amount: Column) -> Column:
    known = F.lower(F.trim(F.coalesce(given, F.lit(""))))
    return F.when(known.isin("inflow", "outflow"), known).when(amount < 0, "outflow").when(amount > 0, "inflow").otherwise("unknown")


def signed_amount(amount: Column, direction: Column) -> Column:
    return F.when(direction == "outflow", -F.abs(amount)).otherwise(F.abs(amount))


# Words of statements and sentences that tell the direction.
INFLOW_WORDS = ("收入", "入账", "退款", "转入", "存入", "收款")
OUTFLOW_WORDS = ("支出", "消费", "付款", "扣款", "转出", "还款", "支付")


def statement_direction(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text.contains("收入") | (text == "收"), "inflow").when(text.contains("支出") | (text == "支"), "outflow").otherwise("unknown")


def sentence_direction(c: Column, inflow=INFLOW_WORDS, outflow=OUTFLOW_WORDS) -> Column:
    """Inflow words are tested first."""
    return F.when(c.rlike("|".join(inflow)), "inflow").when(c.rlike("|".join(outflow)), "outflow").otherwise("unknown")


def largest_amount(amounts: Column) -> Column:
    """Of an array of money texts, the first one of largest absolute value; null if none is money."""
    ranked = F.transform(amounts, lambda x, i: F.struct(F.abs(parse_decimal(x)).alias("size"), (-i).alias("first"), x.alias("text")))
    return F.array_max(F.filter(ranked, lambda x: x["size"].isNotNull()))["text"]


def confidence(c: Column, default: float = 0.5) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(default))))


def combined_confidence(a: Column, b: Column) -> Column:
    return F.round(F.least(confidence(a), confidence(b)), 4)
