"""The ledger: payments enriched with their orders, classified, with overrides and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import combined_confidence
from ..functions.text import order_summary, stable_id
from ..functions.times import ledger_date
from .category_rules import CATEGORY_RULES, DEFAULTS, Rule
from .facts import ledger_source_facts
from .link import LINKED_FROM
from .rules import classify

# Transaction types in income, expense and cash-flow statistics.
INCOME, EXPENSE = "收入", "支出"
CASHFLOW = ("收入", "支出", "退款", "债权债务")
SUMMARIES = 5


def order_members(links: DataFrame, orders: DataFrame, least: int = LINKED_FROM) -> DataFrame:
    """(fact_id, order_id, record, text, score, order_pos, rank): the strongly linked orders of payments, one row each.

    Links of the same orders may bring their records and texts (order_record, order_text, as link_orders_payments gives
    them); else these are joined.
    """
    strong = links.filter((F.col("match_strength") == "linked") & (F.col("score") >= least))
    if "order_text" in links.columns:
        return strong.select(F.col("payment_id").alias("fact_id"), "order_id", F.col("order_record").alias("record"), F.col("order_text").alias("text"), "score", "order_pos", "rank")
    strong = strong.select(F.col("payment_id").alias("fact_id"), "order_id", "score", "order_pos", "rank")
    details = orders.select(F.col("fact_id").alias("order_id"), F.col("source_id").alias("record"), order_summary(F.col("merchant"), F.col("title"), F.col("summary")).alias("text"))
    return strong.join(details, "order_id").select("fact_id", "order_id", "record", "text", "score", "order_pos", "rank")


def enrich_with_orders(facts: DataFrame, links: DataFrame, orders: DataFrame, least: int = LINKED_FROM) -> DataFrame:
    """Bank facts with the number of their strongly linked orders, the best one's summary and the first five summaries.

    A payment may have any number of orders: they are counted, and each task keeps the best SUMMARIES of a payment
    before these meet. The orders themselves are rows of order_members.
    """
    members = order_members(links, orders, least)
    counted = members.groupBy("fact_id").agg(F.count(F.lit(1)).alias("_n"))
    best = members.filter("text <> ''").withColumn("_k", F.row_number().over(Window.partitionBy("fact_id").orderBy(F.desc("score"), "order_pos", "rank"))).filter(F.col("_k") <= SUMMARIES)
    texts = best.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("_k", "text"))).alias("_texts"))
    text = F.transform("_texts", lambda r: r["text"])
    return facts.join(counted, "fact_id", "left").join(texts, "fact_id", "left").select(
        *facts.columns, F.col("_n").isNotNull().alias("matched_order"), F.coalesce(F.get(text, F.lit(0)), F.lit("")).alias("item_or_service"),
        F.coalesce(F.array_join(text, " | "), F.lit("")).alias("order_detail_summary"), F.coalesce("_n", F.lit(0)).alias("order_count"),
    )


def with_order_lists(entries: DataFrame, members: DataFrame, key: str = "fact_id") -> DataFrame:
    """entries with linked_order_ids and linked_order_record_ids, best first, for exports that want lists in a row.

    A list holds all orders of a payment, so this is for layers whose payments have few; order_members has no such bound.
    """
    row = F.struct((-F.col("score")).alias("s"), "order_pos", "rank", "order_id", "record")
    found = members.groupBy(F.col("fact_id").alias(key)).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    listed = lambda name: F.coalesce(F.filter(F.transform("_rows", lambda r: r[name]), lambda x: x != ""), F.array().cast("array<string>"))
    return entries.join(found, key, "left").select(*entries.columns, listed("order_id").alias("linked_order_ids"), listed("record").alias("linked_order_record_ids"))


def classify_with_order_text(enriched: DataFrame, rules: list[Rule] = CATEGORY_RULES, defaults: list[Rule] = DEFAULTS) -> DataFrame:
    """Classification over title and summary with the orders' texts; the stored title and summary stay as they are."""
    has = F.col("order_detail_summary") != ""
    seen = enriched.withColumns({
        "_title": F.col("title"), "_summary": F.col("summary"),
        "title": F.when(has, F.trim(F.concat_ws(" ", "title", "item_or_service"))).otherwise(F.col("title")),
        "summary": F.when(has, F.trim(F.concat_ws(" ", "summary", "order_detail_summary"))).otherwise(F.col("summary")),
    })
    return classify(seen, rules, defaults).withColumns({"title": F.col("_title"), "summary": F.col("_summary")}).drop("_title", "_summary")


def build_ledger(facts: DataFrame, links: DataFrame, orders: DataFrame, rules: list[Rule] = CATEGORY_RULES, defaults: list[Rule] = DEFAULTS) -> DataFrame:
    """One entry per bank fact; orders never become entries."""
    c = classify_with_order_text(enrich_with_orders(ledger_source_facts(facts), links, orders), rules, defaults)
    date, kind = ledger_date(F.col("occurrence_time")), F.col("transaction_type")
    unsure = F.array_compact(F.array(
        F.when(date.isNull(), "missing_date"), F.when((F.col("category_lv1") == "未分类") | (F.col("category_lv2") == "未分类"), "uncategorized"),
        F.when(F.col("confidence") < 0.75, "low_confidence"), F.when(F.col("classification_confidence") < 0.75, "low_classification_confidence"),
    ))
    return c.select(
        stable_id("ledger_", {"source_financial_transaction_id": F.col("fact_id"), "date": date.cast("string"), "amount": F.abs("amount").cast("string"), "transaction_type": kind}).alias("ledger_entry_id"),
        "pos", date.alias("date"), F.year(date).alias("year"), F.month(date).alias("month"), F.date_format(date, "yyyy-MM").alias("year_month"),
        "transaction_type", "direction", F.abs("amount").alias("amount"), "signed_amount", "category_lv1", "category_lv2", "category_lv3", "target_person", "project",
        F.array_sort(F.array_distinct("tags")).alias("tags"), "reimbursable_status", "budget_status",
        (kind == INCOME).alias("include_in_income_stats"), (kind == EXPENSE).alias("include_in_expense_stats"), kind.isin(*CASHFLOW).alias("include_in_cashflow_stats"),
        F.col("source_system").alias("account"), F.col("payment_channel").alias("payment_method"), "platform", "merchant", "counterparty", "item_or_service",
        F.col("summary").alias("raw_description"), "matched_order", "order_count", "order_detail_summary",
        F.col("fact_id").alias("source_fact_id"), F.col("source_id").alias("source_record_id"), combined_confidence(F.col("confidence"), F.col("classification_confidence")).alias("confidence"),
        "classification_confidence", F.col("reason").alias("classification_reason"), "review_required", unsure.alias("review_reasons"), "warnings",
    )


def unmatched_orders(orders: DataFrame, entries: DataFrame, members: DataFrame) -> DataFrame:
    """Order facts that are no entry's: entries are ledger entries or enriched facts, members of order_members."""
    own = F.col("source_fact_id" if "source_fact_id" in entries.columns else "fact_id").alias("fact_id")
    matched = members.select("fact_id", "order_id").join(entries.select(own), "fact_id", "left_semi")
    return orders.join(matched.select(F.col("order_id").alias("fact_id")), "fact_id", "left_anti")


def ledger_stats(facts: DataFrame, links: DataFrame, orders: DataFrame, entries: DataFrame) -> DataFrame:
    """One row of counts."""
    parts = [
        facts.agg(F.count(F.lit(1)).alias("input_facts")), links.agg(F.count(F.lit(1)).alias("input_links")),
        entries.agg(F.count(F.lit(1)).alias("bank_source_facts"), F.count_if("matched_order").alias("matched_order_entries")),
        orders.agg(F.count(F.lit(1)).alias("order_source_facts")), unmatched_orders(orders, entries, order_members(links, orders)).agg(F.count(F.lit(1)).alias("unmatched_order_facts")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # single rows
    return out


def apply_overrides(entries: DataFrame, overrides: DataFrame, key: str, fields: dict[str, str], source: str = "review") -> DataFrame:
    """Non-blank reviewed values win; fields maps a column of entries to the override's. Rows without any filled value do nothing."""
    filled = {c: F.nullif(F.trim(F.col(o)), F.lit("")) for c, o in fields.items()}
    given = overrides.select(F.col(key), *[v.alias(f"_o_{c}") for c, v in filled.items()]).filter(F.coalesce(*[F.col(f"_o_{c}") for c in fields]).isNotNull())
    joined = entries.join(given, key, "left")
    applied = F.coalesce(*[F.col(f"_o_{c}") for c in fields]).isNotNull()
    kept = [F.coalesce(F.col(f"_o_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in entries.columns]
    return joined.select(*kept, applied.alias("override_applied"), F.when(applied, source).otherwise("").alias("override_source"))


#: The cuts of the period reports, each with its subtotals.
_REPORTS = (
    ("year_month", "category_lv1", "category_lv2", "category_lv3"), ("year_month", "category_lv1", "category_lv2"), ("year_month", "category_lv1"), ("year_month",),
    ("date",), ("year_month", "target_person"), ("target_person",), (),
)


def period_reports(entries: DataFrame) -> DataFrame:
    """Amount and number of expenses by month and category path, by day, by person, and in all; transfers are no consumption.

    One pass gives all of them: grouping sets, told apart by grouping_id, so that a total is no null category.
    """
    axes = ["year_month", "date", "category_lv1", "category_lv2", "category_lv3", "target_person"]
    sets = [[F.col(c) for c in cut] for cut in _REPORTS]
    return entries.filter("include_in_expense_stats").groupingSets(sets, *axes).agg(F.grouping_id().alias("grouping_id"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
