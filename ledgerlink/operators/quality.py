"""Data-quality metrics of each layer, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import account_key

REVIEWED = 50
# Warnings that put an order on the review list.
ORDER_REVIEW_WARNINGS = ("missing_paid_amount", "missing_order_time", "missing_title", "partial_order", "low_confidence")


def record_warnings(checks: dict[str, Column], given: Column | None = None) -> Column:
    """Sorted set of the names whose check holds, and of the warnings given."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return F.array_sort(F.array_distinct(F.concat(found, given) if given is not None else found))


def bank_warnings(df: DataFrame) -> Column:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return record_warnings({"missing_amount": empty("amount"), "missing_direction": F.col("direction") == "unknown", "missing_transaction_time": empty("transaction_time"), "missing_account_tail": empty("account_tail")})


def order_warnings(df: DataFrame) -> Column:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return record_warnings({
        "missing_paid_amount": empty("paid_amount"), "missing_order_time": empty("order_time"), "missing_order_id": empty("order_id"), "missing_title": empty("title"),
        "partial_order": F.col("is_partial"), "low_confidence": F.col("confidence") < 0.8,
    })


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def warning_counts(df: DataFrame, column: str = "warnings") -> DataFrame:
    return df.select(F.explode(column).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "warning")


def source_multiplicity(df: DataFrame, column: str = "n_sources") -> DataFrame:
    return df.groupBy(F.col(column).alias("n_sources")).agg(F.count(F.lit(1)).alias("n"))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(f"missing_{c}") for c in columns])


def amount_by_type(df: DataFrame, key: str = "transaction_type", amount: str = "amount") -> DataFrame:
    return df.groupBy(key).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("n"))


def bank_review(df: DataFrame, pos: str = "pos", most: int = REVIEWED) -> DataFrame:
    """The first rows with a warning or a confidence under 0.7."""
    return df.filter((F.size("warnings") > 0) | (F.col("confidence") < 0.7)).orderBy(pos).limit(most)


def order_review(df: DataFrame, pos: str = "pos", most: int = REVIEWED) -> DataFrame:
    return df.filter(F.arrays_overlap("warnings", F.array(*[F.lit(w) for w in ORDER_REVIEW_WARNINGS]))).orderBy(pos).limit(most)


def ledger_review(entries: DataFrame, pos: str = "pos", most: int = 80) -> DataFrame:
    return entries.filter("review_required").orderBy(pos).limit(most)


def metrics(df: DataFrame, counts: dict[str, Column], sums: dict[str, tuple[Column, Column]] | None = None, missing: list[str] | None = None, only: dict[str, Column] | None = None) -> DataFrame:
    """(section, key, value) in one pass over df: each row adds one to its key of every section of counts.

    Rows where a section's condition in only does not hold are not counted there. sums has keys and what to add; the sections rows and missing, if any columns are named, count all rows and
    those without a value, and have their keys even if df is empty. A null key is the empty text.
    """
    one = F.lit(1).cast("decimal(38,2)")
    entry = lambda section, key, value: F.struct(F.lit(section).alias("section"), F.coalesce(key.cast("string"), F.lit("")).alias("key"), value.cast("decimal(38,2)").alias("value"))
    parts = [F.when(only[section], entry(section, key, one)) if section in (only or {}) else entry(section, key, one) for section, key in counts.items()]
    parts += [entry(section, key, value) for section, (key, value) in (sums or {}).items()]
    fixed: list[tuple[str, str]] = []
    if missing is not None:
        fixed = [("rows", "rows"), *[("missing", f"missing_{c}") for c in missing]]
        parts.append(entry("rows", F.lit("rows"), one))
        parts += [entry("missing", F.lit(f"missing_{c}"), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", 1).otherwise(0)) for c in missing]
    rows = df.select(F.inline(F.array_compact(F.array(*parts)) if only else F.array(*parts)))
    if fixed:
        zero = F.array(*[entry(section, F.lit(key), F.lit(0)) for section, key in fixed])
        rows = rows.unionByName(df.sparkSession.range(1).select(F.inline(zero)))
    return rows.groupBy("section", "key").agg(F.sum("value").cast("decimal(38,2)").alias("value"))


def bank_quality(bank: DataFrame) -> DataFrame:
    """Rows before and after merging, merged rows, conflicts, missing values, and counts by bank, account, direction and number of sources."""
    counts = {"bank": F.col("bank_key"), "account": account_key(F.col("bank_key"), F.col("account_tail")), "direction": F.col("direction"), "sources": F.col("n_sources")}
    one = lambda holds: F.when(holds, 1).otherwise(0)
    sums = {
        "before": (F.lit("rows"), F.col("n_sources")), "merged": (F.lit("rows"), F.col("n_sources") - 1), "unknown": (F.lit("direction"), one(F.col("direction") == "unknown")),
        "conflicts": (F.lit("rows"), one(F.exists("warnings", lambda w: w.startswith("conflict_")))),
    }
    return metrics(bank, counts, sums, missing=["transaction_time", "amount", "account_tail", "counterparty", "transaction_reference"])


def order_quality_report(orders: DataFrame) -> DataFrame:
    """Rows, platforms, numbers of sources and warnings; warnings are exploded, so that they are a pass of their own columns."""
    warned = orders.select(F.explode("warnings").alias("warning"))
    return metrics(orders, {"platform": F.col("platform"), "sources": F.col("n_sources")}, missing=[]).unionByName(metrics(warned, {"warning": F.col("warning")}))


def fact_quality(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Facts by type, business type, source, platform and channel, orders by link status (facts as link.link_status gives them), links by strength."""
    counts = {n: F.col(c) for n, c in (("fact_type", "fact_type"), ("business_type", "business_type"), ("source", "source_type"), ("platform", "platform"), ("channel", "payment_channel"), ("order_status", "link_status"))}
    of_facts = metrics(facts, counts, only={"order_status": F.col("fact_type") == "order_purchase"}, missing=[])
    return of_facts.unionByName(metrics(links, {"strength": F.col("match_strength"), "links": F.lit("links")}))


def candidate_review(links: DataFrame, most: int = REVIEWED) -> DataFrame:
    """The first links that a person should confirm, in link order."""
    return links.filter("match_strength = 'candidate'").orderBy("order_pos", "rank").limit(most)


def ledger_quality(entries: DataFrame) -> DataFrame:
    counts = {"transaction_type": F.col("transaction_type"), "category": F.col("category_lv1"), "person": F.col("target_person"), "review": F.col("review_required")}
    return metrics(entries, counts, sums={"amount": (F.col("transaction_type"), F.col("amount"))})


def ingest_stats(manifest: DataFrame) -> DataFrame:
    """Files seen and failed by suffix, of a manifest with one row per file (status, path)."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return manifest.groupBy(suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("status") != "success").alias("failed"))


def order_ingest_stats(tree: DataFrame) -> DataFrame:
    """Per platform of read_order_tree's rows: files that failed, records, and warnings on them."""
    return tree.groupBy("platform").agg(
        F.count_if("failed").alias("failed"), F.count_if(~F.col("failed")).alias("records"), F.coalesce(F.sum(F.when(~F.col("failed"), F.size("warnings"))), F.lit(0)).alias("warnings")
    )
