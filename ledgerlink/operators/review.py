"""Review tables and layer summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review_order(entries: DataFrame) -> DataFrame:
    """Missing dates last, then type and place."""
    return entries.orderBy(F.col("date").asc_nulls_last(), "transaction_type", "pos")


def match_review_tables(facts: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """The tables of a matching review; facts carry link_status."""
    orders, bank = facts.filter("source_type = 'platform_order'"), facts.filter("source_type = 'bank_transaction'")
    status = F.col("link_status")
    return {
        "overview": facts.groupBy("source_type", "link_status").agg(F.count(F.lit(1)).alias("n")),
        "linked": links.filter("match_strength = 'linked'"),
        "candidates": links.filter("match_strength = 'candidate'"),
        "unmatched_orders": orders.filter(status == "unmatched"),
        "orders": orders,
        "outgoing": bank.filter("direction = 'outflow'"),
        "facts": facts,
    }


def month_buckets(entries: DataFrame) -> DataFrame:
    """Entries with the bucket (month or missing_date) their review sheet has, and blank columns to override."""
    return entries.select(
        F.coalesce("year_month", F.lit("missing_date")).alias("bucket"), "*",
        *[F.lit("").alias(f"override_{c}") for c in ("transaction_type", "category_lv1", "category_lv2", "category_lv3", "target_person", "note")],
    )


def write_review_months(entries: DataFrame, path: str) -> None:
    """The buckets as a table with one folder each, so that a month is read by itself."""
    month_buckets(entries).write.mode("overwrite").partitionBy("bucket").parquet(path)


def ledger_review_by_month(entries: DataFrame) -> DataFrame:
    """Overview of the buckets, of entries or of a table that write_review_months has written."""
    rows = entries if "bucket" in entries.columns else month_buckets(entries)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.count_if("review_required").alias("to_review"))


def layer_summary(layers: dict[str, dict[str, DataFrame]], by: str = "source_type") -> DataFrame:
    """(source, layer, n): the rows of each layer of each source; layers that have the column `by` are split by it."""
    out = None
    for source, frames in layers.items():
        for layer, df in frames.items():
            own = F.col(by) if by in df.columns else F.lit(source)
            split = df.groupBy(own.alias("source")) if by in df.columns else df.groupBy()
            rows = split.agg(F.count(F.lit(1)).alias("n")).select("source" if by in df.columns else own.alias("source"), F.lit(layer).alias("layer"), "n")
            out = rows if out is None else out.unionByName(rows)
    return out
