"""Survivorship dedupe of statement rows and order captures."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import account_key, blank, text_key
from .scans import MOST, running

# Fields that a merge fills, in order.
BANK_FIELDS = ["bank_name", "account_tail", "transaction_time", "posting_date", "merchant", "counterparty", "summary", "balance", "channel", "transaction_reference"]
ORDER_FIELDS = ["source_file", "source_image", "order_id", "order_time", "merchant", "title", "spec", "quantity", "paid_amount", "original_amount", "shipping_fee", "status", "logistics", "notes"]


def _first_text(*names: str, have: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in have], F.lit(""))


def bank_key_of(df: DataFrame) -> Column:
    """The reference where there is one, else day, direction, amount and party."""
    have = df.columns
    account = F.col("account_key") if "account_key" in have else account_key(F.col("bank_key"), F.col("account_tail"))
    text = lambda n: F.coalesce(F.col(n), F.lit("")) if n in have else F.lit("")
    day = F.coalesce(F.nullif(F.substring(text("transaction_time"), 1, 10), F.lit("")), text("posting_date"))
    party = F.substring(text_key(_first_text("counterparty", "merchant", "summary", have=have)), 1, 40)
    return F.when(
        ~blank(F.col("transaction_reference")), F.concat_ws("|", F.lit("ref"), text("bank_key"), account, F.col("transaction_reference"))
    ).otherwise(F.concat_ws("|", F.lit("fallback"), text("bank_key"), account, day, text("direction"), text("amount"), party))


def _place(df: DataFrame, pos: str) -> Column:
    """The position as one number: those of a union, (source rank, position), are a decimal that sorts alike.

    A position is a whole number, of up to 28 digits if it is a decimal.
    """
    kind = dict(df.dtypes)[pos]
    wide = "decimal" in kind
    none = F.lit(Decimal(-(10**28)) if wide else -(1 << 62))
    if not kind.startswith("struct<source:"):
        return F.coalesce(F.col(pos), none)
    return F.coalesce((F.col(f"{pos}.source") * F.lit(Decimal(2 * 10 ** (28 if wide else 19))) + F.col(f"{pos}.pos")).cast("decimal(38,0)"), none)


def dedupe_bank(df: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per key: the first row's values, blanks filled by the earliest non-blank, conflicts as warnings.

    Merging in order of pos keeps the first non-blank value for good. So a hash aggregation of numbers finds, for each
    key and field, the place of that value, and whether values differ, by the least and greatest hash (64 bits of a SHA-256, which
    no text can be made to share); then the first row is fetched by its place, and the few values from other places likewise.
    Nothing of a key is collected: its sources are counted (n_sources), and bank_members has them one by one. Of
    rows that share a key and a position, any may count as the first. Null positions come first.
    """
    have = [f for f in BANK_FIELDS if f in df.columns]
    own = [c for c in df.columns if c not in (*have, "confidence", "warnings", pos)]
    keyed = _keyed(df.withColumn("_place", _place(df, pos)), bank_key_of(df))
    rest = ["confidence"] if "confidence" in df.columns else []
    aggs = [F.max(c).alias(c) for c in rest]
    for c in have:
        filled = ~blank(F.col(c))
        aggs.append(F.min(F.when(filled, F.col("_place"))).alias(f"_at_{c}"))
        digest = F.when(filled, F.xxhash64(F.sha2(F.col(c).cast("string"), 256)))
        aggs += [F.min(digest).alias(f"_a_{c}"), F.max(digest).alias(f"_b_{c}")]
    found = keyed.groupBy("_hash", "dedupe_key").agg(F.min("_place").alias("_place"), F.count(F.lit(1)).alias("n_sources"), *aggs)
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"_a_{c}") != F.col(f"_b_{c}"), F.lit(f"conflict_{c}")) for c in have])).cast("array<string>")
    merged = found.select("_hash", "dedupe_key", "_place", "n_sources", *rest, *[f"_at_{c}" for c in have], conflicts.alias("warnings"))
    if "warnings" in df.columns:
        warned = keyed.select("_hash", "dedupe_key", F.explode("warnings").alias("_w")).distinct().groupBy("_hash", "dedupe_key").agg(F.collect_list("_w").alias("_warned"))
        merged = merged.join(warned, ["_hash", "dedupe_key"], "left").withColumn("warnings", F.concat("warnings", F.coalesce("_warned", F.array().cast("array<string>")))).drop("_warned")
    # one row of each place: the sort that finds it is the join's own
    again = F.lag("_place").over(Window.partitionBy("_hash", "_place").orderBy("_place"))
    rows = keyed.select("_hash", "_place", F.struct(pos, *own, *have).alias("_row")).withColumn("_again", again).filter("_again is null").drop("_again")
    joined = merged.join(rows, ["_hash", "_place"])
    from_elsewhere = lambda c: F.coalesce(F.col(f"_at_{c}") != F.col("_place"), F.lit(False))
    mixed = reduce(lambda x, y: x | y, [from_elsewhere(c) for c in have], F.lit(False))

    def shaped(out: DataFrame, other) -> DataFrame:
        value = lambda c: F.when(F.col(f"_at_{c}") == F.col("_place"), F.col(f"_row.{c}")).when(F.col(f"_at_{c}").isNotNull(), other(c)).otherwise(F.lit("")).alias(c)
        fields = [*[F.col(f"_row.{c}") for c in own], *[value(c) for c in have]]
        return out.select("dedupe_key", f"_row.{pos}", "n_sources", *fields, *rest, F.array_sort(F.array_distinct("warnings")).alias("warnings"))

    # the few keys with values from other places: one row for each such field, at most as many as there are fields
    wanted = F.filter(F.array(*[F.when(from_elsewhere(c), F.struct(F.lit(c).alias("field"), F.col(f"_at_{c}").alias("_from"))) for c in have]), lambda w: w.isNotNull())
    whole = F.struct(*[F.col(c) for c in joined.columns]).alias("_whole")
    sought = joined.filter(mixed).select("_hash", whole, F.inline(wanted))
    kinds = dict(df.dtypes)
    values = F.coalesce(*[F.when(F.col("field") == c, F.col(f"_row.{c}").cast("string")) for c in have])
    fetched = sought.join(rows.withColumnRenamed("_place", "_from"), ["_hash", "_from"]).select("_hash", "_whole", F.struct("field", values.alias("value")).alias("_f"))
    fills = fetched.groupBy("_hash", F.col("_whole.dedupe_key").alias("_key")).agg(F.collect_list(F.struct("_whole", "_f")).alias("_fills"))
    filled = fills.select(F.get("_fills", F.lit(0))["_whole"].alias("_w"), F.transform("_fills", lambda f: f["_f"]).alias("_fills")).select("_w.*", "_fills")
    plain = shaped(joined.filter(~mixed), lambda c: F.lit(None).cast(kinds[c]))
    return plain.unionByName(shaped(filled, lambda c: F.get(F.filter("_fills", lambda f: f["field"] == c), F.lit(0))["value"].cast(kinds[c])))


def bank_members(df: DataFrame, pos: str = "pos") -> DataFrame:
    """(dedupe_key, pos, warnings if there are any): the sources of each merged row, one row each."""
    return df.select(bank_key_of(df).alias("dedupe_key"), pos, *(["warnings"] if "warnings" in df.columns else []))


def _keyed(df: DataFrame, key: Column) -> DataFrame:
    """df with its dedupe_key and the key's hash, which is grouped by first: keys begin alike, and hashes sort by one comparison."""
    return df.withColumn("dedupe_key", key).withColumn("_hash", F.xxhash64("dedupe_key"))


def order_key_of(df: DataFrame) -> Column:
    """The order id; else the capture's place where there is too little to tell; else a text key."""
    text = lambda n: F.coalesce(F.col(n), F.lit("")) if n in df.columns else F.lit("")
    item, value, time = (~blank(text("merchant")) | ~blank(text("title"))), ~blank(text("paid_amount")), ~blank(text("order_time"))
    enough = (item & value) | (item & time) | (time & value)
    return (
        F.when(~blank(text("order_id")), F.concat_ws("|", F.lit("order_id"), text("platform"), text("order_id")))
        .when(~enough, F.concat_ws("|", F.lit("source"), text("platform"), text("source_file"), text("order_index").cast("string")))
        .otherwise(
            F.concat_ws(
                "|", F.lit("fallback"), text("platform"), text("order_time"), F.substring(text_key(text("merchant")), 1, 40),
                F.substring(text_key(text("title")), 1, 80), F.substring(text_key(text("spec")), 1, 40), text("paid_amount"),
            )
        )
    )


# The fields by which captures are compared.
ORDER_SIGNS = ("order_id", "order_time", "merchant", "title", "paid_amount")
#: Captures of a key whose places are sorted together where sources are listed.
RUN = 10_000


def order_quality(r: Column, have: list[str]) -> Column:
    """(complete, confidence, filled of five) of a capture, to be compared in this order."""
    filled = sum((F.when(r[f] != "", 1).otherwise(0) for f in ORDER_SIGNS if f in have), F.lit(0))
    return F.struct(F.when(r["is_partial"], 0).otherwise(1).alias("complete"), r["confidence"].alias("confidence"), filled.alias("filled"))


def _captures(df: DataFrame, pos: str, most: int) -> tuple[DataFrame, list[str]]:
    """The captures with their key and _place, their place in the merged record; and the names of the key's columns.

    Merging a key's captures by pos, one wins over the record so far if it is better: complete before partial, then by
    confidence, then by how many of ORDER_SIGNS are filled. The record's own standing is that of all its captures so
    far together, so it runs over earlier rows: whether any was complete, the highest confidence, the fields that any
    filled. A winner goes before all earlier captures, another one behind them.
    """
    signs = [f for f in ORDER_SIGNS if f in df.columns]
    bits = F.when(F.col("is_partial"), 0).otherwise(1)
    for k, f in enumerate(signs, 1):
        bits = bits + F.when(blank(F.col(f)), 0).otherwise(1 << k)
    have = [f for f in ORDER_FIELDS if f in df.columns]
    keyed = _keyed(df, order_key_of(df)).withColumns({"_at": _place(df, pos), "_tie": F.xxhash64("is_partial", "confidence", *have), "_own": bits, "_sure": F.col("confidence").cast("double")})
    group = ["_hash", "dedupe_key", *(["platform"] if "platform" in df.columns else [])]
    ran = running(keyed, group, ["_at", "_tie"], most, _before=("sum", F.lit(1)), _bits=("or", F.col("_own")), _best=("max", F.col("_sure")))
    standing = lambda b, sure: F.struct(F.col(b).bitwiseAND(1), F.col(sure), F.bit_count(F.shiftright(b, 1)))
    won = F.col("_before").isNotNull() & (standing("_own", "_sure") > standing("_bits", "_best"))
    n = F.coalesce("_before", F.lit(0))
    return ran.withColumns({"_n": n, "_place": F.when(won, -n).otherwise(n)}), group


def dedupe_orders(df: DataFrame, pos: str = "pos", most: int = MOST, sources: bool = False) -> DataFrame:
    """One row per key: captures merged by pos, where the better of the record so far and the next capture is filled from the other.

    The order in which captures end up in the record (_captures) is all that a merge depends on: each field has its first
    non-blank value in that order, and a conflict is more than one value. So the captures of a key are never in one row;
    they run through one window, or many tasks if there are more than `most`, and are aggregated as they come.
    Sources are counted; capture_members has them one by one. With `sources`, they are also listed in the order of the
    record: RUN places at a time are sorted, so that a key needs no more memory than its list. Null actions and warnings
    are none. The confidence is the highest, and a record is partial if all its captures are.
    """
    have = [f for f in ORDER_FIELDS if f in df.columns]
    rows, group = _captures(df, pos, most)
    partial = F.col("is_partial")
    every = lambda c: F.flatten(F.collect_set(c)) if c in df.columns else F.array().cast("array<string>")
    # per column the aggregate of captures, and that of runs of captures
    steps = {
        "n_sources": (F.count(F.lit(1)), F.sum("n_sources")), "_pos": (F.min_by(pos, "_n"), F.min_by("_pos", "_first")), "_first": (F.min("_n"), F.min("_first")),
        "_whole": (F.count_if(~partial), F.sum("_whole")), "_unknown": (F.count_if(partial.isNull()), F.sum("_unknown")), "confidence": (F.max("_sure"), F.max("confidence")),
        **{c: (every(c), F.flatten(F.collect_set(c))) for c in ("actions", "warnings")},
    }
    for c in have:
        filled = F.when(~blank(F.col(c)), F.col(c))
        at = F.when(filled.isNotNull(), F.col("_place"))
        steps |= {c: (F.min_by(c, at), F.min_by(c, f"_at_{c}")), f"_at_{c}": (F.min(at), F.min(f"_at_{c}"))}
        steps |= {f"_lo_{c}": (F.min(filled), F.min(f"_lo_{c}")), f"_hi_{c}": (F.max(filled), F.max(f"_hi_{c}"))}
    listed = lambda a: F.transform(F.array_sort(a), lambda x: x["of"])
    if sources:
        steps["sources"] = (listed(F.collect_list(F.struct("_place", F.col(pos).alias("of")))), F.flatten(listed(F.collect_list(F.struct("_run", F.col("sources").alias("of"))))))
    run = [F.floor(F.col("_place") / RUN).alias("_run")] if sources else []
    merged = rows.groupBy(*group, *run).agg(*[a.alias(n) for n, (a, _) in steps.items()])
    if sources:
        merged = merged.groupBy(*group).agg(*[b.alias(n) for n, (_, b) in steps.items()])
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"_lo_{c}") != F.col(f"_hi_{c}"), F.lit(f"conflict_{c}")) for c in have])).cast("array<string>")
    sorted_ = lambda a: F.array_sort(F.array_distinct(a))
    return merged.select(
        *group[1:], F.col("n_sources").cast("int").alias("n_sources"), F.col("_pos").alias("pos"), *[F.coalesce(c, F.lit("")).alias(c) for c in have],
        F.when(F.col("_whole") > 0, False).when(F.col("_unknown") > 0, F.lit(None)).otherwise(True).alias("is_partial"), "confidence",
        sorted_(F.col("actions")).alias("actions"), sorted_(F.concat("warnings", conflicts)).alias("warnings"), *(["sources"] if sources else []),
    )


def capture_members(df: DataFrame, pos: str = "pos", most: int = MOST) -> DataFrame:
    """(dedupe_key, platform if there is one, pos, place): the captures of each merged order; place sorts them as they are in it."""
    rows, group = _captures(df, pos, most)
    return rows.select(*group[1:], F.col(pos).alias("pos"), F.col("_place").alias("place"))
