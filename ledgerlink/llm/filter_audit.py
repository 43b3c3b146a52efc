"""Audit of text filters in every order: what each removes, where, and what it costs.

Documents fall into cells by their part and by the mask of the filters that they fail. Only cells are counted; each
cell then folds over the array of all orders (a constant of the plan, which every task has), step by step, and gives
one struct of counts per order and step, weighted by the cell. The structs of a part's cells, 32 at most, are added
element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters' letters, in the order of the mask's bits.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_BLANK = r"[\x20\x09-\x0D]+"


def text_fails(text: Column) -> list[Column]:
    """Whether a text fails the filters A to D: few words, few distinct ones, many capitals, a sign of markup."""
    words = F.array_remove(F.split(text, _BLANK), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 200, F.size(F.array_distinct(words)) * 100 < n * 50, capitals * 100 > F.length(text) * 3, text.rlike(r"[#$%&*|]")]


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the cells of the documents, each counted once.

    A text's copies agree in all filters but E, which only those of the smallest id pass. Copies are counted per
    (text, part, labels) before they meet, so that a text of many copies is few rows, and the labels join on ids.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_fails(text))), F.lit(0))
    slim = docs.select(
        F.col("doc_id").alias("_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_text"), mask.alias("mask")
    )
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    same = slim.join(marks, "_id", "left").groupBy("_id", "_text", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    # at: copies of the smallest id (more than one if a row repeats); rows without an id are copies of nothing
    copies = same.groupBy("_text", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("_id").alias("first"), F.min_by("n", "_id").alias("at"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed")
    )
    first = F.min("first").over(Window.partitionBy("_text"))  # as many rows as a text has parts and labels
    unlike = F.col("unnamed") + F.when(F.col("first") == first, F.col("at")).otherwise(0)
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("unlike").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("unlike")).alias("n")))
    rows = copies.withColumn("unlike", unlike).select("part", "good", "toxic", F.inline(split)).filter("n > 0")
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


_STRUCT = "struct<filter_order: string, step: int, " + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"
#: One cell over all orders: a fold over an order's steps carries whether the cell is still there, and its structs.
CELL_FOLD = f"""
    flatten(transform(orders, o -> aggregate(
        sequence(1, {len(FILTERS)}),
        named_struct('alive', true, 'out', cast(array() as array<{_STRUCT}>)),
        (acc, step) -> named_struct(
            'alive', acc.alive and not fails[locate(substr(o, step, 1), '{FILTERS}') - 1],
            'out', array_append(acc.out, named_struct(
                'filter_order', o, 'step', step,
                'kept', if(acc.alive and not fails[locate(substr(o, step, 1), '{FILTERS}') - 1], n, 0L),
                'removed', if(acc.alive and fails[locate(substr(o, step, 1), '{FILTERS}') - 1], n, 0L),
                'redundant', if(not acc.alive and fails[locate(substr(o, step, 1), '{FILTERS}') - 1], n, 0L),
                'unique_fails', if(mask = shiftleft(1, locate(substr(o, step, 1), '{FILTERS}') - 1), n, 0L),
                'good_lost', if(acc.alive and fails[locate(substr(o, step, 1), '{FILTERS}') - 1], good, 0L),
                'toxic_lost', if(acc.alive and fails[locate(substr(o, step, 1), '{FILTERS}') - 1], toxic, 0L)))),
        acc -> acc.out)))
"""
#: The cells of a part, added element by element.
MERGE = (
    "aggregate(slice(cells, 2, size(cells)), cells[0], (a, b) -> zip_with(a, b, (x, y) -> named_struct('filter_order', x.filter_order, 'step', x.step, "
    + ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS) + ")))"
)
#: What each filter removes, at any step of any order.
SHAPLEY = f"transform(sequence(1, {len(FILTERS)}), k -> aggregate(sums, 0L, (s, x) -> s + if(substr(x.filter_order, x.step, 1) = substr('{FILTERS}', k, 1), x.removed, 0L)))"


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang), order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 200 words; B fewer distinct words than half; C over 3 % capitals A-Z; D holds one of #$%&*|;
    E equal to the text of a smaller doc_id. Null texts are empty; a null lang is the part ''. Rows that repeat an id
    and a text are counted each, and none of them is a copy of the other; rows without an id are copies of nothing.
    A document is good or toxic if any of its labels says so; one without labels is neither. Other columns are
    ignored. An empty table gives no rows.
    """
    cells = mask_cells(docs, labels).select(
        "part", "mask", "n", "good", "toxic", F.array(*[F.col("mask").bitwiseAND(1 << k) > 0 for k in range(len(FILTERS))]).alias("fails"), F.array(*map(F.lit, ORDERS)).alias("orders")
    )
    folded = cells.select("part", F.expr(CELL_FOLD).alias("cell"))
    summed = folded.groupBy("part").agg(F.collect_list("cell").alias("cells")).select("part", F.expr(MERGE).alias("sums"))
    rows = summed.withColumn("_shapley", F.expr(SHAPLEY)).select("part", "_shapley", F.inline("sums"))
    return rows.select("part", "filter_order", "step", *COUNTS, F.expr(f"_shapley[locate(substr(filter_order, step, 1), '{FILTERS}') - 1]").alias("shapley"))
