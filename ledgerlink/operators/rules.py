"""Priority rules over texts, source rules, and lookups by precedence."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import join_text, text_key
from .category_rules import CATEGORY_RULES, DEFAULTS, Rule

#: What a rule gives.
RULE_COLUMNS = Rule._fields[3:]
#: Keywords up to this number are tried one after another.
CHAINED = 400
#: Patterns up to this number are broadcast to the paths that they are tried on.
BROADCAST_PATTERNS = 10_000


def numbered(rules: list[Rule]) -> list[dict]:
    """The rules with their places, in which they are tried where priorities are equal."""
    return [{"pos": pos, **r._asdict()} for pos, r in enumerate(rules)]


def rule_text(df: DataFrame) -> Column:
    """Six fields joined, without white space: a keyword may span two of them."""
    return text_key(F.concat_ws(" ", *[c for c in ("merchant", "counterparty", "title", "summary", "platform", "payment_channel") if c in df.columns]))


def classify_by_case(df: DataFrame, rules: list[dict], text: Column, direction: Column, value) -> Column:
    """The first matching rule's value as one CASE chain: no join, part of whole-stage code."""
    out = None
    for r in sorted(rules, key=lambda r: (r["priority"], r["pos"])):
        hit = F.lit(not r["keywords"])
        for k in r["keywords"]:
            hit = hit | text.contains(F.lower(F.regexp_replace(F.lit(k), r"(?U)\s+", "")))
        if r["direction"]:
            hit = hit & (direction == r["direction"])
        out = F.when(hit, value(r)) if out is None else out.when(hit, value(r))
    return out


def _plain(keyword: str) -> str:
    return "".join(keyword.split()).lower()


#: What parts buckets, entries of a bucket and an entry's order, direction and word: no keyword has them, as they are white space.
_BUCKET, _ENTRY, _PART = "\x1e", "\x1d", "\x1c"


def _entries(buckets: list[list[tuple]]) -> Column:
    """The buckets as a constant array of texts, made of one literal."""
    return F.split(F.lit(_BUCKET.join(_ENTRY.join(_PART.join(map(str, e)) for e in b) for b in buckets)), _BUCKET)


def _bucket_entries(table: Column, buckets: int, size: int) -> Column:
    """The entries of the buckets of all runs of size characters of _t; null for a shorter text."""
    places = F.when(F.length("_t") >= size, F.sequence(F.lit(1), F.length("_t") - (size - 1)))
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(F.col("_t"), i, F.lit(size))))
    hit = F.filter(F.transform(grams, lambda g: F.get(table, (F.crc32(g.cast("binary")) % buckets).cast("int"))), lambda b: b != "")
    return F.flatten(F.transform(hit, lambda b: F.split(b, _ENTRY)))


def classify_by_index(df: DataFrame, rules: list[dict], text: Column, direction: Column, schema: str, name: str = "_rule") -> DataFrame:
    """df with the first matching rule's fields (schema) by one scan of the text, whatever the number of rules.

    The two characters at each place of the text are looked up in a table of buckets (a constant array, at the place that
    their checksum gives), which holds the keywords that begin with them. Only those are searched for. The result is
    that of classify_by_case: the rules and what they give are two literals of the plan.
    """
    ordered = sorted(rules, key=lambda r: (r["priority"], r["pos"]))
    words = [(n, r["direction"] or "", _plain(k)) for n, r in enumerate(ordered) for k in r["keywords"]]
    always = [(n, r["direction"] or "", "") for n, r in enumerate(ordered) if not r["keywords"]] + [w for w in words if not w[2]]
    found = [F.split(F.lit(_ENTRY.join(_PART.join(map(str, e)) for e in always)), _ENTRY)] if always else []
    for size in (1, 2):
        own = [x for x in words if x[2] and min(len(x[2]), 2) == size]
        if own:
            buckets: list[list] = [[] for _ in own]
            for x in own:
                buckets[zlib.crc32(x[2][:size].encode()) % len(own)].append(x)
            found.append(F.coalesce(_bucket_entries(_entries(buckets), len(own), size), F.array().cast("array<string>")))
    parts = F.transform(F.concat(*found) if found else F.array().cast("array<string>"), lambda e: F.split(e, _PART))
    fits = F.filter(parts, lambda e: ((e[1] == "") | F.coalesce(e[1] == F.col("_dir"), F.lit(False))) & F.contains(F.col("_t"), e[2]))
    best = F.array_min(F.transform(fits, lambda e: e[0].cast("int")))
    given = F.split(F.lit(_BUCKET.join(json.dumps(r, ensure_ascii=False) for r in ordered)), _BUCKET)
    return df.withColumns({"_t": text, "_dir": direction}).withColumn("_best", best).withColumn(name, F.from_json(F.get(given, F.col("_best")), f"struct<{schema}>")).drop("_t", "_dir", "_best")


def classify(df: DataFrame, rules: list[Rule] = CATEGORY_RULES, defaults: list[Rule] = DEFAULTS) -> DataFrame:
    """df with the classification columns of the first rule, by priority and place, that its text and direction hit.

    Few keywords are a chain of conditions inside whole-stage code; more are looked up in an index.
    """
    every = numbered([*rules, *defaults])

    def value(r: dict) -> Column:
        return F.struct(*[(F.array(*[F.lit(t) for t in r[c]]).cast("array<string>") if c == "tags" else F.lit(r[c])).alias("classification_confidence" if c == "confidence" else c) for c in RULE_COLUMNS])

    if sum(len(r["keywords"]) for r in every) > CHAINED:
        kinds = {str: "string", float: "double", bool: "boolean", tuple: "array<string>"}
        named = [{**r, "classification_confidence": float(r["confidence"])} for r in every]
        names = ["classification_confidence" if c == "confidence" else c for c in RULE_COLUMNS]
        ruled = classify_by_index(df, named, rule_text(df), F.col("direction"), ", ".join(f"{c}: {kinds[type(named[0][c])]}" for c in names))
    else:
        ruled = df.withColumn("_rule", classify_by_case(df, every, rule_text(df), F.col("direction"), value))
    return ruled.select("*", "_rule.*").drop("_rule")


def classify_by_join(df: DataFrame, rules: DataFrame, key: str, text: Column, direction: Column, value: str = "category") -> DataFrame:
    """(key, value) by a broadcast theta join with a table (priority, pos, keyword, direction, value): rules are few by nature.

    The best rule of each key is min_by, which aggregates before the shuffle.
    """
    k = rules.select(F.struct("priority", "pos").alias("_p"), text_key(F.col("keyword")).alias("_k"), F.col("direction").alias("_d"), F.col(value).alias("_v"))
    rows = df.select(F.col(key), text.alias("_t"), direction.alias("_dir"))
    hit = rows.join(F.broadcast(k), F.col("_t").contains(F.col("_k")) & (F.col("_d").isNull() | (F.col("_d") == F.col("_dir"))), "left")
    return hit.groupBy(key).agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_p"))).alias(value))


def match_source_rules(messages: DataFrame, rules: list[dict], subject_words: list[str]) -> DataFrame:
    """Messages with the first rule whose sender hits, or whose subject and body both do; else by subject words; others go."""
    def has(c: str, words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.lower(F.col(c)).contains(w.lower())
        return out

    out = None
    for r in rules:
        hit = has("sender", r.get("sender_contains", [])) | (has("subject", r.get("subject_contains", [])) & has("body", r.get("body_contains", [])))
        out = F.when(hit, r["bank_key"]) if out is None else out.when(hit, r["bank_key"])
    fallback = F.when(has("subject", subject_words), "subject_keyword")
    return messages.withColumn("bank_key", F.coalesce(out, fallback) if out is not None else fallback).filter("bank_key is not null")


def resolve_by_precedence(files: DataFrame, lookup: DataFrame, path: str = "path", bank: str = "bank_key") -> DataFrame:
    """files with source and candidate_count of the first lookup that applies: filename, pattern, bank, type, default.

    lookup has (kind, key, candidate_count, pos). Each kind is a join on its own key, of which the lookup has one row (the
    first by pos), so that files never multiply and rows that repeat stay apart. Only patterns are tried on texts:
    on the distinct paths that no filename has resolved. Patterns are counted before they are broadcast.
    """
    label = F.when(F.col("kind").isin("filename", "default"), F.col("kind")).otherwise(F.concat_ws(":", "kind", "key"))
    row = F.struct(label.alias("source"), F.col("candidate_count"))

    def of(kind: str, key: Column) -> DataFrame:
        return lookup.filter(F.col("kind") == kind).groupBy(key.alias(f"_{kind}")).agg(F.min_by(row, "pos").alias(f"_by_{kind}"))

    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    suffix = F.regexp_extract(name, r"\.([^.]*)$", 1)
    paths = files.select(F.col(path).alias("_path")).distinct().withColumn("_filename", F.lower(F.regexp_extract("_path", r"([^/]*)$", 1)))
    by_name = paths.join(of("filename", F.lower("key")), "_filename", "left")
    patterns = lookup.filter("kind = 'pattern' and key <> ''").select(F.lower("key").alias("_pattern"), row.alias("_row"), F.col("pos").alias("_pos"))
    few = patterns.count() <= BROADCAST_PATTERNS
    tried = by_name.filter("_by_filename is null").select("_path").join(F.broadcast(patterns) if few else patterns, F.contains(F.lower("_path"), F.col("_pattern")))
    by_pattern = tried.groupBy("_path").agg(F.min_by("_row", "_pos").alias("_by_pattern"))
    resolved = by_name.join(by_pattern, "_path", "left").select("_path", F.coalesce("_by_filename", "_by_pattern").alias("_by_path"))
    out = files.withColumns({"_bank": F.col(bank), "_type": F.when(suffix != "", suffix)})
    out = out.join(resolved, out[path] == resolved["_path"], "left").join(of("bank", F.col("key")), "_bank", "left").join(of("type", F.regexp_replace(F.lower("key"), r"^\.", "")), "_type", "left")
    default = lookup.filter("kind = 'default'").agg(F.min_by(row, "pos").alias("_by_default"))
    best = F.coalesce("_by_path", "_by_bank", "_by_type", "_by_default")
    return out.join(F.broadcast(default)).select(*[files[c] for c in files.columns], F.coalesce(best["source"], F.lit("")).alias("source"), F.coalesce(best["candidate_count"], F.lit(0)).alias("candidate_count"))  # one row


def rule_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "priority int, pos int, keyword string, direction string, category string")


def joined_fields(*names: str) -> Column:
    return join_text(*[F.col(n) for n in names])
