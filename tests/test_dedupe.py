"""The order fold against a plain model over all permutations, and properties of both dedupes."""

import random
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from ledgerlink.operators.dedupe import bank_members, capture_members, dedupe_bank, dedupe_orders
from ledgerlink.sources.records import union_sources
from ledgerlink.plans.fixtures import Fixtures
from ledgerlink.plans.queries import SQL

FIELDS = ["order_id", "order_time", "merchant", "title", "paid_amount"]


def model(rows):
    def score(r):
        return (0 if r["is_partial"] else 1, r["confidence"], sum(1 for f in FIELDS if r[f]))

    a = dict(rows[0], warnings=set())
    for b in rows[1:]:
        b = dict(b, warnings=set())
        p, s = (b, a) if score(b) > score(a) else (a, b)
        m = dict(p)
        m["warnings"] = a["warnings"] | b["warnings"] | {f"conflict_{f}" for f in FIELDS if p[f] and s[f] and p[f] != s[f]}
        for f in FIELDS:
            m[f] = p[f] or s[f]
        m["confidence"], m["is_partial"] = max(a["confidence"], b["confidence"]), a["is_partial"] and b["is_partial"]
        a = m
    return a


def test_fold_equals_the_model_in_every_order(spark):
    base = [("t1", False, 0.80, "m1"), ("", True, 0.95, ""), ("t3", False, 0.90, "m3"), ("t4", True, 0.99, "m1")]
    rows, want = [], {}
    for n, order in enumerate(permutations(base)):
        group = [{"order_id": f"o{n}", "order_time": "", "merchant": m, "title": t, "paid_amount": "", "is_partial": p, "confidence": c} for t, p, c, m in order]
        want[f"o{n}"] = model(group)
        rows += [(n * 10 + i, "jd", *[g[f] for f in FIELDS], g["is_partial"], g["confidence"]) for i, g in enumerate(group)]
    df = spark.createDataFrame(rows, "pos long, platform string, order_id string, order_time string, merchant string, title string, paid_amount string, is_partial boolean, confidence double")
    got = {r.order_id: r for r in dedupe_orders(df).collect()}
    assert len(got) == 24
    for k, w in want.items():
        assert (got[k].title, got[k].merchant, got[k].confidence, got[k].is_partial, set(got[k].warnings)) == (w["title"], w["merchant"], w["confidence"], w["is_partial"], w["warnings"])


def test_captures_dealt_over_many_tasks_merge_alike(spark):
    rng, rows = random.Random(9), []
    pick = lambda *v: rng.choice(["", "", *v])
    for pos in rng.sample(range(5000), 600):
        rows.append((pos, f"o{rng.choice([0, 0, rng.randrange(20)])}", pick("t1", "t2"), pick("m1", "m2", "m3"), pick("a", "b"), pick("5", "6"), rng.random() < 0.6, rng.choice([0.5, 0.7, 0.9, 0.95])))
    schema = "pos long, platform string, order_id string, order_time string, merchant string, title string, paid_amount string, is_partial boolean, confidence double"
    df = spark.createDataFrame([(p, "jd", *r) for p, *r in rows], schema).repartition(4)
    groups = {}
    for r in sorted(rows):
        groups.setdefault(r[1], []).append(dict(zip(["order_id", "order_time", "merchant", "title", "paid_amount", "is_partial", "confidence"], r[1:])))
    want = {k: model(g) for k, g in groups.items()}
    for most in (1_000_000, 40):
        got = {r.order_id: r for r in dedupe_orders(df, most=most).collect()}
        assert {k: (r.title, r.merchant, r.order_time, r.paid_amount, r.confidence, r.is_partial, set(r.warnings), r.n_sources) for k, r in got.items()} == {
            k: (w["title"], w["merchant"], w["order_time"], w["paid_amount"], w["confidence"], w["is_partial"], w["warnings"], len(groups[k])) for k, w in want.items()
        }
        members = capture_members(df, most=most)
        assert members.count() == len(rows) and members.groupBy("dedupe_key").agg((F.count_distinct("place") == F.count("place")).alias("x")).filter("not x").count() == 0
    plan = dedupe_orders(df)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_key_of_very_many_captures_runs(spark):
    df = spark.range(300_000).selectExpr("id as pos", "'jd' as platform", "'same' as order_id", "concat('t', id % 1000) as title", "id % 3 = 0 as is_partial", "(id % 97) / 100.0D as confidence")
    r = dedupe_orders(df, most=20_000).first()
    assert (r.n_sources, r.pos, r.title, r.is_partial, r.confidence, r.warnings) == (300_000, 0, "t95", False, 0.96, ["conflict_title"])


def test_a_merged_record_competes_with_its_best_confidence(spark):
    rows = [(1, "jd", "o", "first", False, 0.80), (2, "jd", "o", "second", True, 0.95), (3, "jd", "o", "third", False, 0.90)]
    df = spark.createDataFrame(rows, "pos long, platform string, order_id string, title string, is_partial boolean, confidence double")
    assert dedupe_orders(df).first().title == "first"


def test_bank_dedupe_keeps_all_sources_and_is_idempotent(spark):
    rows = Fixtures(spark, "/root/testdata/sf0.001").statement_rows()
    once = dedupe_bank(rows).drop("dedupe_key", "n_sources").cache()
    assert dedupe_bank(rows).agg(F.sum("n_sources")).first()[0] == rows.count()
    members = bank_members(rows)
    assert members.count() == rows.count() and members.join(dedupe_bank(rows), "dedupe_key", "left_anti").count() == 0
    # filling blanks may give two groups the same fallback key, never more rows
    again = dedupe_bank(once)
    assert again.filter("transaction_reference <> ''").count() == once.filter("transaction_reference <> ''").count()


def test_bank_dedupe_conflicts_and_fills(spark):
    rows = [(1, "b", "1234", "s", "", "in", "5", "r1", 0.4), (2, "b", "1234", "s", "P", "in", "5", "r1", 0.9), (3, "b", "1234", "t", "Q", "in", "5", "r1", 0.1)]
    df = spark.createDataFrame(rows, "pos long, bank_key string, account_tail string, summary string, counterparty string, direction string, amount string, transaction_reference string, confidence double")
    r = dedupe_bank(df).first()
    assert (r.pos, r.counterparty, r.summary, r.confidence, r.warnings, r.n_sources) == (1, "P", "s", 0.9, ["conflict_counterparty", "conflict_summary"], 3)
    assert sorted(m.pos for m in bank_members(df).collect()) == [1, 2, 3]


def bank_model(rows, fields):
    """Sequential merging, row by row."""
    out = {}
    for pos, ref, *values, warned in sorted(rows, key=lambda r: r[0]):
        m = out.setdefault(ref, {"pos": pos, "n": 0, "w": set(warned or []), **dict.fromkeys(fields, "")})
        m["n"] += 1
        m["w"] |= set(warned or [])
        for f, v in zip(fields, values):
            if v:
                if m[f] and m[f] != v:
                    m["w"].add(f"conflict_{f}")
                m[f] = m[f] or v
    return {ref: (m["pos"], m["n"], *(m[f] for f in fields), sorted(m["w"])) for ref, m in out.items()}


def test_bank_dedupe_equals_sequential_merging(spark):
    rng, fields = random.Random(6), ["summary", "counterparty", "channel"]
    pick = lambda: rng.choice(["", " ", None, "x", "y", "é"])
    rows = [(pos, f"r{rng.choice([0, 0, 0, rng.randrange(40)])}", pick(), pick(), pick(), rng.choice([None, [], ["w"], ["v", "w"]])) for pos in rng.sample(range(1000), 300)]
    df = spark.createDataFrame([(p, "b", "1", "5", "in", *r) for p, *r in rows], "pos long, bank_key string, account_tail string, amount string, direction string, transaction_reference string, summary string, counterparty string, channel string, warnings array<string>")
    want = bank_model(rows, fields)
    for frame in (df, union_sources(df.filter("pos < 400"), df.filter("pos >= 400"))):
        got = {r.transaction_reference: (r.pos if isinstance(r.pos, int) else r.pos.pos, r.n_sources, *(r[f] for f in fields), r.warnings) for r in dedupe_bank(frame).collect()}
        assert got == want
    assert dedupe_bank(df.unionByName(df)).count() == len(want)  # rows that share a position are one source's place, each counted
    plan = dedupe_bank(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_min" in plan


def test_sources_are_listed_in_the_order_of_the_record(spark, monkeypatch):
    monkeypatch.setattr("ledgerlink.operators.dedupe.RUN", 7)
    rng = random.Random(4)
    rows = [(pos, "jd", f"o{rng.choice([0, 0, rng.randrange(5)])}", rng.choice(["", "t1", "t2"]), rng.random() < 0.6, rng.choice([0.5, 0.7, 0.9])) for pos in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "pos long, platform string, order_id string, title string, is_partial boolean, confidence double").repartition(4)
    groups = {}
    for pos, _, key, title, p, conf in sorted(rows):
        b = ((not p, conf, {f for f, v in (("order_id", key), ("title", title)) if v}), [pos])
        a = groups.get(key)
        better = a and (b[0][0], b[0][1], len(b[0][2])) > (a[0][0], a[0][1], len(a[0][2]))
        groups[key] = b if a is None else ((a[0][0] or b[0][0], max(a[0][1], b[0][1]), a[0][2] | b[0][2]), b[1] + a[1] if better else a[1] + b[1])
    for most in (1_000_000, 20):
        got = dedupe_orders(df, most=most, sources=True)
        assert {r.order_id: r.sources for r in got.collect()} == {k: v for k, (_, v) in groups.items()}
        plain = dedupe_orders(df, most=most)
        assert Counter(map(str, got.drop("sources").collect())) == Counter(map(str, plain.collect()))


def test_dedupe_orders_returns_its_sources():
    assert "sources" in SQL["dedupe_orders"]
