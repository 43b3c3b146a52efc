"""The keyword index against the chain of conditions, and lookups by precedence."""

import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerlink.operators import rules
from ledgerlink.operators.category_rules import CATEGORY_RULES, DEFAULTS


def texts(spark, rng, words, n=300):
    rows = [(i, "".join(rng.choice([*words, "x", "é", " ", "超"]) for _ in range(rng.randrange(6))), rng.choice(["inflow", "outflow", "unknown", None])) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "", "inflow"), (n + 1, None, "outflow")], "pos long, merchant string, direction string")


def both(df, table):
    chain = df.withColumn("_rule", rules.classify_by_case(df, table, rules.rule_text(df), F.col("direction"), lambda r: F.lit(r["category"])))
    index = rules.classify_by_index(df, table, rules.rule_text(df), F.col("direction"), "category: string").withColumn("_rule", F.col("_rule.category"))
    assert Counter(map(tuple, chain.collect())) == Counter(map(tuple, index.collect()))


def test_index_equals_the_chain(spark):
    rng = random.Random(2)
    every = rules.numbered([*CATEGORY_RULES, *DEFAULTS])
    table = [{**{k: r[k] for k in ("pos", "priority", "keywords", "direction")}, "category": str(r["pos"])} for r in every]
    both(texts(spark, rng, [k for r in table for k in r["keywords"]]), table)
    letters = "ab é超"
    for n in (1, 40, 300):
        made = [
            {"pos": p, "priority": rng.randrange(4), "keywords": ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(3))], "direction": rng.choice([None, "", "inflow", "outflow"]), "category": str(p)}
            for p in range(n)
        ]
        both(texts(spark, rng, [k for r in made for k in r["keywords"]] or ["a"]), made)


def test_many_keywords_take_the_index(spark):
    df = texts(spark, random.Random(1), [k for r in CATEGORY_RULES for k in r.keywords], 60).withColumns({"counterparty": F.lit(""), "title": F.lit("")})
    want = rules.classify(df).collect()
    known, rules.CHAINED = rules.CHAINED, 0
    try:
        got = rules.classify(df)
        assert got.collect() == want and "CASE WHEN (contains" not in got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        rules.CHAINED = known


def test_precedence_keeps_repeated_rows_apart(spark):
    files = [("a/Special.PDF", "b1"), ("a/Special.PDF", "b1"), ("x/fr/y.csv", "b1"), ("x/z.csv", "b1"), ("x/z.csv", "b9"), ("x/z.zip", None), ("none", None), (None, None), ("x/fr/y.csv", "b1")]
    lookup = [("filename", "special.pdf", 7, 0), ("pattern", "/FR/", 2, 1), ("pattern", "y", 3, 2), ("bank", "b1", 1, 3), ("bank", "b1", 8, 4), ("type", ".csv", 4, 5), ("type", "csv", 5, 6), ("pattern", "", 9, 9)]
    schema = "kind string, key string, candidate_count int, pos int"
    df = spark.createDataFrame(files, "path string, bank_key string")
    got = Counter(map(tuple, rules.resolve_by_precedence(df, spark.createDataFrame(lookup, schema)).collect()))
    want = [("filename", 7), ("filename", 7), ("pattern:/FR/", 2), ("bank:b1", 1), ("type:.csv", 4), ("", 0), ("", 0), ("", 0), ("pattern:/FR/", 2)]
    assert got == Counter((*f, *w) for f, w in zip(files, want))
    out = rules.resolve_by_precedence(df, spark.createDataFrame([*lookup, ("default", "", 6, 8)], schema))
    assert Counter(r.source for r in out.collect()) == Counter(w[0] or "default" for w in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("BroadcastNestedLoopJoin") <= 2 and "CartesianProduct" not in plan
