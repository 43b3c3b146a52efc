"""The filter audit and the clustering against plain versions, and edge rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerlink.llm import centroids
from ledgerlink.llm.filter_audit import filter_audit

DOC = "doc_id long, text string, lang string, source string, mask int, n int, part string, good string"
LABEL = "doc_id long, quality int, toxic int"


def brute_audit(docs, labels):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = defaultdict(Counter)
    for i, t, lang, *_ in docs:
        t, part = t or "", lang or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        good = any(q == 1 for d, q, _ in labels if d == i and i is not None)
        toxic = any(x == 1 for d, _, x in labels if d == i and i is not None)
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = True
            for step, f in enumerate(order, 1):
                c = out[part, order, step]
                gone = alive and fails[f]
                c["redundant"] += not alive and fails[f]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["removed"] += gone
                c["good_lost"] += gone and good
                c["toxic_lost"] += gone and toxic
                alive = alive and not fails[f]
                c["kept"] += alive
                out[part, f]["shapley"] += gone
    return {k: tuple(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) + (out[k[0], k[1][k[2] - 1]]["shapley"],) for k, c in out.items() if len(k) == 3}


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "cé", "Dd", "x" * 9, "#", "é é"])
    texts = [rng.choice(["", " ", "\t"]).join([]) + " ".join(f"{word()}{rng.randrange(n)}" for _ in range(n)) for n in (1, 5, 150, 199, 200, 201, 400, 400)] + ["w " * 250, "", None, " \n"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""]), "s", 1, 2, "p", "g") for i in rng.sample(range(500), 120)]
    docs += [docs[0], docs[0], (None, docs[1][1], "en", "s", 1, 2, "p", "g"), (None, None, None, None, 1, 2, "p", "g")]
    labels = [(d[0], rng.randrange(2), rng.choice([0, 1, None])) for d in docs[:60]] + [(docs[0][0], 1, 1), (None, 1, 1), (9999, 1, 1)]
    got = filter_audit(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(labels, LABEL))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    assert filter_audit(spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)).count() == 0
    rows = filter_audit(spark.createDataFrame([(1, "x", "en", "s", 1, 2, "p", "g")], DOC), spark.createDataFrame([], LABEL)).collect()
    assert len(rows) == 600 and {r.removed for r in rows if r.filter_order[0] == "A" and r.step == 1} == {1}


def test_audit_counts_copies_before_they_meet(spark):
    docs, labels = spark.createDataFrame([(1, "x", "en", "s", 1, 2, "p", "g")], DOC), spark.createDataFrame([(1, 1, 0)], LABEL)
    plan = filter_audit(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan and "partial_min_by" in plan


def lloyd(rows):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**40 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in named[:8]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))
    for _ in range(10):
        of = defaultdict(list)
        for _, v in kept:
            of[nearest(v)[1]].append(v)
        cents = [[sum(col) // len(of[k]) for col in zip(*of[k])] if of[k] else c for k, c in enumerate(cents)]
    last = [(i, *nearest(v)) for i, v in kept]
    by = Counter()
    for _, d, k in last:
        by[k] += d
    fit = lambda x: x if x < 1 << 63 else None
    return Counter((i, k, fit(d), fit(by[k]), fit(sum(by.values())), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, d, k in last)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 7, "c") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, chunk string")


def test_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(centroids, "CHUNK", 16)
    rng = random.Random(8)
    spots = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(spots)]) for i in range(150)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (900, [0.5] * 63), (901, None), (902, [0.1] * 63 + [None]), (903, [0.1] * 63 + [float("nan")]), (904, [float("inf")] + [0.1] * 63), (905, [0.5] * 64), (906, [0.5] * 64)]
    got = centroids.cluster(frame(spark, rows).repartition(3))
    assert Counter(map(tuple, got.collect())) == lloyd(rows)


def test_clusters_of_large_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1e30, -3e5, 2.5, 1e300 * 5]) for _ in range(64)]) for i in range(30)] + [(100 + i, [200000.25 * (i % 3)] * 64) for i in range(12)]
    assert Counter(map(tuple, centroids.cluster(frame(spark, rows)).collect())) == lloyd(rows)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0] * 64), (2, [1.0] * 64), (None, [3.0] * 64)]
    assert Counter(map(tuple, centroids.cluster(frame(spark, rows, "float")).collect())) == lloyd(rows)
    assert centroids.cluster(frame(spark, [(1, [1.0])])).collect() == [] and centroids.cluster(frame(spark, [])).count() == 0
    assert centroids.cluster(frame(spark, [(None, [1.0] * 64)])).filter(F.col("cluster").isNotNull()).count() == 0
