"""Running values of groups dealt over many tasks, against the same of one window."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlink.operators import windows
from ledgerlink.operators.scans import running


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(4)
    heads = ["# part", "## sub", "| **a** | x |", "| b | y |", "| --- |", "plain thre", "qu", ""]
    rows = [("big", n, rng.choice(heads) + str(rng.randrange(3))) for n in range(900)] + [(f"s{n % 7}", n, rng.choice(heads)) for n in range(100)] + [(None, n, "| b |") for n in range(5)]
    return spark.createDataFrame(rows, "doc string, at long, text string").repartition(5).withColumn("flag", F.col("text").startswith("qu"))


def rows(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_running_values_equal_one_window(lines):
    values = {
        "n": ("sum", F.lit(1)), "m": ("max", F.when(F.col("flag"), F.col("at"))), "b": ("or", F.when(F.col("at") % 3 == 0, F.expr("shiftleft(1, cast(at % 20 as int))"))),
        "t": ("last", F.when(F.col("text").startswith("#"), F.col("text"))), "s": ("sum", F.when(F.col("at") > 400, F.length("text"))),
    }
    plain = rows(running(lines, ["doc"], ["at"], **values))
    assert plain == rows(running(lines, ["doc"], ["at"], most=37, **values)) == rows(running(lines, ["doc"], ["at"], most=1, **values))
    first = next(r for r in running(lines, ["doc"], ["at"], most=37, **values).collect() if r.doc == "big" and r["at"] == 0)
    assert (first.n, first.m, first.b, first.t, first.s) == (None,) * 5


def test_window_operators_on_dealt_groups(lines):
    def all_of(most):
        return [
            rows(windows.running_flag(lines, "doc", "at", "flag", most)),
            rows(windows.section_rows(lines, "doc", "at", "text", r"^# (.*)$", r"^## (.*)$", most=most)),
            rows(windows.bounded_snapshot(lines, "doc", "at", "text", 60, most)),
            rows(windows.bounded_snapshot(lines, "doc", "at", "text", 5000, most)),
            rows(windows.coverage_sample(lines, "doc", "at", "text", 20, ["thre", "qu"], largest=most)),
        ]

    assert all_of(1_000_000) == all_of(50)
    assert all(all_of(50))


def test_running_over_nothing(lines):
    empty = lines.filter("at < 0")
    assert windows.running_flag(empty, "doc", "at", "flag").count() == 0 and windows.coverage_sample(empty, "doc", "at", "text", 20, ["qu"]).count() == 0
