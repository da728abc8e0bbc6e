"""Results that must not depend on how many values, numbers, keys or pairs a table has."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from twinlens.model import ColumnRoles
from twinlens.operators import fidelity, lookup, privacy, roles, synth


def test_copula_keeps_the_correlation_of_wide_categories(spark):
    """5,000 categories that rise with a number, one of them missing at times."""
    rows = spark.range(40_000).select(
        F.lpad((F.floor(F.rand(3) * 5000)).cast("string"), 5, "0").alias("c"), F.rand(4).alias("e"), "id"
    )
    df = rows.select("id", F.when(F.col("id") % 10 != 0, F.col("c")).alias("c"), (F.col("c").cast("double") + 1500 * F.col("e")).alias("x"))
    model = synth.fit_gaussian_copula(df, ColumnRoles(["x"], ["c"]))
    assert [m.in_spark for m in model.marginals] == [False, True] and model.correlation[0, 1] > 0.9
    copy = synth.sample_gaussian_copula(spark, model, 0.5, 5)
    numbers = copy.select("x", F.col("c").cast("double").alias("c"))
    assert numbers.count() == 20_000
    assert numbers.dropna().stat.corr("x", "c") > 0.9
    assert abs(numbers.where("c is null").count() / 20_000 - 0.1) < 0.02
    assert copy.where("c is not null").join(df.select("c").distinct(), "c", "left_anti").count() == 0
    again = synth.sample_gaussian_copula(spark, model, 0.5, 5)
    assert again.exceptAll(copy).count() == 0


def test_wide_and_short_categories_give_one_copy(spark, monkeypatch):
    df = spark.range(6000).select(F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(30))).alias("c"), (F.col("id") % 100).cast("double").alias("x"))
    shapes = ColumnRoles(["x"], ["c"])
    short = synth.sample_gaussian_copula(spark, synth.fit_gaussian_copula(df, shapes), 1.0, 2, keep_id="i")
    monkeypatch.setattr(synth, "short_tables", lambda counts: {})
    wide = synth.sample_gaussian_copula(spark, synth.fit_gaussian_copula(df, shapes), 1.0, 2, keep_id="i")
    differ = short.alias("s").join(wide.alias("w"), "i").where("s.c <> w.c").count()
    assert wide.count() == 6000 and differ < 60  # a rounding at the edge of a step at most


def plain_generalized(real, attacker, k):
    found = []
    for target in real:
        near = Counter()
        for row in attacker:
            near[sum(a != b for a, b in zip(target[:k], row[:k], strict=True)), row[k] == target[k]] += 1
        least = min(d for d, _ in near)
        found.append(near[least, True] / (near[least, True] + near[least, False]))
    return len(real), 1 - sum(found) / len(found)


@pytest.mark.parametrize("keys", [1, 3, 8])
def test_nearest_key_attack_with_many_keys(spark, keys):
    rng = random.Random(keys)
    def rows(n):
        return [tuple(rng.choice(["a", "b", None, "c"] if i % 2 else ["x", "x", "x", "y"]) for i in range(keys)) + (rng.choice("st"),) for _ in range(n)]

    real, attacker = rows(60), rows(80)
    names = [f"q{i}" for i in range(keys)]
    schema = ", ".join(f"{c} string" for c in [*names, "secret"])
    got = privacy.generalized_cap(spark.createDataFrame(real, schema), spark.createDataFrame(attacker, schema), names, "secret").first()
    n, score = plain_generalized(real, attacker, keys)
    assert got["n_matched"] == n and got["score"] == pytest.approx(score)


def test_all_categories_are_keys(spark):
    df = spark.createDataFrame([(str(i % 2), str(i % 3), str(i % 5), str(i % 7), str(i % 4)) for i in range(80)], "a string, b string, c string, d string, e string")
    assert privacy.pick_sensitive(df, list("abcde"), "e")[1] == list("abcd")
    assert privacy.pick_sensitive(df, list("abcde"), "e", most_keys=2)[1] == ["a", "b"]


def test_look_alikes_of_a_table_with_twelve_numbers(spark):
    rng = random.Random(2)
    names = [f"x{i}" for i in range(12)]
    real = [tuple(rng.choice([0.0, None, rng.gauss(50, 20)]) if i % 4 == 0 else rng.gauss(100, 30) for i in range(12)) for _ in range(300)]
    copies = []
    for _ in range(200):
        base = list(rng.choice(real))
        spread = rng.choice([0.004, 0.009, 0.03])
        copies.append(tuple(None if v is None else v * (1 + rng.uniform(-spread, spread)) for v in base))
    copies += copies[:20]

    def alike(c, r):
        return all((a is None and b is None) or (a is not None and b is not None and abs(a - b) <= 0.01 * abs(a)) for a, b in zip(c, r, strict=True))

    want = sum(any(alike(c, r) for r in real) for c in copies)
    schema = ", ".join(f"{c} double" for c in names)
    frames = [spark.createDataFrame(x, schema) for x in (real, copies)]
    got = privacy.new_row_synthesis(*frames, ColumnRoles(names, [])).first()
    assert 0 < want < 220 and (got["n_rows"], got["n_matched"]) == (220, want)


def test_few_values_stops_early_and_counts_exactly(spark):
    df = spark.range(5000).select(
        (F.col("id") % 50).cast("string").alias("fifty"), (F.col("id") % 51).cast("string").alias("more"), F.col("id").cast("string").alias("all"),
        F.lit(None).cast("string").alias("none"), F.concat(F.lit("z" * 80), F.col("id") % 3).alias("long"),
    )
    found = {r["column"]: r["n"] for r in roles.few_values(df.repartition(3), df.columns, 50).collect()}
    assert found == {"fifty": 50, "more": 51, "all": 51, "long": 3}
    plan = roles.classify_frame(df)
    assert {r["column"]: r["role"] for r in plan.collect()}["more"] == "skipped"
    assert roles.few_values(df.where("false"), ["all"], 50).count() == 0


@pytest.mark.parametrize("held", [1_000_000, 50])
def test_pair_tallies_equal_plain_counts(spark, monkeypatch, held):
    monkeypatch.setattr(fidelity, "_CELLS_HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    rng = random.Random(1)
    rows = [(rng.choice([None, 0, 1, 2, 5]), rng.choice("abc"), rng.choice([None, "x", "y"]), rng.choice([0.0, 1.0, 9.0])) for _ in range(900)]
    other = [(rng.choice([None, 0, 4]), rng.choice("ab"), rng.choice([None, "x"]), rng.choice([0.0, 5.0])) for _ in range(300)]
    schema = "a int, b string, c string, x double"
    pairs = list(combinations("abc", 2)) + [("x", "b"), ("x", "c")]
    try:
        got = fidelity.contingency_similarity(spark.createDataFrame(rows, schema), {"s": spark.createDataFrame(other, schema)}, pairs, ["x"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def shares(data, pair):
        places = ["abcx".index(c) for c in pair]
        cells = Counter(tuple(min(int(r[p] / 9.0 * 10), 9) if p == 3 else r[p] for p in places) for r in data)
        return {k: n / len(data) for k, n in cells.items()}

    assert len(got) == len(pairs)
    for r in got:
        a, b = (shares(x, (r["column_1"], r["column_2"])) for x in (rows, other))
        assert r["score"] == pytest.approx(1 - sum(abs(a.get(k, 0) - b.get(k, 0)) for k in {*a, *b}) / 2)


def test_value_tables_agree_however_they_are_kept(spark):
    df = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("c"))
    counts = lookup.value_counts(df, ["c"])
    assert lookup.short_tables(counts) == {}
    assert lookup.short_tables(lookup.value_counts(df.where("c < '12'"), ["c"]))["c"][0] == ("0", 2)
