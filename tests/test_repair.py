"""Hand fixtures: timelines, masking, refill, constraints, splits."""

import warnings

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from twinlens.model import Relationship
from twinlens.operators import constraints, pii, profile, refill, scd, split

SCD = [
    ("a", "2020-01-01", "2020-06-01", "Y", 1), ("a", "2020-03-01", "2020-04-01", "Y", 2),
    ("a", "2020-03-01", None, "N", 3), ("a", "2021-01-01", "2021-02-01", "Y", 4),
    ("b", "2020-05-05", "2022-01-01", "N", 5),
    ("c", "2020-02-02", None, "N", 6), ("c", "not a date", None, "Y", 7),
    (None, "2020-01-10", None, "N", 8), (None, "2020-01-20", None, "N", 9),
]


def repaired(spark, **options):
    df = spark.createDataFrame(SCD, "key string, eff string, fin string, cur string, seq long")
    out, note = scd.repair_scd_timeline(df, "key", "eff", "fin", "seq", "cur", **options)
    assert note == ""
    return {r["seq"]: (r["eff"], r["fin"], r["cur"]) for r in out.collect()}


def test_timeline_tiles(spark):
    rows = repaired(spark)
    last = "2022-01-01"  # the latest end date anywhere in the table
    assert rows == {
        1: ("2020-01-01", "2020-03-01", "N"), 2: ("2020-03-01", "2020-03-01", "N"),
        3: ("2020-03-01", "2021-01-01", "N"), 4: ("2021-01-01", last, "Y"),
        5: ("2020-05-05", last, "Y"),
        6: ("2020-02-02", "", "N"), 7: ("", last, "Y"),
        8: ("2020-01-10", "2020-01-20", "N"), 9: ("2020-01-20", last, "Y"),
    }


def test_timeline_is_idempotent_with_open_value(spark):
    df = spark.createDataFrame(SCD, "key string, eff string, fin string, cur string, seq long").where("eff <> 'not a date'")
    once, _ = scd.repair_scd_timeline(df, "key", "eff", "fin", "seq", "cur", open_value="2999-12-31")
    twice, _ = scd.repair_scd_timeline(once, "key", "eff", "fin", "seq", "cur", open_value="2999-12-31")
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)


def test_timeline_leaves_mangled_dates_alone(spark):
    df = spark.createDataFrame([("a", "43:45.2", "00:00.0", 1), ("a", "12:00.1", "00:00.0", 2)], "key string, eff string, fin string, seq long")
    out, note = scd.repair_scd_timeline(df, "key", "eff", "fin", "seq")
    assert note and out is df
    _, note = scd.repair_scd_timeline(df, "key", "nope", "fin", "seq")
    assert "nope" in note
    with pytest.raises(ValueError):
        scd.repair_scd_timeline(df, "key", "eff", "fin", "nope")


def test_next_version_with_a_hot_key_equals_the_plain_window(spark):
    rows = spark.range(3000).select(
        F.when(F.pmod("id", F.lit(3)) == 0, 0).otherwise(F.pmod("id", F.lit(50))).alias("k"),
        F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(400)) * 7200).alias("e"),
        F.col("id").alias("seq"),
    )
    window = Window.partitionBy("k").orderBy("e", "seq")
    want = rows.select("seq", F.lead("e").over(window).alias("n"), F.lead("seq").over(window).isNull().alias("l"))
    got = scd.with_next_version(rows, "k", "e", "seq").select("seq", F.col("__next").alias("n"), F.col("__last").alias("l"))
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_usable_dates(spark):
    rows = [(i, "43:45.2", "2024-01-01", f"2024-01-{i + 1:02d}", f"2024-01-{i + 1:02d}" if i < 7 else "x") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, d string")
    found = {r["column"]: r["dt_frac"] for r in profile.usable_dates(df, ["a", "b", "c", "d"]).collect()}
    assert found == {"a": 0.0, "b": 0.0, "c": 1.0, "d": 0.7}


def test_value_kinds(spark):
    columns = {
        "mail": [f"p{i}@x.org" for i in range(10)],
        "mostly": [f"p{i}@x.org" for i in range(6)] + ["-"] * 4,
        "hardly": [f"p{i}@x.org" for i in range(5)] + ["-"] * 5,
        "zip": ["12345", "K1A 0B1"] * 5,
        "phone": ["(613) 555-0199"] * 10,
        "place": ["12 Elm Street"] * 10,
        "few": ["a@b.org"] * 4 + [None] * 6,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns))
    kinds = {r["column"]: r["kind"] for r in pii.value_shapes(df, list(columns)).collect()}
    assert kinds == {"mail": "email", "mostly": "email", "hardly": None, "zip": "postal", "phone": "phone", "place": "street", "few": None}


def test_detection_by_name(spark):
    df = spark.createDataFrame([(1, "x", "y", "z", 5)], "PHONE_NO int, PREFIX_NAME_TP_CD string, LAST_NAME string, note string, USER_NM int")
    assert pii.detect_pii(df) == {"PHONE_NO": "phone", "LAST_NAME": "name"}


def test_fakes_match_their_shapes_and_missing_rate(spark):
    df = spark.range(4000).withColumn("x", F.lit("real"))
    for kind, shape in (("email", pii.EMAIL), ("postal", pii.POSTAL), ("street", pii.STREET), ("phone", pii.PHONE)):
        out = pii.fake_column(df, "x", kind, F.col("id"), 0.25, seed=1)
        row = out.agg(F.avg(F.col("x").isNull().cast("double")).alias("missing"), F.bool_and(F.col("x").rlike(shape)).alias("ok")).first()
        assert row["ok"] and abs(row["missing"] - 0.25) < 0.03


def test_refill_keeps_values_and_missing_rate(spark):
    real = spark.range(2000).select("id", F.when(F.pmod("id", F.lit(4)) != 0, F.concat(F.lit("v"), "id")).alias("name"))
    synth = spark.range(5000, 9000).select(F.col("id").alias("row"))
    out = refill.refill(synth, real, ["name"], F.col("row"), F.col("id"))
    assert out.count() == 4000
    assert out.join(real.select("name"), "name", "left_anti").where("name is not null").count() == 0
    assert abs(out.where("name is null").count() / 4000 - 0.25) < 0.03


def test_refill_does_not_depend_on_partitions(spark):
    real = spark.range(500).select("id", (F.col("id") * 3).alias("v"))
    results = []
    for n in (1, 4, 16):
        out = refill.refill(real.select("id").repartition(n), real.repartition(n), ["v"], F.col("id"), F.col("id"))
        results.append(sorted(map(tuple, out.collect())))
    assert results[0] == results[1] == results[2]


def test_constraints(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0, 4, "a", "x"), (2.0, 2.0, 3.0, 5, "a", "y"), (None, 2.0, 1.0, 10, "b", "x"), (3.0, 2.0, 9.0, 15, None, "x")],
        "l double, m double, h double, n long, s string, t string",
    )
    real = spark.createDataFrame([("a", "x")], "s string, t string")
    specs = [
        {"table": "T", "type": "inequality", "low": "l", "high": "m"},
        {"table": "T", "type": "range", "low": "l", "middle": "m", "high": "h"},
        {"table": "T", "type": "fixed-increments", "column": "n", "increment": 5},
        {"table": "T", "type": "fixed_combinations", "columns": ["s", "t"]},
        {"table": "OTHER", "type": "inequality", "low": "l", "high": "m"},
        {"table": "T", "type": "nonsense"}, {"table": "T", "type": "range", "low": "l"},
    ]
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        rules = constraints.build_constraints(specs, "T")
    assert len(rules) == 4 and len(caught) == 2
    found = {r["type"]: r["violations"] for r in constraints.check_constraints(rules, df, real).collect()}
    assert found == {"inequality": 1, "range": 3, "fixed_increments": 1, "fixed_combinations": 2}


def test_relational_split(spark):
    parent = spark.range(1000).select(F.col("id").alias("pk"))
    child = spark.range(4000).select(
        "id", F.when(F.pmod("id", F.lit(10)) == 0, None).when(F.pmod("id", F.lit(10)) == 1, F.col("id") + 5000).otherwise(F.pmod("id", F.lit(1000))).alias("fk")
    )
    rel = Relationship("P", "pk", "C", "fk")
    train, hold = split.split_relational({"C": child, "P": parent}, [rel], {"P": F.col("pk"), "C": F.col("id")})
    assert train["P"].count() + hold["P"].count() == 1000 and train["C"].count() + hold["C"].count() == 4000
    assert 180 < hold["P"].count() < 320
    straddling = train["C"].join(hold["P"], F.col("fk") == F.col("pk")).count() + hold["C"].join(train["P"], F.col("fk") == F.col("pk")).count()
    assert straddling == 0


def test_a_fixed_combination_is_parsed_once_per_row(spark):
    rows = [(1, "a", None, 2.5), (2, None, None, None), (3, "x\"y", "2024-01-02", -0.0)]
    df = spark.createDataFrame(rows, "id long, s string, d string, x double").withColumn("d", F.col("d").cast("date"))
    rules = constraints.build_constraints([{"table": "t", "type": "fixed_combinations", "columns": ["s", "d", "x"]}], "t")
    made = constraints.encode_constraints(df, rules).withColumn("__combo_s_d_x", F.when(F.col("id") < 4, F.col("__combo_s_d_x")))
    back = constraints.decode_constraints(made, rules, df)
    assert back._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    gone = constraints.decode_constraints(made.withColumn("__combo_s_d_x", F.lit(None).cast("string")), rules, df)
    assert gone.count() == 3 and gone.where("s is null and d is null and x is null").count() == 3
