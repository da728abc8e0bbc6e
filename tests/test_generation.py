"""Generators: resemblance, foreign keys by construction, reproducibility, end to end."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.functions.normal import normal_cdf, normal_quantile
from twinlens.model import ColumnRoles, Relationship, TableMeta
from twinlens.operators import fidelity, privacy, structure, synth, utility
from twinlens.operators.roles import apply_schema_overrides, classify_columns
from twinlens.plans.evaluate import EvaluationConfig, evaluate
from twinlens.plans.privacy import privacy_report
from twinlens.plans.report import FRAMES, report_columns
from twinlens.session import side_by_side
from twinlens.sources import tables as io

SF = "/root/testdata/sf0.001"


def test_normal_functions():
    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.999])
    assert normal_quantile(p)[3] == pytest.approx(0.0, abs=1e-9)
    assert normal_quantile(np.array([0.975]))[0] == pytest.approx(1.959964, abs=1e-5)
    assert normal_cdf(normal_quantile(p)) == pytest.approx(p, abs=1e-6)


def test_copula_resembles_and_repeats(spark):
    roles = ColumnRoles(["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linenumber"])
    df = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn(
        "l_discount", F.when(F.pmod("l_partkey", F.lit(5)) != 0, F.col("l_discount"))
    )
    model = synth.fit_gaussian_copula(df, roles)
    copy = synth.sample_gaussian_copula(spark, model, 1.0, 3)
    assert copy.count() == df.count()
    shapes = fidelity.column_shapes(df, {"s": copy}, roles.numeric, roles.categorical).collect()
    assert min(r["score"] for r in shapes) > 0.9
    trends = fidelity.column_pair_trends(df, {"s": copy}, roles.numeric, roles.categorical).collect()
    assert np.mean([r["score"] for r in trends]) > 0.9
    missing = copy.where("l_discount is null").count() / copy.count()
    assert abs(missing - 0.2) < 0.03
    again = synth.sample_gaussian_copula(spark, model, 1.0, 3)
    assert copy.exceptAll(again.repartition(3)).count() == 0
    assert copy.schema["l_linenumber"].dataType == df.schema["l_linenumber"].dataType


def test_hierarchy_keeps_foreign_keys(spark):
    real = {t.upper(): spark.read.parquet(f"{SF}/{t}.parquet") for t in ("customer", "orders")}
    rel = Relationship("CUSTOMER", "c_custkey", "ORDERS", "o_custkey")
    roles = {"CUSTOMER": ColumnRoles(["c_acctbal"], ["c_mktsegment"]), "ORDERS": ColumnRoles(["o_totalprice"], ["o_orderstatus"])}
    made = synth.sample_hierarchical(real, [rel], roles, {"ORDERS": "o_orderkey"}, seed=1)
    row = structure.referential_integrity([rel], made, {}).first()
    assert row["fk_coverage"] == 1.0
    orders = made["ORDERS"]
    assert orders.select("o_orderkey").distinct().count() == orders.count()
    assert 0.7 < orders.count() / real["ORDERS"].count() < 1.3
    assert structure.cardinality_shape([rel], real, {"s": made}).first()["score"] > 0.85


def family_tables(spark):
    """20,000 parents, one of them with half of all children."""
    parents = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    child = spark.range(40_000).select(
        F.col("id").alias("c"), F.when(F.col("id") < 20_000, F.lit(5)).otherwise(F.col("id") - 20_000).alias("fk"),
        F.rand(1).alias("low"), (F.rand(1) + F.rand(2)).alias("high"), (F.col("id") % 50).alias("other"),
    )
    second = spark.range(60).select(F.col("id").alias("o"), F.rand(3).alias("w"))
    return {"P": parents, "C": child, "Q": second}


def test_hot_parent_two_parents_and_constraints(spark):
    real = family_tables(spark)
    real["C"] = real["C"].withColumn("other", F.when(F.col("c") % 10 != 0, F.col("other")))
    rels = [Relationship("P", "k", "C", "fk"), Relationship("Q", "o", "C", "other")]
    roles = {"P": ColumnRoles(["v"], []), "Q": ColumnRoles(["w"], []), "C": ColumnRoles(["low", "high"], [])}
    spec = {"table": "C", "type": "inequality", "low": "low", "high": "high"}
    made = synth.sample_hierarchical(real, rels, roles, {"C": "c"}, seed=2, constraints=[spec], keep_id="n")
    copy = made["C"]
    assert copy.columns == ["n", "c", "fk", "low", "high", "other"]
    assert copy.count() == 40_000 and copy.where("low > high").count() == 0
    assert copy.select("c").distinct().count() == 40_000 and copy.agg(F.max("c")).first()[0] == 39_999
    for row in structure.referential_integrity(rels, made, {}).collect():
        assert row["fk_coverage"] == 1.0
    for key in ("fk", "other"):
        sizes = [sorted(r["count"] for r in df.where(f"{key} IS NOT NULL").groupBy(key).count().collect()) for df in (real["C"], copy)]
        assert sizes[0] == sizes[1]
    twice = synth.sample_hierarchical(real, rels, roles, {"C": "c"}, scale=2.0)["C"]
    assert abs(twice.count() - 80_000) <= 4_000


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(synth._permuted(np.arange(n), n, 7)) == list(range(n))


def test_copies_do_not_depend_on_the_layout(spark):
    df = spark.range(500).select("id", (F.col("id") % 11).alias("code"), F.rand(1).alias("v"))
    child = spark.range(900).select(F.col("id").alias("cid"), (F.col("id") % 500).alias("fk"), F.rand(2).alias("u"))
    job = synth.SuiteInput(
        {"T": df, "C": child}, {"T": ColumnRoles(["v"], ["code"]), "C": ColumnRoles(["u"], [])},
        {"T": F.col("id"), "C": F.col("cid")}, [Relationship("T", "id", "C", "fk")], {"T": "id", "C": "cid"}, row_id="n",
    )
    names = ["hierarchical", "gaussiancopula", "bootstrap"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    found = []
    try:
        for parts in (2, 5):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(synth.generate_suite(job, names))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for name in names:
        for table in ("T", "C"):
            # sums of doubles may differ in their last digits
            one, two = (f[name][table].withColumns({c: F.round(c, 6) for c in "uv" if c in f[name][table].columns}) for f in found)
            assert one.exceptAll(two).count() == 0


def test_table_with_one_modelable_column(spark):
    from twinlens.operators import utility

    df = spark.range(60).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("only"))
    rows = utility.tstr(df, df, {"copy": df}, ColumnRoles([], ["only"]), "only", "classification").collect()
    assert rows and all(r["score"] is None and r["note"] for r in rows)


def test_csv_keeps_line_breaks(spark, tmp_path):
    rows = [(1, 'a\nb "quoted", c'), (2, " \r\n padded "), (3, "plain")]
    io.write_table(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "out"))
    back = io.read_tables(spark, [str(tmp_path / "out")])["OUT"]
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_sibling_share(spark):
    rows = spark.range(2000).select(F.pmod("id", F.lit(100)).alias("k"), F.randn(1).alias("noise"), F.col("id"))
    df = rows.select("k", (F.sin(F.col("k") * 12.9) * 2).alias("same"), F.col("noise").alias("free"))
    model = synth.fit_gaussian_copula(df, ColumnRoles(["same", "free"], []), "k")
    assert model.sibling_share[0] > 0.9 and model.sibling_share[1] < 0.1


def test_suite_skips_failures(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("v"))
    job = synth.SuiteInput({"T": df}, {"T": ColumnRoles(["v"], [])}, {"T": F.col("id")}, primary_keys={"T": "id"})
    with pytest.warns(UserWarning):
        suite = synth.generate_suite(job, ["ctgan", "bootstrap", "GaussianCopula"])
    assert set(suite) == {"bootstrap", "GaussianCopula"}
    assert suite["GaussianCopula"]["T"].columns == ["id", "v"]
    assert synth.generate_suite(job, ["bootstrap"], should_cancel=lambda: True) == {}


def test_score_correlation_within_tasks(spark):
    """Sums of the tasks give the pairwise-complete correlation of the scores; a constant column has none."""
    rows = [(float(i % 37), float((i * 7) % 37 + i % 3) if i % 5 else None, "abc"[i % 3] if i % 4 else None, 2.0) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, y double, c string, one double").repartition(5)
    marginals, _, steps = synth._fit_marginals(df, ColumnRoles(["x", "y", "one"], ["c"]))
    found = synth._score_correlation(df, marginals, steps)
    scores = synth.normal_scores(df, marginals, [], steps).toPandas()
    assert scores["y"].isna().sum() == 80 and scores["c"].isna().sum() == 100
    expected = scores.drop(columns="one").corr()
    names = [m.column for m in marginals]
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            want = float(a == b) if "one" in (a, b) else expected.loc[a, b]
            assert abs(found[i, j] - want) < 1e-9


def test_constrained_copula(spark):
    df = spark.range(400).select("id", F.rand(1).alias("low"), (F.rand(1) + F.rand(2)).alias("high"))
    spec = {"table": "T", "type": "inequality", "low": "low", "high": "high"}
    job = synth.SuiteInput({"T": df}, {"T": ColumnRoles(["low", "high"], [])}, {"T": F.col("id")}, primary_keys={"T": "id"}, constraints=[spec])
    copy = synth.generate_suite(job, ["gaussiancopula"])["gaussiancopula"]["T"]
    assert copy.count() == 400 and copy.where("low > high").count() == 0


def test_roles_and_overrides(spark):
    df = spark.createDataFrame(
        [(i, f"n{i}", i % 3, float(i), "1", f"2024-01-0{i % 9 + 1}", i % 2 == 0) for i in range(60)],
        "CONT_ID long, LAST_NAME string, GENDER_TP_CD int, amount double, X_IND string, START_DT string, paid boolean",
    )
    roles = classify_columns(df)
    assert roles.categorical == ["GENDER_TP_CD", "X_IND"] and roles.numeric == ["amount"]
    assert set(roles.skipped) == {"CONT_ID", "LAST_NAME", "START_DT", "paid"}  # 'paid' ends in an id word
    changed, meta = apply_schema_overrides(df, TableMeta({"amount": "numerical", "X_IND": "categorical"}), {"X_IND": "numerical"}, "CONT_ID")
    assert meta.sdtypes["CONT_ID"] == "id" and changed.schema["X_IND"].dataType.typeName() == "double"


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('id,score,flag,note\n1,2.5,true,"a, b"\n2,NA,false,null\n3,4,true,ok\n')
    df = io.read_tables(spark, [str(path)])["PEOPLE"]
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "boolean", "string"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 2.5, True, "a, b"), (2, None, False, None), (3, 4.0, True, "ok")]
    io.write_table(df, str(tmp_path / "out"))
    assert io.read_tables(spark, [str(tmp_path / "out")])["OUT"].count() == 3


def test_report_columns():
    roles = ColumnRoles(["a", "b", "c"], ["d", "e"])
    assert report_columns(roles) == ColumnRoles(["a", "b", "c"], ["d", "e"])
    assert report_columns(roles, 4) == ColumnRoles(["a", "b", "c"], ["d"]) and report_columns(roles, 2) == ColumnRoles(["a", "b"], [])


def test_end_to_end(spark, tmp_path):
    tables = {t.upper(): spark.read.parquet(f"{SF}/{t}.parquet") for t in ("customer", "orders")}
    tables["ORDERS"] = tables["ORDERS"].withColumn("o_until", F.date_add("o_orderdate", 9).cast("string"))
    config = EvaluationConfig(
        generators=["bootstrap", "no such generator"], attack_trees=5, attack_depth=3, tree_depth=3, report_trees=5, entity_key="o_custkey",
        sdtypes={"CUSTOMER": {"c_custkey": "id", "c_nationkey": "categorical"}, "ORDERS": {"o_orderkey": "id", "o_custkey": "id"}},
        primary_keys={"CUSTOMER": "c_custkey", "ORDERS": "o_orderkey"},
        scd_effective="o_orderdate", scd_end="o_until", pii={"CUSTOMER": {"c_name": "drop"}},
        constraints=[{"table": "ORDERS", "type": "fixed_combinations", "columns": ["o_orderstatus", "o_orderpriority"]}],
    )
    keys = {"CUSTOMER": F.col("c_custkey"), "ORDERS": F.col("o_orderkey")}
    found = evaluate(tables, [Relationship("CUSTOMER", "c_custkey", "ORDERS", "o_custkey")], keys, config)
    assert found.leaderboard.count() == 1 and found.leaderboard.first()["overall"] > 0.5
    assert "c_name" not in found.suite["bootstrap"]["CUSTOMER"].columns
    judged = ["membership_inference", "new_row_synthesis", "categorical_cap"]
    assert {r["status"] for r in found.privacy.where(F.col("metric").isin(judged)).collect()} <= {"PASS", "WARN", "FAIL", "SKIP"}
    assert found.structure.first()["fk_gate"] == "n/a"
    assert [r["generator"] for r in found.failures.collect()] == ["no such generator"]
    assert {"exact_match_rate", "dcr_ratio_median"} <= {r["metric"] for r in found.privacy.collect()}
    frames = found.report
    assert set(frames) == set(FRAMES) - {"correlations"}  # no table has two numbers
    areas = {}
    for r in frames["histograms"].collect():
        areas.setdefault((r["table"], r["source"], r["column"]), []).append(r)
    real = tables["CUSTOMER"].agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    for (table, source, column), rows in areas.items():
        lows = sorted(r["low"] for r in rows)
        assert source in ("real", "bootstrap") and len(rows) > 5
        if column == "c_acctbal":
            assert real[0] - 1 <= lows[0] <= lows[-1] <= real[1]
    shares = {}
    for r in frames["proportions"].collect():
        shares[r["table"], r["source"], r["column"]] = shares.get((r["table"], r["source"], r["column"]), 0) + r["proportion"]
    assert shares and all(v == pytest.approx(1) for (_, _, c), v in shares.items() if c in ("c_mktsegment", "o_orderstatus"))
    close = {(r["table"], r["synth"]): r for r in frames["closeness"].collect()}
    assert set(close) == {("CUSTOMER", "bootstrap"), ("ORDERS", "bootstrap")} and all(r["dcr_real_synth_p05"] <= r["dcr_real_synth_median"] for r in close.values())
    assert {r["train_on"] for r in frames["full_efficacy"].collect()} == {"real", "bootstrap", "gap(real-bootstrap)"}
    found.write(str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report" / "failures"), header=True).count() == 1
    assert spark.read.json(str(tmp_path / "report" / "summary")).count() == 1


def test_copies_are_attacked_side_by_side(spark, monkeypatch):
    """Two copies' attacks wait for each other, so one after the other would never end; rows keep their copy's name."""
    meet = threading.Barrier(2, timeout=60)
    real = spark.range(40).selectExpr("id", "id % 7 AS a", "cast(id % 3 AS string) AS b", "cast(id % 2 AS string) AS c")
    copies = {"x": real.limit(10), "y": real.limit(20)}

    def attack(train, holdout, synth, *args, **kwargs):
        n = synth.count()
        meet.wait()
        return spark.createDataFrame([(n / 100, 0.5, 1, 1, str(n))], privacy.MIA_SCHEMA)

    monkeypatch.setattr(privacy, "membership_inference", attack)
    rows = privacy_report(real, real, copies, ColumnRoles(["a"], ["b", "c"]), F.col("id")).where("metric = 'membership_inference'").collect()
    assert {r["synth"]: (r["value"], r["note"]) for r in rows} == {"x": (0.1, "10"), "y": (0.2, "20")}
    with pytest.raises(ValueError, match="second"):
        side_by_side(spark, [lambda: 1, lambda: int("second"), lambda: 3])


def test_models_of_all_sources_are_fitted_side_by_side(spark, monkeypatch):
    """Four models wait for each other, so one after the other would never end; rows come by model, the real table first."""
    meet = threading.Barrier(4, timeout=60)
    real = spark.range(60).selectExpr("id % 7 AS a", "cast(id % 3 AS string) AS b", "cast(id % 2 AS string) AS c").localCheckpoint()

    def predict(data, model):
        meet.wait()
        return data.test.selectExpr("y AS label", "y AS prediction", "array(1 - y, y) AS scores")

    monkeypatch.setattr(utility, "_predict", predict)
    found = utility.tstr_full(real, real, {"x": real.limit(40)}, ColumnRoles(["a"], ["b", "c"]), "c", "classification", trees=2).collect()
    assert [(r["model"], r["train_on"], r["accuracy"]) for r in found[:4]] == [
        ("RandomForest", "real", 1.0), ("RandomForest", "x", 1.0), ("baseline", "real", 1.0), ("baseline", "x", 1.0),
    ]


def test_tables_are_fitted_side_by_side(spark, monkeypatch):
    """The copulas of two tables wait for each other; every table keeps its own copy."""
    meet, fit = threading.Barrier(2, timeout=60), synth.fit_gaussian_copula
    tables = {t: spark.range(n).selectExpr("id", f"id * {n} AS x", "cast(id % 3 AS string) AS y") for t, n in (("A", 30), ("B", 50))}

    def waiting(*args):
        meet.wait()
        return fit(*args)

    monkeypatch.setattr(synth, "fit_gaussian_copula", waiting)
    job = synth.SuiteInput(tables, {t: ColumnRoles(["x"], ["y"]) for t in tables}, {t: F.col("id") for t in tables}, primary_keys={"A": "id", "B": "id"})
    failures: dict[str, str] = {}
    made = synth.generate_suite(job, ["gaussiancopula"], failures=failures)["gaussiancopula"]
    assert not failures and list(made) == ["A", "B"] and [made[t].count() for t in made] == [30, 50]
    most = [df.agg(F.max("x")).first()[0] for df in made.values()]
    assert most[0] <= 29 * 30 < most[1]
