"""Properties and brute-force checks of fidelity, privacy, utility and structure."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.functions.values import nearest, printed
from twinlens.model import ColumnRoles, Relationship
from twinlens.operators import counting, encode, fidelity, knn, privacy, score, structure, utility
from twinlens.session import durable


def numbers(spark, n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = [(float(a), float(b), str(c), int(d)) for a, b, c, d in zip(
        rng.normal(shift, 2, n), rng.exponential(3, n), rng.choice(list("abc"), n, p=[0.7, 0.2, 0.1]), rng.integers(0, 4, n))]
    return spark.createDataFrame(rows, "x double, y double, c string, d int")


def scores(df, *keys):
    return {tuple(r[k] for k in keys): r["score"] for r in df.collect()}


def test_identical_tables_score_one(spark):
    df = numbers(spark, 400, 1)
    shapes = scores(fidelity.column_shapes(df, {"s": df}, ["x", "y"], ["c", "d"]), "column")
    trends = scores(fidelity.column_pair_trends(df, {"s": df}, ["x", "y"], ["c", "d"]), "column_1", "column_2")
    assert len(shapes) == 4 and len(trends) == 6
    assert all(abs(v - 1) < 1e-12 for v in [*shapes.values(), *trends.values()])


def test_ks_against_numpy_for_any_partitioning(spark):
    a, b = numbers(spark, 700, 1), numbers(spark, 300, 2, 0.8)
    x, y = (np.sort([r["x"] for r in d.collect()]) for d in (a, b))
    grid = np.concatenate([x, y])
    want = 1 - np.abs(np.searchsorted(x, grid, "right") / len(x) - np.searchsorted(y, grid, "right") / len(y)).max()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "32"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = scores(fidelity.ks_complement(a, {"s": b}, ["x"]), "column")[("x",)]
            assert abs(got - want) < 1e-12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rough = scores(fidelity.ks_complement(a, {"s": b}, ["x"], grid=50), "column")[("x",)]
    assert abs(rough - want) < 0.05


def test_tv_is_symmetric_and_bounds_contingency(spark):
    a, b = numbers(spark, 500, 1), numbers(spark, 400, 3)
    ab, ba = (scores(fidelity.tv_complement(p, {"s": q}, ["c", "d"]), "column") for p, q in ((a, b), (b, a)))
    assert ab == pytest.approx(ba)
    pair = scores(fidelity.contingency_similarity(a, {"s": b}, [("c", "d")], []), "column_1")[("c",)]
    assert pair <= min(ab.values()) + 1e-12


def test_constant_and_empty_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None)], "k double, v double, e double")
    found = fidelity.correlation_similarity(df, {"s": df}, ["k", "v", "e"]).collect()
    assert len(found) == 3 and all(r["score"] is None for r in found)
    quality = fidelity.quality_report(
        fidelity.column_shapes(df, {"s": df}, ["k", "v"], []), fidelity.column_pair_trends(df, {"s": df}, ["k", "v"], [])
    ).first()
    assert quality["overall"] == 1.0 and quality["column_pair_trends"] is None


def test_exact_percentiles(spark):
    values = [float(v) for v in np.random.default_rng(5).integers(0, 40, 501)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)] * 300 + [("b", None)], "g string, value double")
    rows = {r["g"]: r for r in counting.exact_percentiles(df, ["g"], [0.5, 0.05, 0.99]).collect()}
    assert [rows["a"][f"p{i}"] for i in range(3)] == pytest.approx(list(np.percentile(values, [50, 5, 99])))
    assert rows["b"]["p0"] == 7.0


def test_encoder(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "a"), (8.0, None)], "n double, c string").withColumn("e", F.lit(None).cast("double"))
    enc = encode.fit_encoder(df, ColumnRoles(["n", "e"], ["c"]))
    filled = np.array([1.0, 3.0, 3.0, 8.0])
    other = spark.createDataFrame([(5.0, "zzz"), (None, None)], "n double, c string")
    got = [r["features"].toArray().tolist() for r in enc.vectors(other, "n").collect()]
    scale = lambda v: (v - filled.mean()) / filled.std()
    assert got[0] == pytest.approx([scale(5.0), 0.0, 0.0]) and got[1] == pytest.approx([scale(3.0), 1.0, 0.0])
    with pytest.raises(ValueError):
        encode.fit_encoder(df, ColumnRoles(["e"], []))


@pytest.mark.parametrize("skip_self", [False, True])
def test_knn_against_brute_force_with_hot_duplicates(spark, monkeypatch, skip_self):
    monkeypatch.setattr(knn, "BLOCK", 20)
    monkeypatch.setattr(knn, "QUERY_CHUNK", 15)
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 1, (150, 4)), rng.normal(6, 0.1, (80, 4)), np.tile(rng.normal(0, 1, 4), (110, 1))])
    base = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, features array<double>")
    ask = points if skip_self else rng.normal(2, 3, (60, 4))
    query = base if skip_self else spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(ask)], "id long, features array<double>")
    got = {r["id"]: r["distances"] for r in knn.knn_distances(query, base, 3, skip_self).collect()}
    full = np.sqrt(((ask[:, None, :] - points[None]) ** 2).sum(2))
    if skip_self:
        np.fill_diagonal(full, np.inf)
    want = np.sort(full, axis=1)[:, :3]
    assert len(got) == len(ask)
    for i, row in enumerate(want):
        assert got[i] == pytest.approx(row, abs=1e-9)


def test_knn_far_from_the_origin(spark):
    """Spread of 1e-2 around 1e6, and one-hot vectors of 50 dimensions."""
    rng = np.random.default_rng(8)
    far = 1e6 + rng.normal(0, 1e-2, (120, 3))
    hot = np.eye(50)[rng.integers(0, 50, 200)]
    for points in (far, hot):
        base = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, features array<double>")
        got = {r["id"]: r["distances"] for r in knn.knn_distances(base, base, 4, True).collect()}
        full = np.sqrt(((points[:, None, :] - points[None]) ** 2).sum(2))
        np.fill_diagonal(full, np.inf)
        for i, row in enumerate(np.sort(full, axis=1)[:, :4]):
            assert got[i] == pytest.approx(row, abs=1e-8)


def test_knn_packs_hold_neighbouring_cells():
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 900, 200)
    sizes[7] = 9_500
    pivots = rng.normal(size=(200, 3))
    packs = knn._packed(sizes, knn._distances(pivots, pivots))
    held = np.bincount(packs, weights=sizes)
    assert packs.min() == 0 and len(np.unique(packs)) == len(held)
    assert (packs == packs[7]).sum() == 1 and np.delete(held, packs[7]).max() <= knn.PACK
    # a query meets few packs, however many pivots there are
    assert len(held) <= 2 * sizes.sum() / knn.PACK + 3


def test_knn_caps_k_at_the_base(spark):
    base = spark.createDataFrame([([0.0],), ([2.0],)], "features array<double>")
    assert knn.knn_distances(base, base, 5).first()["distances"] in ([0.0, 2.0], [2.0, 0.0])


def brute_new_rows(real, synth, numeric, categorical, tol=0.01):
    def match(r, s):
        for c in categorical:
            if r[c] != s[c]:
                return False
        for c in numeric:
            if (r[c] is None) != (s[c] is None):
                return False
            if s[c] is not None and abs(r[c] - s[c]) > tol * abs(s[c]):
                return False
        return True
    return sum(any(match(r, s) for r in real) for s in synth)


def test_new_row_synthesis_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(privacy, "_HOT_CELL", 3)
    rng = np.random.default_rng(11)

    def table(n):
        return [
            (
                str(rng.choice(["a", "b", None])) if rng.random() > 0.1 else None,
                float(rng.choice([0.0, -5.0, 100.0])) * float(1 + rng.normal(0, 0.01)) if rng.random() > 0.1 else None,
                float(50 + rng.normal(0, 0.6)),
            )
            for _ in range(n)
        ]

    real, synth = (spark.createDataFrame(table(250), "a string, x double, y double") for _ in range(2))
    roles = ColumnRoles(["x", "y"], ["a"])
    got = privacy.new_row_synthesis(real, synth, roles).first()
    want = brute_new_rows(real.collect(), synth.collect(), ["x", "y"], ["a"])
    assert 0 < want < 250
    assert (got["n_rows"], got["n_matched"]) == (250, want)
    assert privacy.new_row_synthesis(real, real, roles).first()["new_row_synthesis"] == 0.0
    assert privacy.new_row_synthesis(real, synth, ColumnRoles([], ["a"])).first()["n_matched"] == 250


def test_new_row_synthesis_exchanges_rows_once(spark):
    seen = durable(spark.range(300).select((F.col("id") * 1.5 + 1).alias("x"), F.lit("a").alias("c")))
    asked = spark.range(40).select(F.col("id").alias("row"), (F.col("id") * 2.5 + 1).alias("x"), F.lit("a").alias("c"))
    matched = privacy._matched_in_cells(asked, seen, ["x"], [F.col("c")], 0.01)
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 3  # the crowded cells, asked by both sides, and the rows found
    want = {i for i in range(40) if any(abs(j * 1.5 + 1 - (i * 2.5 + 1)) <= 0.01 * (i * 2.5 + 1) for j in range(300))}
    assert {r["row"] for r in matched.collect()} == want


def test_near_copies(spark):
    real = spark.createDataFrame([("a", 100.0), ("a", 0.0), ("a", -40.0), ("b", None)], "a string, x double")
    synth = spark.createDataFrame(
        [("a", 100.9), ("a", 102.0), ("a", 0.0), ("a", 1e-9), ("a", -40.3), ("a", 40.0), ("b", None), ("b", 1.0), (None, 100.0)], "a string, x double"
    )
    row = privacy.new_row_synthesis(real, synth, ColumnRoles(["x"], ["a"])).first()
    assert row["n_matched"] == 4


def test_exact_match_compares_text(spark):
    real = spark.createDataFrame([(1, None), (2, "b")], "n long, s string")
    synth = spark.createDataFrame([(1.0, None), (2.0, "b")], "n double, s string")
    assert privacy.exact_match_rate(real, synth, ColumnRoles(["n"], ["s"])).first()["n_exact_matches"] == 0
    assert privacy.exact_match_rate(real, real, ColumnRoles(["n"], ["s"])).first()["exact_match_rate"] == 1.0


def brute_cap(real, known, keys, secret, nearest):
    chances = []
    for r in real:
        distance = [sum(r[k] != a[k] for k in keys) for a in known]
        pool = [a for a, d in zip(known, distance) if d == (min(distance) if nearest else 0)]
        if pool:
            chances.append(sum(a[secret] == r[secret] for a in pool) / len(pool))
    return 1 - float(np.mean(chances)) if chances else None


def test_cap_against_brute_force(spark):
    rng = np.random.default_rng(4)

    def table(n, low):
        return spark.createDataFrame(
            [tuple([*(str(v) for v in rng.integers(low, 6, 3)), str(rng.choice(["u", "v"], p=[0.8, 0.2]))]) for _ in range(n)],
            "p string, q string, r string, s string",
        )

    real, known = table(80, 0), table(15, 3)
    keys = ["p", "q", "r"]
    for attack, nearest in ((privacy.categorical_cap, False), (privacy.generalized_cap, True)):
        want = brute_cap(real.collect(), known.collect(), keys, "s", nearest)
        assert attack(real, known, keys, "s").first()["score"] == pytest.approx(want)
    far = known.withColumns({k: F.lit("x") for k in keys})
    assert privacy.cap_attack(real, far, keys, "s").first()["variant"] == "generalized"
    assert privacy.pick_sensitive(real, ["p", "s"], "s")[::2] == ("s", "user")
    assert privacy.pick_sensitive(real, ["s", "p"])[0] == "p"


def test_membership_attack_sees_a_copy(spark):
    rows = numbers(spark, 1200, 8).withColumn("id", F.monotonically_increasing_id())
    train, hold = rows.where("pmod(xxhash64(id), 3) > 0"), rows.where("pmod(xxhash64(id), 3) = 0")
    roles = ColumnRoles(["x", "y"], ["c"])
    leak = privacy.membership_inference(train, hold, train, roles, F.col("id"), trees=15, depth=5).first()
    fresh = privacy.membership_inference(train, hold, numbers(spark, 800, 99), roles, F.col("id"), trees=15, depth=5).first()
    assert leak["auc"] > 0.95 and abs(fresh["auc"] - 0.5) < 0.15
    tiny = privacy.membership_inference(train, hold.limit(3), train, roles, F.col("id")).first()
    assert tiny["auc"] is None and "insufficient" in tiny["note"]


def test_verdict_thresholds(spark):
    rows = [
        ("s", "t", "membership_inference", 0.61, None, ""), ("s", "t", "membership_inference", None, None, "too small"),
        ("s", "t", "new_row_synthesis", 0.5, 0.52, ""), ("s", "t", "new_row_synthesis", 0.75, None, ""),
        ("s", "t", "categorical_cap", 0.1, 0.5, ""), ("s", "t", "categorical_cap", 0.35, None, ""),
    ]
    found = privacy.privacy_verdicts(spark.createDataFrame(rows, privacy.METRIC_SCHEMA)).collect()
    assert [r["status"] for r in found] == ["WARN", "SKIP", "PASS", "WARN", "FAIL", "WARN"]


# ---- structure -------------------------------------------------------------

REL = Relationship("P", "pk", "C", "fk")


def database(spark):
    parent = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "pk string, x double")
    child = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("zz", "4"), (None, "5")], "fk string, y string")
    return {"P": parent, "C": child}


def test_integrity_and_cardinality(spark):
    tables = database(spark)
    row = structure.referential_integrity([REL], tables, {}).first()
    assert row["fk_coverage"] == 0.75 and row["parent_coverage"] == pytest.approx(2 / 3) and row["status"] == "FAIL"
    counts = dict(map(tuple, structure.children_per_parent(tables["P"], tables["C"], "pk", "fk").collect()))
    assert counts == {"a": 2, "b": 1, "c": 0}
    twice = {**tables, "P": tables["P"].union(tables["P"])}
    held = {r["relationship"]: r["holds"] for r in structure.relationships_hold([REL], twice).collect()}
    assert held == {REL.label: False}
    checks = structure.validate_model([REL], twice, "nokey").collect()
    assert [c["status"] for c in checks] == ["FAIL", "FAIL"]
    orphanless = {**tables, "C": tables["C"].where("fk in ('a', 'b')")}
    assert structure.relationships_hold([REL], orphanless).first()["holds"]
    allnull = {**tables, "C": tables["C"].withColumn("fk", F.lit(None).cast("string"))}
    assert structure.validate_model([REL], allnull).first()["status"] == "WARN"


def test_hub_lifts_invariants(spark):
    a = spark.createDataFrame([(1, "x", 5), (1, "x", 6), (2, None, 7), (None, "q", 8)], "k int, b string, n int")
    c = spark.createDataFrame([(2, 9), (3, 9)], "k int, m int")
    tables, links, _, info = structure.build_entity_hub({"A": a, "C": c, "k_HUB": c.drop("k")}, "k")
    assert info.parent == "k_HUB_" and info.lifted == {"b": "A", "m": "C"} and len(links) == 2
    assert sorted(map(tuple, tables["k_HUB_"].collect()), key=str) == sorted([(1, "x", None), (2, None, 9), (3, None, 9)], key=str)
    assert tables["A"].columns == ["k", "n"]
    with pytest.raises(ValueError):
        structure.build_entity_hub({"A": a}, "zzz")


def test_hub_lifts_any_number_of_columns(spark):
    wide = spark.range(30).select((F.col("id") % 3).alias("k"), *[(F.col("id") % 3 + i).alias(f"c{i}") for i in range(12)])
    assert len(structure.build_entity_hub({"A": wide}, "k")[3].lifted) == 12
    assert list(structure.build_entity_hub({"A": wide}, "k", lift_limit=2)[3].lifted) == ["c0", "c1"]


def test_relationship_rules():
    assert structure.check_relationships([REL, REL]) == [REL]
    with pytest.raises(ValueError):
        structure.check_relationships([Relationship("P", "a", "P", "b")])
    assert structure.orient(("C", "fk"), ("P", "pk"), "many-to-one") == (REL, "1-*")


# ---- utility ---------------------------------------------------------------


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(l), float(s)) for l, s in zip(rng.integers(0, 2, 200), rng.integers(0, 15, 200))]
    pos, neg = [s for l, s in rows if l], [s for l, s in rows if not l]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    got = utility.binary_auc(spark.createDataFrame(rows, "label int, score double")).first()["auc"]
    assert got == pytest.approx(want)


def test_alignment_and_unseen_classes(spark):
    train = spark.createDataFrame([("a", "y"), ("a", "n"), ("b", "y"), (None, "n")], "f string, t string")
    test = spark.createDataFrame([("a", "y"), ("c", "n"), (None, "y"), ("b", "maybe")], "f string, t string")
    _, aligned, changed = utility.align_categories(train, test, ["f"])
    assert changed == 1 and sorted(r["f"] for r in aligned.collect()) == ["__nan__", "a", "a", "b"]
    assert utility.drop_unseen_targets(train, test, "t").count() == 3


def test_tstr_prefers_signal(spark):
    good = numbers(spark, 900, 1).withColumn("t", F.when(F.col("x") > 0, "hi").otherwise("lo"))
    noise = good.withColumn("t", F.when(F.rand(1) > 0.5, "hi").otherwise("lo"))
    test = numbers(spark, 300, 2).withColumn("t", F.when(F.col("x") > 0, "hi").otherwise("lo"))
    roles = ColumnRoles(["x", "y"], ["c", "t"])
    frame = utility.tstr(good, test, {"good": good, "noise": noise}, roles, "t", "classification", "T", 4)
    rows = {(r["metric"], r["train_on"]): r["score"] for r in frame.collect()}
    assert rows[(utility.BINARY_F1, "real")] > 0.95 > rows[(utility.BINARY_F1, "noise")]
    assert rows[(utility.BINARY_F1, "gap(real-good)")] == pytest.approx(0.0)
    line = utility.tstr(good.withColumn("z", F.col("x") * 2 + 1), test.withColumn("z", F.col("x") * 2 + 1), {}, ColumnRoles(["x", "z"], []), "z", "regression")
    assert line.first()["score"] > 0.999
    assert utility.auto_select_target(good, roles) == ("c", "classification")
    assert utility.auto_select_target(good, ColumnRoles(["x", "y"], []))[1] == "regression"


# ---- scores ----------------------------------------------------------------


def test_summary_arithmetic(spark):
    quality = spark.createDataFrame([("a", "t", 0.8, 0.9, 0.7), ("a", "u", 0.6, 0.6, 0.6), ("b", "t", float("nan"), 0.5, 0.5)],
                                    "synth string, table string, overall double, column_shapes double, column_pair_trends double")
    metrics = spark.createDataFrame(
        [("a", "t", "membership_inference", 0.6, None, ""), ("a", "t", "new_row_synthesis", 1.2, None, ""), ("a", "t", "categorical_cap", None, None, "")],
        privacy.METRIC_SCHEMA)
    efficacy = spark.createDataFrame(
        [("t", "y", "c", m, s, v, "") for m, s, v in (
            ("f1", "real", 0.5), ("f1", "a", 0.25), ("acc", "real", 0.4), ("acc", "a", 0.8), ("r2", "real", -1.0), ("r2", "a", 0.3), ("q", "real", 0.5), ("q", "a", math.nan))],
        utility.EFFICACY_SCHEMA)
    shape = spark.createDataFrame([("a", 0.4)], "synth string, structure double")
    rows = {r["synth"]: r for r in score.compute_summary(quality, metrics, efficacy, shape).collect()}
    a = rows["a"]
    assert a["columns"] == pytest.approx(0.7) and a["fidelity"] == pytest.approx(0.6)
    assert a["privacy"] == pytest.approx((0.8 + 1.0) / 2)
    assert a["utility"] == pytest.approx(0.75) and (a["n_panels"], a["n_capped"]) == (2, 1)
    assert a["overall"] == pytest.approx((0.6 + 0.9 + 0.75) / 3)
    assert rows["b"]["overall"] is None
    board = score.leaderboard(score.compute_summary(quality, metrics, efficacy, shape)).collect()
    assert [r["synthesizer"] for r in board] == ["a", "b"]


def test_long_categories_stay_whole(spark):
    long = "x" * 100
    df = spark.range(60).select("id", F.when(F.col("id") % 2 == 0, long).otherwise("y").alias("c"), (F.col("id") % 2).cast("double").alias("n"))
    found = encode.fit_encoder(df, ColumnRoles([], ["c"]))
    assert [r["value"] for r in found.steps.orderBy("place").collect()] == [long, "y"] and found.widths == {"c": 2}
    from twinlens.operators.refill import bootstrap_table

    copy = bootstrap_table(df, F.col("id"), ["c"], small=["c"])
    assert {r["c"] for r in copy.collect()} == {long, "y"}
    frame = utility.tstr(df, df, {}, ColumnRoles(["n"], ["c"]), "c", "classification", max_depth=2)
    assert {r["score"] for r in frame.collect()} == {1.0}


def test_printed_rounds_as_c_does(spark):
    values = [0.6625, 0.0625, 2.25, 2.35, 1282.05, 0.125, 0.375, 7.0, 0.0, 1e17 / 3, -0.0625, -0.001]
    values += [n / d for n in (51282, 90000) for d in range(1, 400)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3):
        got = [r[0] for r in rows.select(printed(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_shares_round_as_the_sql_does(spark):
    import duckdb

    pairs = [(k, n) for n in (51282, 100000, 90000, 600000, 20000, 150000) for k in range(1, 200)]
    rows = spark.createDataFrame(pairs, "k long, n long").select("k", "n", nearest(F.try_divide("k", "n"), 4).alias("s"))
    got = {(r["k"], r["n"]): r["s"] for r in rows.collect()}
    con = duckdb.connect()
    assert all(s == con.execute(f"SELECT round({k} / {n}, 4)").fetchone()[0] for (k, n), s in got.items())


def test_profile_rounds_uniqueness_as_the_sql_does(spark):
    from twinlens.operators.profile import profile_columns

    df = spark.range(100000).select(F.pmod("id", F.lit(15)).alias("g"))
    assert profile_columns(df).first()["uniqueness"] == 0.0001  # 0.00015, in binary a little less
