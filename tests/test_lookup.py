"""Value tables, their lookups, joins with hot keys, and what is built on them."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from twinlens.model import ColumnRoles, Relationship
from twinlens.operators import encode, knn, lookup, refill, scd, skew, split, utility


def texts(spark, n=3000):
    rng = random.Random(4)
    rows = [(i, f"v{rng.randrange(900)}" if rng.random() < 0.6 else rng.choice(["hot", None, "é", "z" * 90]), rng.randrange(40)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, a string, b int")


def plain_steps(values):
    counts = Counter(None if v is None else str(v) for v in values)
    at, out = 0, {}
    for place, v in enumerate(sorted(counts, key=lambda v: (v is None, v or ""))):
        out[v] = (at, counts[v], place)
        at += counts[v]
    return out


def test_value_steps_and_positions(spark, monkeypatch):
    rows, df = texts(spark)
    steps = lookup.value_steps(lookup.value_counts(df, ["a", "b"]))
    found = steps.collect()
    for i, c in ((1, "a"), (2, "b")):
        want = plain_steps([r[i] for r in rows])
        assert {r["value"]: (r["start"], r["n"], r["place"]) for r in found if r["column"] == c} == want
        assert {(r["total"], r["values"]) for r in found if r["column"] == c} == {(3000, len(want))}
    monkeypatch.setattr(lookup, "_BUCKET_CELLS", 70)
    cells = spark.range(3000).select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("column"), F.col("id").alias("at"))
    cells = cells.unionByName(spark.createDataFrame([(-1, "a", 3000), (-2, "none", 1)], "id long, column string, at long"))
    got = {(r["id"], r["column"]): r["value"] for r in lookup.values_at(cells, steps).collect()}
    lines = {c: [v for v, (_, n, _) in plain_steps([r[i] for r in rows]).items() for _ in range(n)] for i, c in ((1, "a"), (2, "b"))}
    assert all(got[i, c] == lines[c][i] for i in range(3000) for c in "ab")
    assert got[-1, "a"] is None and (-2, "none") not in got


@pytest.mark.parametrize("heavy", [4096, 20, 0], ids=["all broadcast", "some exchanged", "all exchanged"])
def test_values_to_answers(spark, monkeypatch, heavy):
    monkeypatch.setattr(lookup, "_HEAVY", heavy)
    rows, df = texts(spark)
    steps = lookup.value_steps(lookup.value_counts(df, ["a", "b"], nulls=False))
    other = df.select("id", F.when(F.col("id") % 7 == 0, "unknown").otherwise(F.col("a")).alias("a"), F.col("b").cast("string").alias("b"))
    got = lookup.values_to(other, steps, {"pa": ("a", F.col("a")), "pb": ("b", F.col("b"))}, F.col("place"))
    assert got.columns == ["id", "a", "b", "pa", "pb"]
    want = [plain_steps([r[i] for r in rows if r[i] is not None]) for i in (1, 2)]
    found = {r["id"]: (r["pa"], r["pb"]) for r in got.collect()}
    for i, a, b in rows:
        known = None if i % 7 == 0 or a is None else want[0][a][2]
        assert found[i] == (known, want[1][str(b)][2])


def test_short_and_long_value_tables_draw_the_same(spark, monkeypatch):
    rows, df = texts(spark)
    typed = df.withColumns({"d": F.date_add(F.lit("2024-01-01").cast("date"), F.col("b")), "x": F.when(F.col("b") > 3, F.col("b") / 7)})
    keys = spark.range(2500).withColumnRenamed("id", "k")
    columns = ["a", "b", "d", "x"]
    short = refill.refill_by_value(keys, typed, columns, F.col("k"), 3)
    assert short.columns == ["k", *columns] and short.schema["d"].dataType == typed.schema["d"].dataType
    monkeypatch.setattr(refill, "short_tables", lambda counts: {})
    long = refill.refill_by_value(keys, typed, columns, F.col("k"), 3)
    assert long.dtypes == short.dtypes and long.exceptAll(short).count() == 0 and long.count() == 2500
    monkeypatch.setattr(refill, "short_tables", lambda counts: {k: v for k, v in lookup.short_tables(counts).items() if k in "bx"})
    assert refill.refill_by_value(keys, typed, columns, F.col("k"), 3).exceptAll(short).count() == 0
    drawn = Counter(r["a"] for r in short.collect())
    assert abs(drawn["hot"] / 2500 - sum(r[1] == "hot" for r in rows) / 3000) < 0.03 and drawn[None]


@pytest.mark.parametrize("n", [1, 2, 3, 63, 64, 65, 128, 129, 200])
def test_count_up_to(spark, n):
    totals = [3 * i + 2 for i in range(n)]
    draws = spark.range(totals[-1]).select(F.col("id"), refill._count_up_to(totals, F.col("id")).alias("at"))
    assert all(r["at"] == sum(t <= r["id"] for t in totals) for r in draws.collect())


def test_refill_is_one_exchange_for_all_columns(spark):
    _, df = texts(spark)
    wide = df.withColumns({f"c{i}": F.col("b") + i for i in range(12)})
    out = refill.refill(df.select("id"), wide, ["a", "b", *[f"c{i}" for i in range(12)]], F.col("id"), F.col("id"))
    few = refill.refill(df.select("id"), wide, ["a"], F.col("id"), F.col("id"))
    exchanges = [x._jdf.queryExecution().executedPlan().toString().count("Exchange hash") for x in (out, few)]
    assert exchanges[0] == exchanges[1]
    assert out.count() == 3000 and out.select("a").exceptAll(few.select("a")).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_deals_out_hot_and_missing_keys(spark, how):
    rows = spark.range(20_000).select(
        "id", F.when(F.col("id") % 10 != 0, None).otherwise(F.when(F.col("id") % 20 == 0, 7).otherwise(F.col("id"))).alias("k")
    )
    table = spark.range(0, 15_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert len(skew.heavy_keys(rows, ["k"])) == 1
    out = skew.spread_join(rows, table, ["k"], how)
    plain = rows.join(table, "k", how)
    assert out.exceptAll(plain).count() == 0 and out.count() == plain.count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["n"] for r in skew.spread_join(rows, table, ["k"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        worst = [r["n"] for r in rows.join(table, "k", "left").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) < 0.35 * 20_000 < 0.9 * 20_000 <= max(worst)


def test_split_and_timeline_with_hot_and_missing_keys(spark):
    parents = spark.range(50).select(F.col("id").alias("p"))
    child = spark.range(2000).select(F.col("id").alias("c"), F.when(F.col("id") % 10 < 4, None).when(F.col("id") % 10 < 9, 3).otherwise(F.col("id") % 70).alias("fk"))
    keys = {"P": F.col("p"), "C": F.col("c")}
    train, hold = split.split_relational({"P": parents, "C": child}, [Relationship("P", "p", "C", "fk")], keys)
    assert train["C"].count() + hold["C"].count() == 2000 and train["C"].columns == ["c", "fk"]
    held = {r["p"] for r in hold["P"].collect()}
    for r in hold["C"].where("fk is not null and fk < 50").collect():
        assert r["fk"] in held
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 10 < 3, None).when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 40).alias("k"),
        F.when(F.col("id") % 13 != 0, F.timestamp_seconds((F.col("id") * 37) % 9000)).alias("e"),
    )
    got = {r["id"]: r["__next"] for r in scd.with_next_version(rows, "k", "e", "id").collect()}
    assert len(got) == 3000
    order = {}
    for r in sorted(rows.collect(), key=lambda r: (r["e"] is None, r["e"] or 0, r["id"])):
        order.setdefault(r["k"], []).append(r)
    for group in order.values():
        for a, b in zip(group, group[1:], strict=False):
            assert got[a["id"]] == b["e"]


def wide_frame(spark, n=4000):
    return spark.range(n).select(
        "id", (F.col("id") % 11).cast("double").alias("x"), F.concat(F.lit("cat"), F.pmod(F.xxhash64("id"), F.lit(1500))).alias("c"),
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("d"),
    )


def test_wide_categories_encode_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lookup, "_HEAVY", 300)
    df = wide_frame(spark)
    enc = encode.fit_encoder(df, ColumnRoles(["x"], ["c", "d"]))
    rows = df.collect()
    names = {c: sorted({r[c] for r in rows if r[c] is not None}) for c in "cd"}
    mode = {c: min(names[c], key=lambda v: (-sum(r[c] == v for r in rows), v)) for c in "cd"}
    assert enc.width == 1 + len(names["c"]) + len(names["d"]) and enc.modes == mode
    mean, sd = np.mean([r["x"] for r in rows]), np.std([r["x"] for r in rows])
    asked = df.where("id < 300").withColumn("c", F.when(F.col("id") == 5, "unknown").otherwise(F.col("c")))
    compact = {r["id"]: r["features"] for r in enc.compact(asked, "id").collect()}
    for r in enc.vectors(asked, "id").collect():
        source = rows[r["id"]]
        assert source["id"] == r["id"]
        c, d = "unknown" if r["id"] == 5 else source["c"], source["d"] or mode["d"]
        slots = {0: (source["x"] - mean) / sd}
        places = [names["c"].index(c) if c in names["c"] else -1, names["d"].index(d)]
        if places[0] >= 0:
            slots[1 + places[0]] = 1.0
        slots[1 + len(names["c"]) + places[1]] = 1.0
        got = dict(zip(r["features"].indices.tolist(), r["features"].values.tolist(), strict=True))
        assert got == pytest.approx(slots) and compact[r["id"]] == pytest.approx([slots[0], *places])


def test_a_hundred_thousand_categories(spark):
    df = spark.range(200_000).select((F.col("id") % 100_000).cast("string").alias("c"), F.col("id").cast("double").alias("x"))
    enc = encode.fit_encoder(df, ColumnRoles(["x"], ["c"]))
    assert enc.width == 100_001
    out = enc.vectors(df)
    assert out.count() == 200_000 and {len(r["features"].indices) for r in out.limit(500).collect()} == {2}


@pytest.mark.parametrize("skip_self", [False, True])
def test_neighbours_of_places_equal_neighbours_of_one_hot_vectors(spark, monkeypatch, skip_self):
    monkeypatch.setattr(knn, "BLOCK", 60)
    df = wide_frame(spark, 500).withColumn("c", F.concat(F.lit("c"), F.col("id") % 5))
    enc = encode.fit_encoder(df.where("id % 2 = 0"), ColumnRoles(["x"], ["c", "d"]))
    ask = df if skip_self else df.where("id % 2 = 1").withColumn("c", F.when(F.col("id") % 9 != 0, F.col("c")).otherwise("new"))
    got = knn.knn_distances(enc.compact(ask, "id"), enc.compact(df), 3, skip_self, codes=2)
    dense = [x.select("id", vector_to_array("features").alias("features")) for x in (enc.vectors(ask, "id"), enc.vectors(df, "id"))]
    want = knn.knn_distances(dense[0], dense[1], 3, skip_self)
    a, b = ({r["id"]: r["distances"] for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_many_classes_need_no_plan_literals(spark):
    df = spark.range(30_000).select((F.col("id") % 10_000).cast("string").alias("t"), (F.col("id") % 10_000).cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("c"))
    roles = ColumnRoles(["x"], ["c", "t"])
    data = utility._prepare(df, df, roles, "t", "classification")
    assert data.n_classes == 10_000 and data.train.select("y").distinct().count() == 10_000
    names = sorted({str(i) for i in range(10_000)})
    first = data.train.where("y = 1234").first()
    assert int(names[1234]) % 2 == int(first["features"].toArray()[2])


def test_single_column_draws_without_a_written_step(spark):
    from twinlens import session

    df = spark.range(500).select("id", (F.col("id") * 3).alias("a"), F.lit("x").alias("kept"))
    app = spark.sparkContext.applicationId
    before = len(session._STEPS.get(app, []))
    one = refill.refill(df.select("id", "kept"), df, ["a"], F.col("id"), F.col("id"), ["a", "id"], seed=3)
    assert len(session._STEPS.get(app, [])) == before
    two = refill.refill(df.select("id"), df.withColumn("b", F.col("a")), ["a", "b"], F.col("id"), F.col("id"), seed=3)
    assert one.columns == ["a", "id"] and one.count() == 500
    assert sorted(map(tuple, one.select("id", "a").collect())) == sorted(map(tuple, two.select("id", "a").collect()))


def test_both_parts_are_written_by_one_pass(spark):
    from twinlens import session

    df = spark.range(100).withColumn("v", F.when(F.col("id") != 7, F.col("id")))
    before = len(session._STEPS.get(spark.sparkContext.applicationId, []))
    rest, part = session.durable_parts(df, F.pmod("v", F.lit(4)) == 0)
    assert len(session._STEPS[spark.sparkContext.applicationId]) == before + 1
    assert rest.columns == part.columns == ["id", "v"] and (rest.count(), part.count()) == (74, 25)  # NULL is in neither
    assert session.durable_parts(df.where("v < 0"), F.lit(True))[0].count() == 0


def test_models_train_on_all_cores(spark):
    df = spark.range(200).select("id", F.col("id").cast("double").alias("x"), F.pmod("id", F.lit(2)).cast("string").alias("y")).coalesce(1)
    for target, task in (("y", "classification"), ("x", "regression")):
        roles = ColumnRoles(["x"], ["y"])
        data = utility._prepare(df, df, roles, target, task)
        assert data.train.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert data.train.count() == 200


def test_distances_to_pivots_are_taken_in_bounded_pieces(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(knn, "_MATRIX_CELLS", 100)
    cells = knn._Cells(np.arange(10.0)[:, None])
    batches = [pd.DataFrame({"v": [[float(i)] for i in range(n)]}) for n in (35, 0, 4)]
    pieces = list(knn._pieces(iter(batches), cells))
    assert [len(p) for p in pieces] == [10, 10, 10, 5, 4]


def test_closeness_searches_real_rows_once_for_all_copies(spark, monkeypatch):
    from twinlens.operators import privacy
    from twinlens.plans import report

    searches = []
    monkeypatch.setattr(privacy, "knn_distances", lambda q, b, *a, **k: searches.append(1) or knn.knn_distances(q, b, *a, **k))
    real = spark.range(40).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    copies = {"a": real.select((F.col("x") + 1).alias("x")), "b": real.where("x > 9")}
    series = report.closeness_series(real, copies, ColumnRoles(["x"], []))
    assert len(searches) == 3 and series.groupBy("series").count().count() == 3
    assert {r["count"] for r in series.groupBy("series").count().collect()} == {40}
