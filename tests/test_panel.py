import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions import codes
from panelweave.operators import classify, did, impute, panel, quality


def rows(df, *names):
    return sorted(map(tuple, (df.select(*names) if names else df).collect()), key=repr)


SERIES = {1: [0, 1, 1, 0, 1, 0], 2: [0, 0], 3: [1, 1, 1], 4: [1, 0, 0, 1], 5: [0, 1]}


def series(spark):
    return spark.createDataFrame([(k, 2005 + i, x) for k, v in SERIES.items() for i, x in enumerate(v)], "school int, year int, x int")


def test_histories(spark):
    found = panel.histories(series(spark), ["school"], "year", "x")
    want = [(1, 6, 1, 2006, 2, 2), (2, 2, 0, None, 0, None), (3, 3, 1, 2005, 0, 3), (4, 4, 1, 2005, 1, 1), (5, 2, 1, 2006, 0, 1)]
    assert rows(found, "school", "periods", "ever", "first_on", "stops", "first_spell") == sorted(want, key=repr)
    assert rows(panel.never_stops(series(spark), ["school"], "year", "x")) == [(1, False), (2, False), (3, True), (4, False), (5, True)]
    groups = found.select("school", panel.spell_group(F.col("first_spell")).alias("g"))
    assert rows(groups) == [(1, "2"), (2, None), (3, "3+"), (4, "1"), (5, "1")]
    assert rows(panel.cohort_shares(found)) == [(2005, 2, 0.5, 0.0, 0.5), (2006, 2, 0.5, 0.5, 0.0)]
    assert rows(panel.stop_shares(found)) == [(4, 0.5, 0.25, 0.0)]
    assert rows(panel.first_period(series(spark), ["school"], "year", "x")) == sorted([(1, 2006), (2, None), (3, 2005), (4, 2005), (5, 2006)], key=repr)
    assert rows(panel.ordered_series(series(spark), ["school"], "year", "x")) == sorted([(k, v) for k, v in SERIES.items()], key=repr)
    lengths = [r["length"] for r in panel.runs(series(spark), ["school"], "year", "x").where("school = 1").orderBy("run").collect()]
    assert lengths == [1, 2, 1, 1, 1]


def test_missing_years_are_no_gap_and_two_rows_are_two_places(spark):
    df = spark.createDataFrame([(1, 2005, 1), (1, 2009, 1), (1, 2010, 0), (2, 2005, 1), (2, 2005, 1), (2, 2006, 0)], "school int, year int, x int")
    assert rows(panel.histories(df, ["school"], "year", "x"), "school", "first_spell") == [(1, 2), (2, 2)]


def test_participation_of_missing_numbers(spark):
    df = spark.createDataFrame([(3,), (0,), (None,)], "registered int")
    assert [r["took_part"] for r in panel.participation(df, "registered").collect()] == [1, 0, 0]


def test_full_outer_panel_matches_null_keys(spark):
    left = spark.createDataFrame([(1, 2005, "a"), (2, 2005, "b"), (None, 2005, "c")], "school int, year int, name string")
    right = spark.createDataFrame([(1, 2005, "A"), (3, 2006, "C"), (None, 2005, "N"), (2, 2006, "B")], "school int, year int, name string")
    found = panel.participation_panel(left, right, "school", "year")
    want = [(1, 2005, "a", "A", 1, 0, 1), (2, 2005, "b", None, 1, 1, 1), (None, 2005, "c", "N", 1, 0, 1), (3, 2006, None, "C", 0, 0, 0), (2, 2006, None, "B", 0, 0, 1)]
    assert rows(found, "school", "year", "name", "name_census", "participant", "missing_census", "any_participation") == sorted(want, key=repr)
    assert rows(panel.coverage_by_period(found, "school", "year", F.col("participant") == 1)) == [(2005, 3)]
    final = panel.finish_panel(found.withColumn("enrolled", F.when(F.col("year") == 2006, 5)), "enrolled", "participant", spark.createDataFrame([(1,)], "school int"))
    assert rows(final, "school", "year", "part_first_edition") == sorted([(1, 2005, 1), (2, 2005, 0), (None, 2005, 0), (3, 2006, 0), (2, 2006, 0)], key=repr)


def test_levels_without_persons_make_the_rest_null(spark):
    df = spark.createDataFrame([("s", 1, 8), ("s", 1, 8), ("s", 2, 10), ("s", 3, 30), ("t", 4, 9), ("t", 5, 25), ("u", 6, 99)], "school string, person int, stage int")
    args = (df, ["school"], "person", "stage", {"level_I": codes.LEVEL_I_STAGES, "level_II": codes.LEVEL_II_STAGES}, codes.TOTAL_STAGES)
    assert rows(panel.level_counts(*args)) == sorted([("s", 1, 1, 3, 1), ("t", 1, None, 2, None), ("u", None, None, None, None)], key=repr)
    assert rows(panel.level_counts(*args, fill=True)) == sorted([("s", 1, 1, 3, 1), ("t", 1, 0, 2, 1), ("u", 0, 0, 0, 0)], key=repr)


def test_outcomes_fan_out_and_levels_count_units(spark):
    enrolled = spark.createDataFrame([(1, 2010, 5), (2, 2010, 5), (3, 2010, 6)], "p int, y int, stage int")
    outcome = spark.createDataFrame([(1, 2010, 70, 1), (1, 2010, 71, 2), (2, 2010, 99, 1)], "p int, y int, end_school int, situation int")
    schools = spark.createDataFrame([(70, "N"), (70, "S"), (71, "N")], "end_school int, region string")
    found = panel.outcome_panel(enrolled, outcome, schools, ["p", "y"], "end_school")
    assert rows(found, "p", "end_school", "region") == sorted([(1, 70, "N"), (1, 70, "S"), (1, 71, "N"), (2, 99, None), (3, None, None)], key=repr)
    counts = spark.createDataFrame([("s", 2005, 3, None), ("t", 2005, 0, 2), ("u", 2005, 1, 1)], "school string, year int, I int, II int")
    assert rows(panel.units_by_level(counts, ["year"], ["I", "II"])) == [(2005, "I", 2), (2005, "II", 2)]


def test_short_keys(spark):
    a = spark.createDataFrame([(1234567, 2005), (7654321, 2005)], "city int, year int")
    b = spark.createDataFrame([("123456", 2005, 9.5), ("123456", 2006, 1.0)], "city6 string, year int, gdp double")
    assert rows(panel.join_by_short_key(a, b, "city", "city6", ["year"]), "city", "gdp") == [(1234567, 9.5)]


def test_modal_previous(spark):
    now = spark.createDataFrame([(i, 11, 1) for i in range(6)] + [(0, 11, 1), (6, 30, 1), (7, 41, None), (8, 41, 2)], "student int, stage int, school int")
    before = spark.createDataFrame([(0, 10, 50), (1, 10, 51), (2, 10, 51), (3, 10, 50), (4, 11, 99), (5, 10, None), (6, 10, 60), (8, 11, 70)], "student int, stage int, school int")
    found = impute.modal_previous(now, before, "student", "school", "stage", codes.GUESS_STAGES["ninth"])
    assert rows(found) == [(1, 50, 2)]  # a tie: the least


def test_backcast(spark):
    df = spark.createDataFrame([(1, s, 5, 2007, 15, "R") for s in (41, 11, 21, 10, 20, 9)] + [(2, 41, 6, 2007, 15, "R"), (3, 38, 5, 2007, 15, "R")], "person int, stage int, school int, year int, age int, region string")
    lookup = spark.createDataFrame([("ninth", 5, 55), ("eighth", 5, 56), ("seventh", 5, 57)], "grade string, school int, school_before int")
    attributes = spark.createDataFrame([(55, "N"), (56, "S")], "school int, region string")
    groups = {s: g for g, ss in codes.GUESS_STAGES.items() for s in ss}
    one = impute.backcast(df, 1, codes.ONE_YEAR_BACK, lookup, groups, ages=["age"], attributes=attributes)
    want = [(1, 21, 55, 2006, 14, "N"), (1, 10, 55, 2006, 14, "N"), (1, 20, 56, 2006, 14, "S"), (1, 9, 56, 2006, 14, "S"), (1, 19, 57, 2006, 14, None), (1, 8, 57, 2006, 14, None), (2, 21, None, 2006, 14, None)]
    assert rows(one, "person", "stage", "school", "year", "age", "region") == sorted(want, key=repr)
    two = impute.backcast(df, 2, codes.TWO_YEARS_BACK, lookup, groups, ages=["age"], drop=["region", "not_there"])
    assert sorted(r["stage"] for r in two.where("person = 1").collect()) == [7, 8, 9, 18, 19, 20] and "region" not in two.columns and {r["year"] for r in two.collect()} == {2005}


def test_quality(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), "x"), (3, None, None)], "a int, b double, c string")
    assert [tuple(r) for r in quality.null_profile(df).collect()] == [("b", pytest.approx(66.666667)), ("c", pytest.approx(66.666667)), ("a", 0.0)]
    e = spark.createDataFrame([(1, 2005, 7), (1, 2005, 8), (2, 2005, 7), (3, 2006, 7), (3, 2006, 7), (3, 2006, 7)], "p int, y int, s int")
    assert rows(quality.one_or_many(e, ["p"], "y", "s")) == [(2005, 2, 0.5, 0.5), (2006, 1, 1.0, 0.0)]
    assert rows(quality.duplication_classes(e, ["p"], "y")) == [(2005, "1", 1, 0.5), (2005, "2", 1, 0.5), (2006, "3+", 1, 1.0)]
    assert rows(quality.distribution(e, ["y"], "s"))[0] == (2005, 7, 2, 2 / 3) and rows(quality.distribution(e, [], "s"))[0] == (7, 5, 5 / 6)
    before = spark.createDataFrame([(1, 5, 1, 10), (2, None, 1, 11), (3, 6, 1, 12)], "p int, school int, stage int, age int")
    after = spark.createDataFrame([(1, 5, 2, 11), (2, 7, 2, 12), (3, 8, 2, 12)], "p int, school int, stage int, age int")
    found = {r["check"]: r["value"] for r in quality.replication_checks(before, after, "p", "school", "stage", "age").collect()}
    assert found["rows_before:1"] == 3 and found["match_rate:1"] == pytest.approx(2 / 3) and found["rows_after:2"] == 3
    found |= {r["check"]: r["value"] for r in quality.replication_checks(before.withColumn("s", F.nullif("p", F.lit(1))), after.withColumn("s", F.lit(2)), "p", "school", "stage", "age", "s").collect()}
    assert found["moved_state"] == 0.5 and found["missing_state_before"] == pytest.approx(1 / 3)
    assert found["age_violations"] == 1 and found["moved"] == 0.5 and found["missing_school_before"] == pytest.approx(1 / 3) and found["paired"] == 3


def did_rows(seed=1, units=300):
    rng = np.random.default_rng(seed)
    out = []
    for u in range(units):
        x1, x2 = rng.normal(), rng.normal()
        g = [None, 3, 4][int(rng.choice(3, p=[0.5, 0.25, 0.25] if x1 < 0 else [0.3, 0.35, 0.35]))]
        for t in range(1, 7):
            y = 1 + x1 + 0.5 * t + 0.3 * x1 * t + rng.normal(scale=0.1) + (2.0 * (t - g + 1) if g and t >= g else 0)
            out.append((u, t, float(y), g, float(x1), float(x2)))
    return out


def plain_cell(data, g, t, covariates):
    """Effect and standard error of a cell, from the influence function of each unit."""
    by = {(u, s): (y, own, x) for u, s, y, own, *x in data}
    d, dy, xs = [], [], []
    for (u, s), (y, own, _) in by.items():
        if s != t or (u, g - 1) not in by:
            continue
        if own == g or own is None or own > max(t, g - 1):
            y0, _, x0 = by[u, g - 1]
            d.append(float(own == g))
            dy.append(y - y0)
            xs.append([1.0, *x0])
    d, dy, xs = map(np.array, (d, dy, xs))
    n = len(d)
    if not covariates:
        m1, m0 = dy[d == 1].mean(), dy[d == 0].mean()
        psi = d / d.mean() * (dy - m1) - (1 - d) / (1 - d).mean() * (dy - m0)
        return m1 - m0, np.sqrt((psi**2).mean() / n)
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-xs @ beta))
        beta += np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs, xs.T @ (d - p))
    gamma = np.linalg.lstsq(xs[d == 0], dy[d == 0], rcond=None)[0]
    p, r = 1 / (1 + np.exp(-xs @ beta)), dy - xs @ gamma
    w0 = np.where(d == 0, p / (1 - p), 0.0)
    a1, a0 = (d * r).sum() / d.sum(), (w0 * r).sum() / w0.sum()
    by_outcome = ((1 - d) * r)[:, None] * xs @ np.linalg.inv((xs * (1 - d)[:, None]).T @ xs / n)
    by_chance = (d - p)[:, None] * xs @ np.linalg.inv((xs * (p * (1 - p))[:, None]).T @ xs / n)
    treat = (d * (r - a1) - by_outcome @ (d[:, None] * xs).mean(0)) / d.mean()
    control = (w0 * (r - a0) + by_chance @ ((w0 * (r - a0))[:, None] * xs).mean(0) - by_outcome @ (w0[:, None] * xs).mean(0)) / w0.mean()
    return a1 - a0, np.sqrt(((treat - control) ** 2).mean() / n)


@pytest.mark.parametrize("covariates", [(), ("x1", "x2")])
def test_effects_against_numpy(spark, covariates):
    data = did_rows()
    df = spark.createDataFrame(data, "id int, t int, y double, g int, x1 double, x2 double")
    effects = did.att_gt(df, "y", "t", "id", "g", covariates)
    found = {(r["group"], r["period"]): (r["att"], r["se"]) for r in effects.collect()}
    assert set(found) == {(g, t) for g in (3, 4) for t in range(1, 7)}
    for (g, t), (att, se) in found.items():
        want, error = plain_cell(data, g, t, covariates)
        assert att == pytest.approx(want, abs=1e-5)
        assert se is None if t == g - 1 else se == pytest.approx(error, rel=1e-3)
    shape = {r["event_time"]: r["att"] for r in did.dynamic(effects, did.group_sizes(df, "id", "g")).collect()}
    assert shape[-1] == pytest.approx(0, abs=1e-9)
    with_errors = {r["event_time"]: r for r in did.dynamic(*did.estimate(df, "y", "t", "id", "g", covariates)[:1], did.group_sizes(df, "id", "g"), did.estimate(df, "y", "t", "id", "g", covariates)[1], df, "id", "g").collect()}
    assert with_errors[-1]["se"] is None and with_errors[3]["groups"] == 1
    for e, r in with_errors.items():
        assert r["att"] == pytest.approx(shape[e], abs=1e-9)
        if e != -1:
            assert r["low"] < r["att"] < r["high"]
    # one group only: the error of the cell itself
    assert with_errors[3]["se"] == pytest.approx(found[3, 6][1], rel=1e-6)
    if covariates:
        assert shape[0] == pytest.approx(2, abs=0.1) and shape[2] == pytest.approx(6, abs=0.1)


def test_units_treated_in_the_first_period_have_no_base(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1), (1, 2, 2.0, 1), (2, 1, 1.0, None), (2, 2, 1.0, None)], "id int, t int, y double, g int")
    assert did.att_gt(df, "y", "t", "id", "g").collect() == []


def test_classes(spark):
    a = spark.createDataFrame([("Engenharia Civil", 2010, "x"), ("Medicina", 2010, "m")], "label string, year int, code string")
    b = spark.createDataFrame([("Engenharia Civil", 2009, "y"), ("Música", 2011, "z"), (None, 2011, "n")], "label string, year int, code string")
    union = classify.catalogue([a, b], "label", "year")
    assert rows(union) == sorted([("Engenharia Civil", 2009, "y"), ("Medicina", 2010, "m"), ("Música", 2011, "z")], key=repr)
    assert rows(classify.classify(union, "label", workers=2), "label", "field") == sorted([("Engenharia Civil", "engineering"), ("Medicina", "health"), ("Música", "other")], key=repr)
    assert classify.prompt("Which field is %s (%s)?", union, ["label", "year"]).where("label = 'Medicina'").first()["prompt"] == "Which field is Medicina (2010)?"


def test_streams(spark, small, tmp_path):
    from panelweave.streaming.incremental import match_stream, windowed_counts

    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("counts", windowed_counts(stream, "ts", "event_type"), "complete"), ("marked", match_stream(stream, spark.createDataFrame([(1,), (2,)], "user_id long"), "user_id"), "append")):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == spark.read.parquet(str(tmp_path / "in")).count()
    assert spark.sql("SELECT sum(matched) FROM marked").first()[0] == spark.read.parquet(str(tmp_path / "in")).where("user_id in (1, 2)").count()


def test_random_histories_against_plain(spark):
    rng = random.Random(2)
    data = {k: [rng.randint(0, 1) for _ in range(rng.randint(1, 9))] for k in range(60)}
    df = spark.createDataFrame([(k, i, x) for k, v in data.items() for i, x in enumerate(v)], "e int, t int, x int")
    # long timelines go over several slices
    data |= {k: [rng.random() < 0.97 and 1 or 0 for _ in range(300)] for k in range(60, 70)} | {k: [0] * rng.randint(50, 80) + [1] * 140 + [0, 1] for k in range(70, 75)}
    df = spark.createDataFrame([(k, i, x) for k, v in data.items() for i, x in enumerate(v)], "e int, t int, x int")
    lengths = {}
    for r in panel.runs(df, ["e"], "t", "x").orderBy("e", "run").collect():
        lengths.setdefault(r["e"], []).append((r["value"], r["length"], r["start"]))
    for k, v in data.items():
        starts = [i for i in range(len(v)) if not i or v[i] != v[i - 1]]
        assert lengths[k] == [(v[a], b - a, a) for a, b in zip(starts, [*starts[1:], len(v)])]
    for r in panel.histories(df, ["e"], "t", "x").collect():
        v = data[r["e"]]
        tail = v[v.index(1) :] if 1 in v else []
        assert r["stops"] == sum(a == 1 and b == 0 for a, b in zip(v, v[1:]))
        assert r["first_spell"] == ((tail.index(0) if 0 in tail else len(tail)) if tail else None)


def test_shares_count_entities_and_null_groups_stay(spark):
    df = spark.createDataFrame([(1, 2005, 1, 1), (1, 2005, 1, 1), (2, 2005, 1, 0), (None, 2005, 1, 1), (3, 2005, 0, 1), (4, 2006, 1, 0), (5, 2007, 0, 1)], "s int, y int, census int, part int")
    found = panel.shares_by_period(df, "s", "y", F.col("census") == 1, F.col("part") == 1)
    assert rows(found) == sorted([(2005, 3, 2, pytest.approx(200 / 3)), (2006, 1, None, None)], key=repr)
    e = spark.createDataFrame([(1, 2005), (2, None), (2, None), (3, None)], "p int, y int")
    assert rows(quality.duplication_classes(e, ["p"], "y")) == sorted([(2005, "1", 1, 1.0), (None, "2", 1, 0.5), (None, "1", 1, 0.5)], key=repr)
    assert rows(panel.histories(spark.createDataFrame([(None, 1, 1), (None, 2, 0), (1, 1, None), (1, 2, 1)], "e int, t int, x int"), ["e"], "t", "x")) == sorted([(None, 2, 1, 1, 1, 1), (1, 2, 1, 2, 0, 1)], key=repr)


def test_a_remote_class_is_asked_for_again(spark):
    import time

    calls = []

    def shaky(text):
        calls.append(time.monotonic())
        if len(calls) < 3:
            raise OSError("busy")
        return text.upper()

    assert classify.patient(shaky, retries=2, pause=0.01, least=0.05)("a") == "A"
    assert len(calls) == 3 and calls[1] - calls[0] >= 0.05
    with pytest.raises(ZeroDivisionError):
        classify.patient(lambda x: 1 / 0, retries=1, pause=0.0)("a")

    def broken(text):
        raise OSError("gone")

    df = spark.createDataFrame([("a",), ("a",), (None,)], "label string")
    found = classify.classify(df, "label", function=broken, workers=2, retries=1, pause=0.0, per_second=100, failed="unknown")
    assert rows(found) == sorted([("a", "unknown"), ("a", "unknown"), (None, "unknown")], key=repr)
