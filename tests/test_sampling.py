import hashlib

import pytest
from pyspark.sql import functions as F

from alertloom.operators import sampling as S


def rank(identity, seed=0):
    return hashlib.md5(f"{seed}|{identity}".encode()).hexdigest()


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(5000).select(
        F.concat(F.lit("i"), F.col("id").cast("string")).alias("incident_id"), F.col("id").alias("pos"),
        # One file holds a third of all incidents.
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("f"), (F.col("id") % 9).cast("string")))
        .alias("source_file"),
        F.when(F.col("id") % 4 == 0, "High").when(F.col("id") % 4 == 1, "low").alias("severity"),
        F.when(F.col("id") % 2 == 0, "Normal").otherwise("Malware").alias("category"))


def ids(df):
    return sorted(r["incident_id"] for r in df.select("incident_id").collect())


def expected(rows, n, seed=0):
    return sorted(sorted((r["incident_id"] for r in rows), key=lambda i: rank(i, seed))[:n])


@pytest.mark.parametrize("n", [0, 7, 1500, 99_999])
def test_global_take(pool, n):
    rows = pool.collect()
    assert ids(S.take_by_hash(pool, "incident_id", n=n)) == expected(rows, n)


@pytest.mark.parametrize("n", [3, 1100, 1700])
def test_take_per_group(pool, n):
    files = {}
    for r in pool.collect():
        files.setdefault(r["source_file"], []).append(r)
    want = sorted(i for rows in files.values() for i in expected(rows, n))
    assert ids(S.take_by_hash(pool, "incident_id", n=n, by=["source_file"])) == want


def test_rows_behind_the_last_slot_are_dropped_before_ranking(pool):
    for by in ([], ["source_file"]):
        plan = S.take_by_hash(pool, "incident_id", n=3, by=by)._jdf.queryExecution().optimizedPlan().toString()
        ranking = plan.index("row_number")
        assert "<=" in plan[ranking:] and "_slot" in plan[ranking:] and plan.count("Join") <= len(by)


def test_sample_follows_its_filters(pool):
    drawn = S.sample_incidents(pool, n=20, files=4, per_file=10, category="normal", severity="HIGH", seed=5)
    rows = drawn.collect()
    assert len(rows) == 20 and {r["category"] for r in rows} == {"Normal"}
    assert {r["severity"] for r in rows} == {"High"} and len({r["source_file"] for r in rows}) <= 4
    assert ids(S.sample_incidents(pool, n=20, files=4, per_file=10, category="normal", severity="HIGH",
                                  seed=5)) == sorted(r["incident_id"] for r in rows)
    with pytest.raises(ValueError):
        S.sample_incidents(pool)


def stratified(spark, normal, tiers, target):
    rows = [(f"n{i}", i, "Normal", 10) for i in range(normal)]
    for size, count in zip((10, 600, 3000), tiers):
        rows += [(f"m{size}-{i}", 1000 + i, "Malware", size) for i in range(count)]
    rows += [(f"o{i}", 5000 + i, "Other", 10) for i in range(4)]
    df = spark.createDataFrame(rows, "incident_id string, pos int, category string, event_count int")
    out = S.stratified_sample(df, target=target).collect()
    assert sorted(r["sample_order"] for r in out) == list(range(1, len(out) + 1))
    count = {}
    for r in out:
        key = "normal" if r["category"] == "Normal" else r["event_count"]
        count[key] = count.get(key, 0) + 1
    return [count.get(k, 0) for k in ("normal", 10, 600, 3000)], out


@pytest.mark.parametrize("normal, tiers, target, want", [
    (4, (9, 9, 9), 11, [4, 3, 2, 2]),        # remainder 1
    (4, (9, 9, 9), 12, [4, 3, 3, 2]),        # remainder 2
    (4, (9, 0, 9), 10, None),                # a short tier is filled from the others
    (4, (1, 1, 1), 50, [4, 1, 1, 1]),        # too few in all
    (0, (0, 0, 0), 5, [0, 0, 0, 0]),
])
def test_stratified_quotas(spark, normal, tiers, target, want):
    got, _ = stratified(spark, normal, tiers, target)
    if want is None:
        assert sum(got) == target and got[0] == 4 and got[2] == 0 and got[1] >= 2 and got[3] >= 2
    else:
        assert got == want


def test_enough_normals_are_taken_in_input_order(spark):
    got, rows = stratified(spark, 9, (3, 3, 3), 6)
    assert got == [6, 0, 0, 0] and {r["incident_id"] for r in rows} == {f"n{i}" for i in range(6)}


def test_mix_checks_and_sizes(pool):
    a, b = pool.where("category = 'Normal'"), pool.where("category = 'Malware'").limit(333)
    mixed = S.mix([a, b], [0.75, 0.25], "incident_id")
    by = {r["category"]: r["count"] for r in mixed.groupBy("category").count().collect()}
    assert by == {"Normal": int(2500 * 0.75), "Malware": int(333 * 0.25)}
    with pytest.raises(ValueError):
        S.mix([a, b], [0.5], "incident_id")
    with pytest.raises(ValueError):
        S.mix([a, b], [0.5, 0.6], "incident_id")


def test_labels_are_a_permutation(pool):
    rows = S.label_shuffle(pool.limit(50), ["m1", "m2", "m3", "m4"], ["A", "B", "C", "D"]).collect()
    assert all(sorted(r["randomization"].values()) == ["m1", "m2", "m3", "m4"] for r in rows)
    assert len({tuple(sorted(r["randomization"].items())) for r in rows}) > 5


def test_accept_first(spark):
    attempts = spark.range(1, 100).select(F.col("id").alias("attempt"), (F.col("id") % 5 == 0).alias("valid"))
    rows = S.accept_first(attempts, 4).collect()
    assert [r["attempt"] for r in rows] == [5, 10] and rows[0]["shortfall"] == 2


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "category string, severity string, dataset string, num_events bigint")
    values = {r["metric"]: r["value"] for r in S.sample_statistics(empty).collect()}
    assert values["total_incidents"] == 0 and values["min_events"] is None
