from itertools import permutations

import pytest

from alertloom.operators import evals as E
from alertloom.operators import ranking as R

# Published numbers of times each model came first, second, third, fourth in 47
# judged incidents, and the table made from them (mean place, percent of wins).
PLACES = {"GPT-4o": [28, 12, 3, 4], "GPT-4o-mini": [15, 31, 1, 0], "Qwen2.5 3b": [3, 4, 33, 7],
          "Qwen2.5": [1, 0, 10, 36]}
PUBLISHED = {"GPT-4o": (1.64, 59.6), "GPT-4o-mini": (1.70, 31.9), "Qwen2.5 3b": (2.94, 6.4), "Qwen2.5": (3.72, 2.1)}
RESULT = ("incident_id string, category string, event_count bigint, threat_level double, "
          "rankings map<string,string>, scores map<string,double>")


def rankings_with(places):
    """Orders of the models that add up to the given place counts."""
    models, left = list(places), {m: list(p) for m, p in places.items()}
    orders = list(permutations(models))

    def fill(total, start):
        if total == 0:
            return []
        for n in range(start, len(orders)):
            if all(left[m][p] > 0 for p, m in enumerate(orders[n])):
                for p, m in enumerate(orders[n]):
                    left[m][p] -= 1
                rest = fill(total - 1, n)
                if rest is not None:
                    return [orders[n], *rest]
                for p, m in enumerate(orders[n]):
                    left[m][p] += 1
        return None

    return fill(sum(places[models[0]]), 0)


def result(i, ranking, scores=None, category="Malware", events=10):
    return (str(i), category, events, 1.0, {str(p + 1): m for p, m in enumerate(ranking)},
            {m: 5.0 for m in ranking} if scores is None else scores)


def test_published_overall_table(spark):
    results = spark.createDataFrame([result(i, r) for i, r in enumerate(rankings_with(PLACES))], RESULT)
    stats = {r["model"]: r for r in R.model_stats(results).collect()}
    for model, (place, wins) in PUBLISHED.items():
        assert abs(stats[model]["avg_position"] - place) < 0.01 and abs(stats[model]["win_rate"] - wins) < 0.1
        assert [stats[model][f"position_{p}"] for p in (1, 2, 3, 4)] == PLACES[model]
    ranked = {r["model"]: r["rank"] for r in R.model_rank(R.model_stats(results)).collect()}
    assert ranked == {m: n for n, m in enumerate(PUBLISHED, 1)}


def test_cells_without_positions_are_zero(spark):
    rows = [result(1, ["a", "b"]), result(2, ["a"], {"a": 4.0, "b": 9.0}, "Normal"),
            result(3, ["b", "a"], category="Other", events=5000)]
    results = spark.createDataFrame(rows, RESULT)
    cells = {(r["category"], r["model"]): r for r in R.model_by_category(results).collect()}
    assert set(cells) == {(c, m) for c in ("Malware", "Normal") for m in "ab"}
    assert (cells["Normal", "b"]["count"], cells["Normal", "b"]["avg_score"]) == (0, 0.0)
    tiers = {(r["complexity"], r["model"]): r["wins"] for r in R.model_by_complexity(results).collect()}
    assert tiers["complex", "b"] == 1 and tiers["medium", "a"] == 0
    best = {r["scope"]: r["model"] for r in R.best_model(R.model_stats(results), R.model_by_category(results)).collect()}
    assert best == {"overall": "a", "Malware": "a", "Normal": "a"}


def test_fifth_place_counts_in_no_mean(spark):
    results = spark.createDataFrame([result(1, list("abcde"))], RESULT)
    stats = {r["model"]: r for r in R.model_stats(results).collect()}
    assert stats["e"]["avg_position"] == 0.0 and stats["d"]["avg_position"] == 4.0


def test_head_to_head_places_absent_models_last(spark):
    rows = [result(1, ["a", "b", "c"]), result(2, ["b"], {"a": 1.0, "b": 2.0, "c": 3.0}), result(3, ["c", "a"])]
    duels = {(r["model"], r["rival"]): r["wins"] for r in R.head_to_head(spark.createDataFrame(rows, RESULT)).collect()}
    assert duels == {("a", "b"): 2, ("b", "a"): 1, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 2, ("c", "b"): 1}


def test_a_model_placed_twice_keeps_its_last_place(spark):
    rows = [result(1, ["a", "b", "a", "unknown", "unknown", "c"], {"a": 1.0, "b": 2.0, "c": 3.0}), result(2, ["b", "a"], {})]
    df = spark.createDataFrame(rows, RESULT)
    duels = {(r["model"], r["rival"]): (r["wins"], r["total"]) for r in R.head_to_head(df, ["a", "b", "c", "d"]).collect()}
    # First result: b 2, a 3, c 6, d absent and so 5. Second: b 1, a 2, c and d absent.
    assert duels == {("a", "b"): (0, 2), ("b", "a"): (2, 2), ("a", "c"): (2, 2), ("c", "a"): (0, 2), ("b", "c"): (2, 2), ("c", "b"): (0, 2),
                     ("a", "d"): (2, 2), ("d", "a"): (0, 2), ("b", "d"): (2, 2), ("d", "b"): (0, 2), ("c", "d"): (0, 2), ("d", "c"): (1, 2)}
    table = {r["incident_id"]: r for r in R.judge_table(df, {"a": "a", "b": "b"}).collect()}
    assert sorted(r["a_position"] for r in table.values()) == [2, 3]


def test_judge_table_leaves_gaps(spark):
    results = spark.createDataFrame([result(1, ["b", "a"])], RESULT)
    row = R.judge_table(results, {"a": "a", "ghost": "never there"}).first()
    assert (row["rank_1"], row["rank_3"], row["a_position"], row["ghost_score"]) == ("b", None, 2, None)


def test_mean_rank_may_leave_out_the_last_suite(spark):
    # Nine suites that add up to 580 gave the published mean of 64.44.
    scores = [100.0, 80.0, 60.0, 100.0, 40.0, 50.0, 50.0, 50.0, 50.0, 0.0]
    suites = [f"s{i}" for i in range(10)]
    matrix = spark.createDataFrame([("m", *scores)], "provider string, " + ", ".join(f"{s} double" for s in suites))
    assert abs(E.mean_rank(matrix, drop_last=True).first()["score"] - 64.44) < 0.01
    assert E.mean_rank(matrix).first()["score"] == 58.0


def test_best_and_fast(spark):
    long = spark.createDataFrame([("s", "a", 90.0), ("s", "b", 90.0), ("t", "b", 50.0), ("t", "c", 40.0)],
                                 "suite string, provider string, score double")
    bench = spark.createDataFrame([("a", 9.0), ("b", 5.0), ("c", 20.0)], "model string, tokens_per_second double")
    pairs = {r["suite"]: r for r in E.best_fast_per_suite(long, bench).collect()}
    assert (pairs["s"]["best_model"], pairs["s"]["fast_model"]) == ("a", "a")
    # c is fast but best nowhere, so it is no candidate.
    assert (pairs["t"]["best_model"], pairs["t"]["fast_model"]) == ("b", None)
    kinds = E.gap_rows(E.best_fast_per_suite(long, bench)).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in kinds} == {"Best Overall": 2, "Best >8 TPS": 2}
    added = E.append_rows(bench, [{"model": "d", "tokens_per_second": 8.13}, {"model": "e"}])
    assert added.count() == 5 and E.speed_of_best(E.best_per_suite(long), bench).count() == 2


def test_pass_rate_rounds_and_leaves_out(spark):
    runs = spark.createDataFrame([("a", "s", 1, 2), ("a", "s", 1, 0), ("b", "s", 0, 0)],
                                 "provider string, suite string, passed int, failed int")
    rates = {r["provider"]: r["pass_rate"] for r in E.pass_rate(runs).collect()}
    assert rates == {"a": 50.0, "b": None}
    assert E.pass_rate(runs, leave_out=["a"]).count() == 1


@pytest.mark.parametrize("share, band", [(60.0, "high"), (59.9, "medium"), (40.0, "medium"), (39.9, "low")])
def test_win_band(spark, share, band):
    from pyspark.sql import functions as F

    from alertloom.functions.alerts import win_band
    assert spark.range(1).select(win_band(F.lit(share))).first()[0] == band
