import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lexsieve.functions.pvalues import mcnemar_p, mcnemar_statistic
from lexsieve.operators import combine, decision, mcnemar, ranking, threshold


def frame(spark, true, score, pred=None):
    pred = pred or [int(s >= 0.5) for s in score]
    rows = [(i, t, float(s), p) for i, (t, s, p) in enumerate(zip(true, score, pred))]
    return spark.createDataFrame(rows, "index int, y_true int, y_score double, y_pred int")


TRUE = [0, 0, 1, 1, 0, 1, 0, 0, 1, 0]
SCORE = [.1, .4, .9, .8, .2, .7, .3, .6, .55, .05]


def test_hand_computed_areas(spark):
    row = ranking.compute_metrics(frame(spark, TRUE, SCORE), []).first()
    assert row["pr_auc"] == pytest.approx(0.95) and row["roc_auc"] == pytest.approx(23 / 24)
    scaled = ranking.ranking_metrics(frame(spark, TRUE, [2.5 * s + 7 for s in SCORE], [0] * 10), []).first()
    assert scaled["pr_auc"] == pytest.approx(0.95) and scaled["roc_auc"] == pytest.approx(23 / 24)


def brute(true, score):
    p, n = sum(true), len(true) - sum(true)
    ap, tp, fp = 0.0, 0, 0
    for s in sorted(set(score), reverse=True):
        here = [t for t, x in zip(true, score) if x == s]
        tp, fp = tp + sum(here), fp + len(here) - sum(here)
        ap += sum(here) / p * tp / (tp + fp)
    wins = sum((a > b) + (a == b) / 2 for t, a in zip(true, score) if t for u, b in zip(true, score) if not u)
    return ap, wins / p / n


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_areas_match_brute_force_with_hot_scores(spark, buckets):
    rng = random.Random(5)
    score = [rng.choice([0.5, round(rng.random(), 2), rng.random() * 1e-9, rng.random()]) for _ in range(300)]
    true = [int(rng.random() < 0.2 + 0.5 * s) for s in score]
    df = frame(spark, true, score).withColumn("run_id", F.lit("a")).unionByName(
        frame(spark, true[::-1], score).withColumn("run_id", F.lit("b")))
    got = {r["run_id"]: r for r in ranking.ranking_metrics(df, ["run_id"], buckets=buckets).collect()}
    for run, t in (("a", true), ("b", true[::-1])):
        ap, auc = brute(t, score)
        assert got[run]["pr_auc"] == pytest.approx(ap) and got[run]["roc_auc"] == pytest.approx(auc)


def test_undefined_areas_and_bad_input_raise(spark):
    with pytest.raises(Exception, match="both classes"):
        ranking.roc_auc(frame(spark, [1, 1], [.1, .2]), []).collect()
    with pytest.raises(Exception, match="positives"):
        ranking.average_precision(frame(spark, [0, 0], [.1, .2]), []).collect()
    with pytest.raises(Exception, match="numeric"):
        ranking.average_precision(frame(spark, [0, 1], [.1, float("nan")], [0, 0]), []).collect()
    decision.check_binary(frame(spark, TRUE, SCORE), "y_true", "y_pred", score="y_score")
    with pytest.raises(ValueError):
        decision.check_binary(frame(spark, [0, 2], [.1, .2]), "y_true")
    with pytest.raises(ValueError):
        decision.check_binary(frame(spark, TRUE, SCORE).limit(0), "y_true")


def test_confusion_and_decision_metrics(spark):
    df = frame(spark, [0] * 4 + [1] * 6, [0] * 10, [0, 0, 0, 1, 0, 0, 1, 1, 1, 1])
    row = decision.decision_metrics(df, []).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (3, 1, 2, 4)
    assert row["precision_minority"] == pytest.approx(0.8) and row["recall_minority"] == pytest.approx(2 / 3)
    assert row["f1_macro"] == pytest.approx((8 / 11 + 6 / 9) / 2)
    none = decision.decision_metrics(frame(spark, [0, 0], [0, 0], [0, 0]), []).first()
    assert none["precision_minority"] == 0.0 and none["f1_minority"] == 0.0 and none["f1_macro"] == 1.0


def test_threshold_fit(spark):
    df = frame(spark, [1] * 5 + [0] * 5, [.91, .85, .77, .71, .63, .37, .31, .23, .17, .11])
    assert threshold.fit_threshold(df).value == 0.38
    assert len(threshold.GRID) == 91 and threshold.GRID[0] == 0.05 and threshold.GRID[-1] == 0.95
    decided = frame(spark, [0] * 5, [.1, .6, .4, .9, .5]).select("index", threshold.decide("y_score", 0.5).alias("p")).orderBy("index")
    assert [r["p"] for r in decided.collect()] == [0, 1, 0, 1, 1]
    with pytest.raises(Exception):
        threshold.fit_threshold(df).value = 0.1


def test_scores_on_grid_points_and_both_objectives(spark):
    rng = random.Random(11)
    score = [i / 100 for i in range(101)] + [rng.random() for _ in range(100)] + [-3.0, 7.5]
    true = [int(rng.random() < s) if 0 <= s <= 1 else 1 for s in score]
    df = frame(spark, true, score, [0] * len(score))
    sweep = {r["threshold"]: r for r in threshold.threshold_sweep(df, []).collect()}
    assert sorted(sweep) == list(threshold.GRID)

    def f1(a, b, c):
        return 2 * a / (2 * a + b + c) if 2 * a + b + c else 0.0

    best = {"f1_minority": (-1, None), "f1_macro": (-1, None)}
    for t in threshold.GRID:
        pred = [int(s >= t) for s in score]
        tp = sum(p and y for p, y in zip(pred, true))
        fp, fn = sum(pred) - tp, sum(true) - tp
        tn = len(true) - tp - fp - fn
        assert (sweep[t]["tp"], sweep[t]["fp"], sweep[t]["fn"], sweep[t]["tn"]) == (tp, fp, fn, tn)
        for name, value in (("f1_minority", f1(tp, fp, fn)), ("f1_macro", (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2)):
            if value > best[name][0]:
                best[name] = (value, t)
    for name, (_, t) in best.items():
        assert threshold.fit_threshold(df, name).value == t


def test_threshold_errors(spark):
    good = frame(spark, TRUE, SCORE)
    with pytest.raises(ValueError, match="objective"):
        threshold.fit_threshold(good, "pr_auc")
    with pytest.raises(ValueError, match="single class"):
        threshold.fit_threshold(frame(spark, [1, 1], [.1, .2]))
    with pytest.raises(ValueError):
        threshold.fit_threshold(frame(spark, [0, 3], [.1, .2]))
    with pytest.raises(ValueError, match="no validation"):
        threshold.fit_threshold(good.limit(0))


def test_mcnemar_cases(spark):
    cases = [(0, 0, 0.0, 1.0), (2, 4, 2.0, 0.6875), (25, 15, 2.025, math.erfc(math.sqrt(2.025 / 2))), (0, 12, 0.0, 2 / 2 ** 12),
             (12, 12, 12.0, 1.0), (102, 256, 65.388268, 6.15e-16), (343, 486, 24.323281061519904, 8.144868043966576e-07),
             (671, 259, 181.63548387096773, 2.129788900956618e-41)]
    df = spark.createDataFrame([(b, c) for b, c, _, _ in cases], "b bigint, c bigint")
    got = df.select("b", "c", mcnemar_statistic(F.col("b"), F.col("c")).alias("s"), mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()
    by = {(r["b"], r["c"]): r for r in got}
    for b, c, s, p in cases:
        assert by[b, c]["s"] == pytest.approx(s, rel=1e-6) and by[b, c]["p"] == pytest.approx(p, rel=1e-2 if b == 102 else 1e-9)


def runs(spark, spec):
    rows = [(run, i, t, p) for run, pairs in spec.items() for i, (t, p) in pairs.items()]
    return spark.createDataFrame(rows, "run_id string, index bigint, y_true int, y_pred int")


def test_all_pairs_match_pairwise_joins_and_swap(spark):
    rng = random.Random(2)
    truth = {i: rng.randrange(2) for i in range(80)}
    spec = {f"r{k}": {i: (t, t if rng.random() < 0.7 else 1 - t) for i, t in truth.items() if rng.random() < 0.9} for k in range(4)}
    pred = runs(spark, spec)
    ids = spark.createDataFrame([(r,) for r in spec], "run_id string")
    got = {(r["run_a"], r["run_b"]): r for r in mcnemar.compare_pairs(pred.repartition(5), mcnemar.run_pairs(ids)).collect()}
    assert len(got) == 6
    swapped = spark.createDataFrame([(b, a) for a, b in got], "run_a string, run_b string")
    back = {(r["run_a"], r["run_b"]): r for r in mcnemar.compare_pairs(pred, swapped).collect()}
    for (a, b), r in got.items():
        common = spec[a].keys() & spec[b].keys()
        right = {x: {i for i in common if spec[x][i][0] == spec[x][i][1]} for x in (a, b)}
        assert (r["n_rows"], r["b"], r["c"]) == (len(common), len(right[a] - right[b]), len(right[b] - right[a]))
        assert (back[b, a]["b"], back[b, a]["c"], back[b, a]["p_value"]) == (r["c"], r["b"], r["p_value"])


def test_conflicting_truth_raises_and_disjoint_runs_are_skipped(spark):
    pair = spark.createDataFrame([("a", "b")], "run_a string, run_b string")
    with pytest.raises(Exception, match="true labels differ"):
        mcnemar.compare_pairs(runs(spark, {"a": {1: (0, 0)}, "b": {1: (1, 1)}}), pair).collect()
    assert mcnemar.compare_pairs(runs(spark, {"a": {1: (0, 0)}, "b": {2: (1, 1)}}), pair).collect() == []


def test_many_runs_in_small_groups_and_chunks(spark, monkeypatch):
    """Parts, chunks, words and groups of runs are all crossed; equal repeats and unused runs change nothing."""
    monkeypatch.setattr(mcnemar, "GROUP_RUNS", 3)
    monkeypatch.setattr(mcnemar, "CHUNK_WORDS", 1)
    monkeypatch.setattr(mcnemar, "_HELD_WORDS", 2)
    rng = random.Random(8)
    truth = {i: rng.randrange(2) for i in range(1500)}
    spec = {f"r{k:02d}": {i: (t, t if rng.random() < 0.8 else 1 - t) for i, t in truth.items() if rng.random() < 0.6} for k in range(8)}
    pred = runs(spark, spec)
    ids = spark.createDataFrame([(r,) for r in [*spec, "unused"]], "run_id string")
    got = {(r["run_a"], r["run_b"]): (r["n_rows"], r["b"], r["c"])
           for r in mcnemar.compare_pairs(pred.union(pred.limit(400)), mcnemar.run_pairs(ids)).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(spec), 2):
        common = spec[a].keys() & spec[b].keys()
        right = {x: {i for i in common if spec[x][i][0] == spec[x][i][1]} for x in (a, b)}
        want[a, b] = (len(common), len(right[a] - right[b]), len(right[b] - right[a]))
    assert got == want


def test_two_thousand_runs_against_one(spark):
    rows = spark.range(2000 * 70).selectExpr(
        "concat('r', id div 70) run_id", "id % 70 index", "cast(id % 70 % 2 as int) y_true",
        "cast(if(id % 70 = (id div 70) % 70, 1 - id % 70 % 2, id % 70 % 2) as int) y_pred")
    pairs = spark.range(1, 2000).selectExpr("'r0' run_a", "concat('r', id) run_b")
    got = mcnemar.compare_pairs(rows, pairs).groupBy("n_rows", "b", "c").count().collect()
    # run k is wrong on row k mod 70 only
    same = sum(k % 70 == 0 for k in range(1, 2000))
    assert {tuple(r) for r in got} == {(70, 0, 0, same), (70, 1, 1, 1999 - same)}


def test_no_pairs_give_no_rows(spark):
    pred = runs(spark, {"a": {1: (0, 0)}})
    assert mcnemar.run_pairs(spark.createDataFrame([("a",)], "run_id string")).collect() == []
    none = spark.createDataFrame([], "run_a string, run_b string")
    assert mcnemar.compare_pairs(pred, none).collect() == [] and mcnemar.compare_pairs(pred.limit(0), none).collect() == []


def test_ensembles(spark):
    a = frame(spark, TRUE, SCORE)
    b = frame(spark, TRUE, [1 - s for s in SCORE])
    pair = combine.paired_scores(a, b, ["index"])
    assert {round(r["y_score"], 9) for r in combine.soft_vote(pair).collect()} == {0.5}
    with pytest.raises(Exception, match="differ"):
        combine.paired_scores(a, frame(spark, [1 - t for t in TRUE], SCORE), ["index"]).collect()
    split = pair.withColumn("split", F.when(F.col("index") < 6, "val").otherwise("test"))
    stacked = combine.stack(split)
    assert stacked.count() == 4 and all(0 <= r["y_score"] <= 1 for r in stacked.collect())
    moved = combine.stack(split.withColumn("score_a", F.when(F.col("split") == "test", 0.0).otherwise(F.col("score_a"))))
    assert {round(r["y_score"], 6) for r in moved.collect()} != set() and moved.count() == 4
    errors = combine.error_samples(a.withColumn("y_pred", 1 - F.col("y_true")), 2, "index").collect()
    assert sorted(r["error"] for r in errors) == ["false_negative"] * 2 + ["false_positive"] * 2
