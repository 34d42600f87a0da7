import pytest

from gradeflow.operators import compare as cm


def verdict(spark, base, cand, target=None):
    rows = lambda m: spark.createDataFrame([("v", k, v) for k, v in m.items()], "version string, metric string, value double")
    compared = cm.delta_status(cm.metric_full_join(rows(base), rows(cand)))
    row = cm.regression_verdict(compared, target).first()
    return row.recommendation, row.reasons


def test_thresholds(spark):
    assert verdict(spark, {"f1": 1.0}, {"f1": 1.0}) == ("APPROVE", [cm.DEFAULT_REASON])
    assert verdict(spark, {"f1": 1.0}, {"f1": 0.995})[0] == "APPROVE"
    assert verdict(spark, {"f1": 1.0}, {"f1": 0.99}) == ("NEEDS_REVIEW", ["Soft regression on f1: -1.0%"])
    assert verdict(spark, {"f1": 1.0}, {"f1": 0.98})[0] == "NEEDS_REVIEW"
    assert verdict(spark, {"f1": 1.0}, {"f1": 0.97}) == ("REJECT", ["Hard regression on f1: -3.0%"])


def test_soft_reasons_are_left_out_under_reject(spark):
    got = verdict(spark, {"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 0.9, "b": 0.99, "c": 0.5})
    assert got == ("REJECT", ["Hard regression on a: -10.0%", "Hard regression on c: -50.0%"])


def test_target(spark):
    base = {"math_f1": 1.0, "other": 1.0}
    assert verdict(spark, base, {"math_f1": 1.03, "other": 1.0}, "MATH")[0] == "APPROVE"
    got = verdict(spark, base, {"math_f1": 1.01, "other": 1.0}, "Math")
    assert got == ("NEEDS_REVIEW", ["Target weakness 'Math' improvement (1.0%) below minimum (3%)"])
    assert verdict(spark, base, {"math_f1": 1.0, "other": 0.5}, "math")[0] == "REJECT"
    assert len(verdict(spark, base, {"math_f1": 1.0, "other": 0.5}, "math")[1]) == 2
    assert verdict(spark, base, base, "absent")[0] == "APPROVE"


def test_missing_metric_counts_as_zero(spark):
    assert verdict(spark, {"f1": 0.5}, {"other": 0.2})[0] == "REJECT"
    assert verdict(spark, {}, {"f1": 0.2})[0] == "APPROVE"  # zero baseline is neutral


def test_monotone_in_the_worst_change(spark):
    order = ["APPROVE", "NEEDS_REVIEW", "REJECT"]
    seen = [order.index(verdict(spark, {"f1": 1.0}, {"f1": v / 1000})[0]) for v in (1010, 997, 992, 981, 975, 900)]
    assert seen == sorted(seen)


@pytest.mark.parametrize("pre, post, label", [
    (0.2369, 0.2712, "+0.0343 (+14.5%)"), (0.2977, 0.3344, "+0.0367 (+12.3%)"), (0.1856, 0.2125, "+0.0269 (+14.5%)"),
])
def test_labels_of_a_known_run(spark, pre, post, label):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("v", "m", pre, post)], "version string, metric string, baseline double, candidate double")
    got = cm.delta_status(df).select(cm.delta_label(F.col("delta"), F.col("delta_pct"))).first()[0]
    assert got == label


def test_lower_is_better(spark):
    df = spark.createDataFrame([("v", "loss", 1.0, 0.5)], "version string, metric string, baseline double, candidate double")
    assert cm.delta_status(df).first().status == "regressed"
    assert cm.delta_status(df, ("loss",)).first().status == "improved"
