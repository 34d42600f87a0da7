import pytest
from pyspark.errors import PySparkException

from gradeflow.operators import grading as g

TRUTH = "id long, answer_idx string, meta_info string"
SUB = "id string, predicted_idx string, pos long"


def graded(spark, truth, sub):
    return g.score_submission(spark.createDataFrame(truth, TRUTH), spark.createDataFrame(sub, SUB), ["pos"])


def test_lenient_cases(spark):
    truth = [(0, "A", "x"), (1, "B", "x"), (2, "C", None), (3, "D", "y"), (4, "A", "y")]
    sub = [("0", " a ", 0), ("0", "B", 1), ("1", "E", 2), ("2", "c\t", 3), ("3", None, 4), ("9", "A", 5)]
    rows = {r.id: (r.predicted_idx, r.correct) for r in graded(spark, truth, sub).collect()}
    assert rows == {0: ("A", True), 1: ("", False), 2: ("C", True), 3: ("", False), 4: ("", False)}


def test_overall_keeps_null_slice_and_slices_do_not(spark):
    truth = [(0, "A", None), (1, "A", "x"), (2, "A", "x")]
    rows = g.accuracy_rollup(graded(spark, truth, [("0", "A", 0), ("1", "A", 1)])).collect()
    got = {(r.is_total, r.meta_info): (r.accuracy, r.n_total, r.n_correct) for r in rows}
    assert got == {(True, None): (2 / 3, 3, 2), (False, "x"): (0.5, 2, 1)}


def test_hard_failures(spark):
    truth = spark.createDataFrame([(0, "A", "x")], TRUTH)
    with pytest.raises(ValueError, match="missing columns"):
        g.score_submission(truth, spark.createDataFrame([(0,)], "id long"), ["id"])
    with pytest.raises(ValueError, match="missing columns"):
        g.score_submission(truth.drop("meta_info"), spark.createDataFrame([("0", "A", 0)], SUB), ["pos"])
    for bad in ("seven", None):
        with pytest.raises(PySparkException):
            graded(spark, [(0, "A", "x")], [(bad, "A", 0)]).collect()


def test_extra_and_missing(spark):
    truth = spark.createDataFrame([(0, "A", "x"), (1, "B", "x")], TRUTH)
    sub = spark.createDataFrame([("0", "A", 0), ("7", "A", 1), ("7", "B", 2)], SUB)
    assert [r.id for r in g.missing_predictions(truth, sub).collect()] == [1]
    assert [(r.id, r.n_rows) for r in g.extra_predictions(truth, sub).collect()] == [(7, 2)]
    assert [r.id for r in g.extra_id_set(truth, sub).collect()] == [7]


def test_hot_id_keeps_the_first(spark, partitions):
    sub = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 5 else id end as id", "cast(id as string) as predicted_idx", "id as pos")
    rows = partitions(lambda: g.first_submission(sub, ["pos"]))
    assert dict((r[0], r[1:]) for r in rows)[5] == ("0", 1000)


def test_macro_f1_counts(spark):
    truth = [(0, "A", "x"), (1, "A", "x"), (2, "B", "x")]
    rows = g.letter_macro_f1(graded(spark, truth, [("0", "A", 0), ("1", "B", 1), ("2", "B", 2)])).collect()
    got = {r.letter: (r.tp, r.fp, r.fn) for r in rows}
    assert got == {"A": (1, 0, 1), "B": (1, 1, 0), "C": (0, 0, 0), "D": (0, 0, 0)}
