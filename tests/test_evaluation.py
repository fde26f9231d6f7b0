import pytest

from ragstone.operators import evaluation as E
from ragstone.operators import metrics as M


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_joins_refuse_what_does_not_match(spark):
    a, b = frame(spark, [(1, "x"), (2, "y")], "k int, a string"), frame(spark, [(1, 5), (2, 6)], "k int, b int")
    assert sorted(map(tuple, E.one_to_one(a, b, ["k"]).collect())) == [(1, "x", 5), (2, "y", 6)]
    for other in ([(1, 5)], [(1, 5), (2, 6), (2, 7)], [(1, 5), (2, 6), (3, 7)]):
        with pytest.raises(Exception, match="one to one"):
            E.one_to_one(a, frame(spark, other, "k int, b int"), ["k"]).collect()
    assert E.with_condition(a, frame(spark, [(1, 5), (2, 6), (3, 7)], "k int, b int"), ["k"]).count() == 2
    with pytest.raises(Exception, match="one condition"):
        E.with_condition(a, b.filter("k = 1"), ["k"]).collect()


def test_all_strata_must_be_there(spark):
    rows = [(s, "train", 1) for s in E.SAMPLING_STRATA] + [("automatic_positive", "test", 1), ("partial_overlap", "validation", None)]
    labels = frame(spark, rows, "stratum string, split string, y_suff int")
    assert {r.stratum: r["size"] for r in E.stratum_frequencies(labels).collect()} == dict.fromkeys(E.SAMPLING_STRATA, 1)
    for bad in (labels.filter("stratum <> 'partial_overlap'"), labels.unionByName(frame(spark, [("other", "train", 0)], labels.schema))):
        with pytest.raises(Exception, match="stratum is empty or unknown"):
            E.stratum_frequencies(bad).collect()


KEY = "sample_id string, automatic_y_suff int, sampling_stratum string"
ROW = "sample_id string, annotator_id string, annotation_timestamp string, manual_label string"


def test_annotations_are_cleaned_and_checked(spark):
    key = frame(spark, [("s1", 1, "automatic_positive"), ("s2", 0, "partial_overlap")], KEY)
    rows = frame(spark, [(" s1 ", " a ", "t", " Sufficient"), ("s2", "a", "t", "AMBIGUOUS "), ("s2", "b", "t", "  "), ("s1", "b", None, None)], ROW)
    got = sorted(map(tuple, E.completed_annotations(rows, key).collect()))
    assert got == [("s1", "a", "t", "sufficient"), ("s2", "a", "t", "ambiguous")]
    bad = [("s1", "a", "t", "maybe"), ("s1", " ", "t", "sufficient"), ("s1", "a", "", "sufficient"), ("s9", "a", "t", "sufficient")]
    for row in bad:
        with pytest.raises(Exception, match="label|annotator|time|key"):
            E.completed_annotations(frame(spark, [row], ROW), key).collect()
    with pytest.raises(Exception, match="two annotations"):
        E.completed_annotations(frame(spark, [("s1", "a", "t", "sufficient")] * 2, ROW), key).collect()
    with pytest.raises(ValueError, match="sampling_stratum"):
        E.completed_annotations(rows.withColumnRenamed("annotation_timestamp", "sampling_stratum"), key)


def test_strata_and_reasons(spark):
    from pyspark.sql import functions as F

    rows = frame(spark, [(1, 1, None), (0, 1, 0.1), (0, 0, 0.2), (1, 0, 0.9)], "strict int, other int, c double")
    got = [tuple(r) for r in rows.select(E.confirmation_stratum(F.col("strict"), F.col("other")), E.retention_stratum(F.col("strict"), F.col("other")), E.coverage_band(F.col("c"), F.lit(0.2))).collect()]
    assert got == [
        ("strict_positive_semantic_positive", "strict_positive_retained", "missing"),
        ("strict_negative_semantic_positive", "strict_negative_rescued", "below_selected_threshold"),
        ("strict_negative_semantic_negative", "strict_negative_not_rescued", "at_or_above_selected_threshold"),
        ("strict_positive_semantic_negative", "strict_positive_retained", "at_or_above_selected_threshold"),
    ]
    scores = frame(spark, [(0.1, 0.01, 0.9, 0.35), (0.9, 0.5, 0.1, 0.35), (0.9, 0.01, 0.1, 0.35), (0.1, 0.1, 0.1, None)], "m double, l double, c double, t double")
    reason = E.score_failure(F.col("m"), F.col("l"), F.col("c"), F.col("t"), F.lit(0.05), F.lit(0.5))
    assert [r[0] for r in scores.select(reason).collect()] == [
        "mean_below_threshold+minimum_below_threshold+contradiction_veto", "nli_passed", "minimum_below_threshold", "not_used_by_selected_family",
    ]


def test_a_final_target_never_demotes(spark):
    rows = [(1, 0.0, 0.0, 0.0, 0.9, True), (0, 0.3, None, None, None, True), (0, 0.0, 0.5, 0.1, 0.1, True), (0, 0.1, 0.5, 0.1, 0.6, True), (0, 0.9, 0.9, 0.9, 0.0, False)]
    df = frame(spark, rows, "strict int, coverage double, mean_score double, min_score double, contradiction double, evaluable boolean")
    rule = {"family": "combined", "t_cov": 0.2, "t_mean": 0.35, "t_min": 0.05, "t_con": 0.5}
    got = [(r.final, r.coverage_rescue, r.nli_rescue, r.status) for r in E.final_target(df, rule).collect()]
    assert got == [
        (1, False, False, "strict_positive_retained"), (1, True, False, "strict_negative_rescued"), (1, False, True, "strict_negative_rescued"),
        (0, False, False, "strict_negative_not_rescued"), (None, None, None, None),
    ]


def test_the_grids_have_59_and_77_candidates(spark):
    small = M.rescue_grid(spark, [0.5, 0.6, 0.7, 0.8, 0.9], [0.45, 0.55, 0.65], [0.1, 0.2, 0.3], 0.5)
    large = M.rescue_grid(spark, [0.2, 0.3, 0.4, 0.45, 0.5], [0.3, 0.35, 0.4, 0.45], [0.0, 0.05, 0.1], 0.5)
    assert small.count() == 59 and large.count() == 77
    marked = E.marked_grid(large, small)
    assert marked.count() == 77 and sorted(r.family for r in marked.filter("before").collect()) == ["combined", "coverage_only", "nli_only"]


def test_distributions_of_nothing_are_null(spark):
    df = frame(spark, [(1, 1.0), (1, 2.0), (1, 4.0), (2, None)], "g int, v double")
    rows = {r.g: r for r in E.distribution(df, "v", ["g"]).collect()}
    assert (rows[1].n, rows[1].p25, rows[1].median, rows[1].p75) == (3, 1.5, 2.0, 3.0) and (rows[2].n, rows[2].median, rows[2]["mean"]) == (0, None, None)
