import math
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from ragstone.operators import alignment, features, governance, graph, grounding, learning, metrics, policy, reports, retrieval, statistics


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_bm25_ranks_the_exact_term_first_and_pads(spark):
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "the server:8080 is down"), (2, "gamma")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "SERVER:8080"), (8, "nothing")], "item_id long, text string")
    hits = retrieval.padded_top_k(retrieval.bm25_scores(retrieval.index_of(docs, "doc_id"), asked, "item_id"), docs, asked, "item_id", "doc_id", 2)
    got = rows(hits, "item_id", "rank", "doc_id")
    assert got == [(7, 1, 1), (7, 2, 0), (8, 1, 0), (8, 2, 1)]


def test_blocks_and_joins_score_alike(spark, monkeypatch):
    words = ["the", "a", "cat", "dog", "sat", "on", "mat", "rare"]
    docs = spark.createDataFrame([(i, " ".join(words[(i * j) % 7] for j in range(1, 3 + i % 9)) + (" rare" if i == 77 else "")) for i in range(200)] + [(900, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the cat cat"), (2, "rare dog"), (3, "unknown"), (4, "")], "item_id long, text string")
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 16)
    top = lambda s: rows(retrieval.padded_top_k(s, docs, asked, "item_id", "doc_id", 5), "item_id", "rank", "doc_id", "score")
    blocks = top(retrieval.bm25_candidates(retrieval.index_of(docs, "doc_id"), asked, "item_id", 5))
    assert blocks == top(retrieval.bm25_scores(retrieval.index_of(docs, "doc_id"), asked, "item_id")) and len(blocks) == 20
    monkeypatch.setattr(retrieval, "MOST_QUERY_POSTINGS", 2)
    assert blocks == top(retrieval.bm25_candidates(retrieval.index_of(docs, "doc_id"), asked, "item_id", 5))


def test_ties_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([(1, "z", 1.0), (1, "a", 1.0), (1, "m", 0.0), (1, "n", float("nan"))], "g long, k string, score double")
    assert rows(retrieval.ranked(df, "g", "k", 2), "rank", "k") == [(1, "a"), (2, "z")]


def test_exact_search_order(spark):
    v = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.exact_search(asked, v, 3).orderBy("rank").collect()] == [2, 0, 1]


def test_rrf_tie_and_single_sided(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "g long, k string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (1, "w", 3)], "g long, k string, rank int")
    got = retrieval.fused(a, b, "g", "k", 3).orderBy("rank").collect()
    assert [r.k for r in got] == ["x", "y", "w"] and got[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)


def test_recall_and_reciprocal_rank(spark):
    c = spark.createDataFrame([(1, 1, ["a"]), (1, 4, ["a", "g", "b", "c"]), (2, 1, ["a"])], "q long, k int, keys array<string>")
    gold = spark.createDataFrame([(1, "g")], "q long, d string").withColumnRenamed("d", "keys_")
    got = retrieval.ranking_metrics(c, gold.withColumnRenamed("keys_", "key"), "q", "key")
    assert rows(got, "q", "k", "recall", "reciprocal_rank") == [(1, 1, 0, 0.0), (1, 4, 1, 0.5), (2, 1, None, None)]


def test_interval_union_and_coverage(spark):
    i = spark.createDataFrame([("d", 0, 5), ("d", 5, 10), ("d", 8, 12), ("d", 20, 25), ("e", 3, 3)], "k string, start int, end int")
    merged = alignment.merged_intervals(i, "k")
    assert rows(merged, "k", "start", "end") == [("d", 0, 12), ("d", 20, 25)]
    spans = spark.createDataFrame([(1, "d", 2, 7), (2, "d", 10, 20), (3, "d", 12, 20), (4, "x", 0, 1)], "id int, k string, start int, end int")
    got = alignment.span_coverage(spans, merged, ["id"], ["k"])
    assert rows(got, "id", "coverage") == [(1, 1.0), (2, 0.2), (3, 0.0), (4, 0.0)]


def test_offset_chunks_are_slices(spark):
    text = "  " + " ".join(f"w{i}" for i in range(10)) + "  \n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "one")], "d long, text string")
    got = alignment.offset_chunks(docs, "d", window=4, step=3).orderBy("d", "chunk_index").collect()
    assert all(r.chunk == (text if r.d == 1 else "one")[r.char_start : r.char_end] for r in got)
    assert [r.chunk.split() for r in got if r.d == 1] == [[f"w{i}" for i in range(a, min(a + 4, 10))] for a in (0, 3, 6)]
    assert [r.d for r in got] == [1, 1, 1, 3]


def test_exact_spans_of_any_length(spark):
    docs = spark.createDataFrame([(1, "bathe cat sat on the mats"), (2, "nothing here"), (3, "x the cat sat on the mat y the cat sat on the mat")], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "he"), (3, "")], "item_id long, text string")
    got = rows(alignment.exact_spans(docs, needles), "item_id", "doc_id", "char_start")
    assert got == [(1, 1, 2), (1, 3, 2), (2, 1, 3), (2, 2, 8), (2, 3, 3)]


def test_overlapping_occurrences(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("abc", "abcd"), ("abc", "")], "t string, n string")
    assert [r[0] for r in df.select(alignment.occurrences(F.col("t"), F.col("n"))).collect()] == [[0, 1, 2], [], []]


def test_monotonicity(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 3, 0), (1, 5, 1)], "q int, k int, y int")
    assert rows(alignment.monotonicity_violations(df, ["q"], "k", "y"), "k") == [(3,)]


def test_score_features_with_one_hit(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (2, 1, 3.0), (2, 2, 1.0)], "q int, rank int, score double")
    got = {r.q: r for r in features.score_features(df, ["q"]).collect()}
    assert got[1].score_top2 is None and got[1].score_gap is None and got[1].score_std == 0 and got[2].score_gap == 2 and got[2].score_std == 1


def test_idf_coverage(spark):
    asked = spark.createDataFrame([(1, ["a", "b", "c"])], "q int, terms array<string>")
    context = spark.createDataFrame([(1, 1, 1, ["a", "b", "z"])], "q int, k int, rank int, terms array<string>")
    idf = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "term string, idf double")
    got = features.lexical_features(asked, context, idf, "q", F.lit(2.0)).first()
    assert got.unique_coverage == pytest.approx(2 / 3) and got.idf_coverage == pytest.approx(4 / 6)


def test_zscore_null_and_flat(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("a", None)], "s string, v double")
    assert rows(features.zscore(df, "s", "v", F.lit(True)), "s", "v_z") == [("a", -1.0), ("a", 1.0), ("a", None), ("b", 0.0)]


def test_rates_with_empty_denominators(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 1, 0), ("b", 0, 1)], "g string, y int, p int")
    got = {r.g: r for r in metrics.confusion_rates(df, "y", "p", ["g"]).collect()}
    assert got["a"].precision is None and got["a"].f1 is None and got["b"].f1 == 0


def test_weighted_confusion(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 0)], "s string, y int, p int")
    pop = spark.createDataFrame([("a", 3), ("b", 1)], "s string, size long")
    got = metrics.weighted_confusion(df, "y", "p", "s", pop).first()
    assert (got.fn, got.tp) == (0.25, 0.75)
    assert metrics.weighted_confusion(df, "y", "p", "s", pop.union(spark.createDataFrame([("c", 1)], pop.schema))).first().tp is None


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(True,)] * 8 + [(False,)] * 2, "ok boolean").withColumn("g", F.lit(1))
    got = metrics.wilson_rows(df, F.col("ok"), ["g"]).first()
    assert (got.lower, got.upper) == pytest.approx((0.4901625, 0.9433178), abs=1e-6)


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (None, 1)], "a int, b int")
    got = metrics.cohens_kappa(df, "a", "b").first()
    assert got.n == 4 and got.agreement == 0.75 and got.kappa == pytest.approx(0.5)


def test_auroc_and_ap(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, p double")
    assert metrics.auroc(df, "y", "p").first()[0] == 0.875
    assert metrics.average_precision(df, "y", "p").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert metrics.auroc(df.filter("y = 1"), "y", "p").first()[0] is None


def test_bins_are_all_there(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.95), (0, 0.0)], "y int, p double")
    got = metrics.reliability_bins(df, "y", "p").orderBy("bin").collect()
    assert [r.n for r in got] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 2] and got[1].accuracy is None
    assert metrics.calibration_error(metrics.reliability_bins(df, "y", "p")).first()[0] == pytest.approx(2 / 3 * 0.475)


def test_support_threshold(spark):
    df = spark.createDataFrame([(1, 0.95), (1, 0.9), (0, 0.85), (0, 0.1)], "y int, p double")
    cells = metrics.at_thresholds(df, "y", "p", metrics.grid(spark, [i / 50 for i in range(51)]))
    assert metrics.best_threshold(metrics.scored_thresholds(cells)).first().threshold == 0.9


def test_strict_positives_are_never_demoted(spark):
    r = spark.createDataFrame([(1, 0, None, None, None, None)], "strict int, truth int, coverage double, mean_score double, min_score double, contradiction double")
    grid = metrics.rescue_grid(spark, [0.5, 0.9], [0.45], [0.1], 0.5)
    assert grid.count() == 5
    assert rows(metrics.evaluated_candidates(r, grid), "fp") == [(1,)] * 5


def test_risk_coverage_and_aurc(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.2)], "y int, p double")
    curve = policy.risk_coverage(df, "y", "p")
    got = curve.orderBy("coverage", F.desc("threshold")).collect()
    assert [(r.answered, r.risk) for r in got] == [(0, None), (1, 0.0), (2, 0.5), (3, pytest.approx(1 / 3)), (3, pytest.approx(1 / 3))]
    assert policy.aurc(curve).first()[0] == pytest.approx((0 + 0.5 + 1 / 3) / 3)


@pytest.mark.parametrize("p5,p10,said", [(0.7, 0, "answer_k5"), (0.3, 0.7, "answer_k10"), (0.69, 0.69, "abstain_k10"), (0.29, 1, "abstain_k5")])
def test_policy_bounds(spark, p5, p10, said):
    df = spark.createDataFrame([(float(p5), float(p10))], "p5 double, p10 double")
    assert df.select(policy.action(F.col("p5"), F.col("p10"), F.lit(0.3), F.lit(0.7))).first()[0] == said


def test_abstention_has_no_quality(spark):
    acts = spark.createDataFrame([("q", "abstain_k5"), ("r", "answer_k10")], "question_id string, action string")
    states = spark.createDataFrame([("q", 5, 0.5), ("r", 10, 0.7)], "question_id string, k int, quality double")
    assert rows(policy.policy_view(acts, states), "question_id", "quality") == [("q", None), ("r", 0.7)]


def test_candidates_and_support(spark):
    df = spark.createDataFrame(
        [("c1", 1, 0.2, 0.9, 0.7, "evaluated"), ("c2", 2, 0.9, 0.8, 0.1, "evaluated"), ("c3", 3, 0.9, 0.8, 0.0, "too_long"), ("c4", 4, 0.1, 1.0, 0.0, "evaluated")],
        "chunk_id string, rank int, similarity double, entailment double, contradiction double, status string",
    ).withColumn("claim", F.lit(1))
    top = grounding.top_candidates(df, ["claim"])
    assert [r.chunk_id for r in top.orderBy("place").collect()] == ["c2", "c3", "c1"]
    got = grounding.claim_support(top, ["claim"]).first()
    assert (got.support, got.support_chunk_id, got.maximum_contradiction) == (0.9, "c1", 0.7)


def test_response_grounding_rules(spark):
    df = spark.createDataFrame(
        [("none", None, None, None), ("all", "evaluated", 0.5, 0.1), ("low", "evaluated", 0.3, 0.1), ("lost", "unevaluable", None, None), ("mix", "evaluated", 0.9, 0.2), ("mix", "unevaluable", None, None)],
        "r string, status string, support double, maximum_contradiction double",
    )
    got = {x.r: x.fully_supported for x in grounding.response_grounding(df, ["r"], 0.5).collect()}
    assert got == {"none": None, "all": True, "low": False, "lost": False, "mix": False}


def test_context_units_prefer_distinct_chunks(spark):
    df = spark.createDataFrame([(1, "a", 1, 0, 5), (1, "a", 1, 1, 4), (1, "b", 2, 0, 1), (1, "a", 1, 2, 3)], "claim int, chunk_id string, rank int, segment_index int, overlap int")
    assert rows(grounding.context_units(df, ["claim"]), "place", "chunk_id", "segment_index") == [(1, "a", 0), (2, "a", 1), (3, "b", 0)]


def test_best_unit_tie(spark):
    df = spark.createDataFrame([(1, "b", 0.8, 0.0), (1, "a", 0.8, 0.05), (1, "c", 0.2, 0.1)], "claim int, unit_id string, entailment double, contradiction double")
    got = grounding.best_unit(df, ["claim"]).first()
    assert got.unit_id == "a" and got.maximum_unit_contradiction == 0.1 and got.units == 3


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, id string, p double")
    got = {r.id: r.p_holm for r in statistics.holm(df, "family", "p", "id").collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_rank_tests(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 4.0), (0, 1.0), (0, 2.0)], "g int, v double").withColumn("b", F.lit(1))
    got = statistics.mann_whitney(df, F.col("g") == 1, "v", ["b"]).first()
    assert got.u == 4 and got.cliffs_delta == 1
    w = statistics.wilcoxon_pratt(spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 1.0), (2, 2.0), (2, 0.0)], "b int, d double"), "d", ["b"])
    assert rows(w, "b", "w", "rank_biserial") == [(1, 0.0, 0.0), (2, 0.0, 1.0)]
    assert [r.p for r in w.filter("b = 1").collect()] == [1.0]


def test_exact_tests(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (8, 0, 0, 6), (3, 10, 2, 4)], "a int, b int, c int, d int")
    got = df.select(statistics.mcnemar_p("b", "c"), statistics.fisher_p("a", "b", "c", "d")).collect()
    assert [r[0] for r in got] == pytest.approx([1.0, 1.0, 0.03857421875])
    assert got[0][1] == pytest.approx(1.0) and got[1][1] == pytest.approx(1 / 3003)


def test_bootstrap_is_reproducible(spark):
    df = spark.createDataFrame([(c, float(v)) for c in "abcd" for v in range(ord(c) - 95)], "c string, v double")
    a, b = (statistics.interval(statistics.bootstrap_means(x, "c", ["v"], 50, "1"), "v").first() for x in (df, df.repartition(7)))
    assert a == b and a.replicates == 50 and a.lower <= a.upper
    drawn = statistics.draws(df, "c", 5, "1").groupBy("replicate").agg(F.sum("times").alias("n"))
    assert rows(drawn, "n") == [(4,)] * 5


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "n long")
    edges = spark.createDataFrame([(i, f"l{i}") for i in range(8)] + [(i + 1, f"l{i}") for i in range(8)], "n long, link string")
    assert rows(graph.components(nodes, edges, "n"), "n", "component") == sorted([(i, 0) for i in range(9)] + [(i, i) for i in (9, 10, 11)], key=repr)


def test_split_is_balanced_and_whole(spark):
    parts = spark.createDataFrame([(f"c{i}", 1 + i % 3, i % 2) for i in range(100)], "c string, total long, positive long")
    split = graph.split_components(parts, "c", ["total", "positive"], {"train": 0.7, "validation": 0.15, "test": 0.15}, "1")
    got = {r.split: r for r in parts.join(split, "c").groupBy("split").agg(F.sum("total").alias("t"), F.sum("positive").alias("p"), F.count("c").alias("n")).collect()}
    assert sum(r.n for r in got.values()) == 100
    assert abs(got["test"].t - 0.15 * 199) < 2 and abs(got["validation"].p - 7.5) < 2


def test_sample_takes_turns(spark):
    df = spark.createDataFrame([(i, "s", i % 3, i % 2) for i in range(60)], "id long, s string, a long, b long")
    got = graph.balanced_sample(df, "s", 12, ["a", "b"], "id", "id", "1").collect()
    assert sorted(r.a for r in got) == [0] * 4 + [1] * 4 + [2] * 4 and sorted(r.b for r in got) == [0] * 6 + [1] * 6


def test_governance(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "train")], "k int, split string")
    assert rows(governance.leaking_keys(df, "k")) == [(1, 2)]
    with pytest.raises(governance.SealedError):
        governance.open_splits(df, ["train", "test"])
    assert governance.open_splits(df, ["train"]).count() == 2
    registry = governance.Registry({"x": "feature", "y": "outcome"})
    assert registry.validate(["x"]) == ["x"]
    with pytest.raises(ValueError):
        registry.validate(["x", "y"])
    a, b = governance.table_hash(df).first(), governance.table_hash(df.repartition(3)).first()
    assert a == b and a != governance.table_hash(df.limit(2)).first()
    assert governance.cache_key("k", {"b": 1, "a": 2}) == governance.cache_key("k", {"a": 2, "b": 1})


def test_preparation_and_folds(spark):
    df = spark.createDataFrame([(1.0, "a", 0, "g1"), (None, "b", 1, "g2"), (3.0, "a", 1, "g3"), (float("nan"), "a", 0, "g1")], "x double, c string, y int, g string")
    prepared = learning.prepare(df, ["x"], "c", ["a", "b"])
    assert prepared.medians == {"x": 2.0}
    got = prepared.apply(df).select(*prepared.columns).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, 0), (2, 1, 0, 1), (3, 0, 1, 0), (2, 1, 1, 0)]
    with pytest.raises(Exception, match="unknown level"):
        prepared.apply(df.withColumn("c", F.lit("z"))).collect()
    manifest = graph.fold_manifest(df, graph.group_folds(df, "g", 2), "g", "y")
    assert {r.overlap for r in manifest.collect()} == {0}


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 0.5, None)], "n string, v double, w int")
    assert reports.markdown(df, "T") == "# T\n\n| n | v | w |\n| --- | --- | --- |\n| a\\|b | 0.500000 | NA |\n"


def test_sums_along_an_order(spark):
    from ragstone.operators.ordering import numbered, running

    import random

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([0.0, -3.5, 1e-9, 1e12, rng.random(), rng.random() * 100, -rng.random()]), rng.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, n long").groupBy("g", "x").sum("n").withColumnRenamed("sum(n)", "n").repartition(5)
    for down in (False, True):
        got = {(r.g, r.x): r.before_n for r in running(df, ["g"], "x", ["n"], down).collect()}
        for g in "ab":
            total = 0
            for r in sorted((r for r in df.collect() if r.g == g), key=lambda r: -r.x if down else r.x):
                assert got[g, r.x] == total
                total += r.n
    names = sorted({f"{rng.choice('éaZ9')}{rng.choice('xyß')}{i}" for i in range(80)}, key=lambda t: t.encode())
    placed = numbered(spark.createDataFrame([(t,) for t in names], "t string").repartition(4), "i", "t")
    assert [r.t for r in placed.orderBy("i").collect()] == names and sorted(r.i for r in placed.collect()) == list(range(80))


def test_many_kinds_of_components_still_balance(spark):
    import random

    rng = random.Random(8)
    parts = spark.createDataFrame([(i, rng.randrange(1, 900), rng.randrange(0, 300)) for i in range(1500)], "c long, total long, positive long")
    split = graph.split_components(parts, "c", ["total", "positive"], {"train": 0.7, "validation": 0.15, "test": 0.15}, "1")
    assert split.count() == 1500 == split.select("c").distinct().count()
    sums = parts.join(split, "c").groupBy("split").sum("total", "positive").collect()
    whole = parts.groupBy().sum("total", "positive").first()
    for r in sums:
        want = {"train": 0.7}.get(r.split, 0.15)
        assert abs(r["sum(total)"] / whole[0] - want) < 0.01 and abs(r["sum(positive)"] / whole[1] - want) < 0.01


def test_permuted_deals_all_values_anew_and_importance_finds_the_column_that_matters(spark):
    df = spark.createDataFrame([(i, float(i % 2), float(i % 7), i % 2) for i in range(200)], "k long, told double, noise double, y int")
    dealt = learning.permuted(df, "told", "seed", "k")
    assert dealt.columns == df.columns and rows(dealt, "k", "noise", "y") == rows(df, "k", "noise", "y")
    assert rows(dealt, "told") == rows(df, "told") and rows(dealt) != rows(df)
    assert rows(dealt) == rows(learning.permuted(df.repartition(3), "told", "seed", "k"))
    prepared = learning.prepare(df, ["told", "noise"])
    got = learning.importance(df, learning.fit(df, prepared, "logistic"), prepared, ["told", "noise"], "k", repeats=2)
    assert [r["feature"] for r in got] == ["told", "noise"] and got[0]["drop"] > 0.3 and abs(got[1]["drop"]) < 0.05


def test_mean_support_does_not_depend_on_the_order_of_claims(spark):
    values = [0.1, 0.7, 1.0, 0.333333, 0.2, 0.923077, 0.058824] * 5
    made = lambda v: spark.createDataFrame([(1, x, 0.0, "evaluated") for x in v] + [(2, None, None, "unevaluable")], "r long, support double, maximum_contradiction double, status string").coalesce(1)
    means = lambda v: rows(grounding.response_grounding(made(v), ["r"], 0.5), "r", "mean_support")
    orders = [values, values[::-1], sorted(values), sorted(values, key=lambda x: x * 7 % 1)]
    assert len({reduce(add, v) for v in orders}) > 1  # sum() compensates
    found = [means(v) for v in orders]
    assert all(f == found[0] for f in found) and found[0][1] == (2, None) and abs(found[0][0][1] - math.fsum(values) / len(values)) < 1e-15
